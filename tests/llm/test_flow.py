"""The flow of the mix: cheapest by a plain search over unit tokens, and fast on many sources."""

import itertools
import random
import time

from tessera.llm import mixing


def outcome(flow, supply, repeats):
    sent = dict.fromkeys(supply, 0)
    for (p, _), n in flow.items():
        sent[p] += n
    return sum(sent.values()), -sum(r * max(0, min(supply[p], n - r * supply[p])) for p, n in sent.items() for r in range(repeats))


def brute(supply, quotas, members, repeats):
    """The most tokens, and of those the least cost, over all flows of a tiny network."""
    arcs = [(p, x) for p in supply for x in members[p]]
    best = (0, 0)
    for amounts in itertools.product(*[range(min(repeats * supply[p], quotas[x]) + 1) for p, x in arcs]):
        flow = dict(zip(arcs, amounts))
        if all(sum(n for (q, _), n in flow.items() if q == p) <= repeats * supply[p] for p in supply) and all(sum(n for (_, y), n in flow.items() if y == x) <= quotas[x] for x in quotas):
            best = max(best, outcome(flow, supply, repeats))
    return best


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        names = "abc"[: rng.randint(1, 3)]
        members = {"".join(m): m for m in (tuple(sorted(rng.sample(names, rng.randint(0, len(names))))) for _ in range(3))}
        members = dict(list(members.items())[:2])
        supply, quotas = {p: rng.randint(0, 2) for p in members}, {x: rng.randint(0, 4) for x in names}
        flow = mixing.min_cost_flow(supply, quotas, members, 2)
        assert outcome(flow, supply, 2) == brute(supply, quotas, members, 2)


def test_many_sources_take_seconds():
    rng, n = random.Random(1), 20_000
    supply = {i: rng.randint(1, 10**6) for i in range(2 * n)}
    members = {i: tuple(sorted({rng.randrange(n) for _ in range(rng.randint(1, 3))})) for i in supply}
    quotas = {i: rng.randint(1, 3 * 10**6) for i in range(n)}
    began = time.perf_counter()
    flow = mixing.min_cost_flow(supply, quotas, members, 2)
    assert time.perf_counter() - began < 60
    for side, most in ((0, {p: 2 * s for p, s in supply.items()}), (1, quotas)):
        used = {}
        for pair, n in flow.items():
            used[pair[side]] = used.get(pair[side], 0) + n
        assert all(v <= most[k] for k, v in used.items())
    alone = {i: (i,) for i in range(n)}
    assert all(v > 0 for v in mixing.min_cost_flow({i: 5 for i in alone}, {i: 7 for i in alone}, alone, 2).values())
