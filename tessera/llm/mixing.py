"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  A flow then routes token capacity from patterns to source quotas: each
pattern offers its tokens once at no cost, a second time at cost 1, a third time
at cost 2, and so on (convex), so repetition is used only where a quota cannot
be met without it.  Last, documents are selected in a seeded order until each
pattern's flow is met.

Only the pattern table reaches the driver; its rows are the distinct sets of
sources, not documents, and more than ``MOST_PATTERNS`` of them are refused with
an error.  Selection finds each pattern's cut in the seeded order
by two rounds of histograms over hash bits, so no pattern is ever sorted or
collected in one task, however many documents it holds.

Rows: a null text has size 0; null sources are a source of their own, last in
order; documents of size 0 are never taken; repeated rows (of one doc_id, text
and sources) are repeated documents, taken alike; rows of one doc_id with
different texts or without doc_id are documents like any others; an empty table
gives an empty mix.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh

WORDS = r"[^\x20\x09-\x0D]+"
#: Most distinct sets of sources that the driver solves the flow for.
MOST_PATTERNS = 200_000
#: Largest pattern table that is broadcast.
BROADCAST_ROWS = 50_000
#: Hash bits per round of the search for a cut.
ROUND_BITS = 12
ROUNDS = 3
#: Rounds that fill what is left of a quota with one fitting document each.
FILLS = 6


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def reshared_targets(sizes: list[int], weights: list[float], share: float, limit: float) -> list[float]:
    """share * all sizes split by weight; what exceeds limit * a source's size is split again among the others."""
    total, targets = share * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in sorted(free) if left * weights[i] / weight > limit * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = limit * sizes[i]
            free.discard(i)
        left = total - sum(t for i, t in enumerate(targets) if i not in free)
    return targets


def min_cost_flow(supply: dict, quotas: dict, members: dict, repeats: int) -> dict:
    """Tokens each pattern sends to each source: {(pattern, source): tokens}.

    supply: tokens of each pattern; members: its sources.  Copy r of a pattern's
    tokens costs r.  The network falls apart into components; one pattern with one
    source needs no search.  As only the first arc of a path has a cost, the
    cheapest paths of all are those of the lowest copy that still gets through:
    the flow grows by blocking flows, copy by copy.  Ties are broken by name, so
    reruns agree.
    """
    root = {("source", x): ("source", x) for x in quotas}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for p in sorted(supply, key=repr):
        own = [("source", x) for x in members[p] if x in quotas]
        for x in own[1:]:
            root[find(x)] = find(own[0])
    parts: dict = {}
    for p in sorted(supply, key=repr):
        if own := [x for x in members[p] if x in quotas]:
            parts.setdefault(find(("source", own[0])), []).append(p)
    out = {}
    for patterns in parts.values():
        if len(patterns) == 1 and len(members[patterns[0]]) == 1:
            (p,), (x,) = patterns, members[patterns[0]]
            if sent := min(repeats * supply[p], quotas[x]):
                out[p, x] = sent
        else:
            out |= _component_flow(patterns, supply, quotas, members, repeats)
    return out


def _component_flow(patterns: list, supply: dict, quotas: dict, members: dict, repeats: int) -> dict:
    """The flow of patterns that share sources."""
    sources = sorted({x for p in patterns for x in members[p] if x in quotas}, key=repr)
    number = {x: len(patterns) + i for i, x in enumerate(sources)}
    end = len(patterns) + len(sources)
    # Arcs by number: head and room; arc i's reverse is i ^ 1.
    head, room, out = [], [], [[] for _ in range(end + 1)]

    def arc(u: int, v: int, size: int) -> None:
        for a, b, r in ((u, v, size), (v, u, 0)):
            out[a].append(len(head))
            head.append(b), room.append(r)

    for i, p in enumerate(patterns):
        for x in sorted((x for x in members[p] if x in quotas), key=repr):
            arc(i, number[x], repeats * supply[p])
    for x in sources:
        arc(number[x], end, quotas[x])
    offer = [0] * len(patterns)
    for _ in range(repeats):
        # The next copy of every pattern; what is left of earlier ones finds no way through.
        offer = [supply[p] for p in patterns]
        while True:
            far = [-1] * (end + 1)
            queue = [i for i, n in enumerate(offer) if n > 0]
            for i in queue:
                far[i] = 0
            for u in queue:
                for a in out[u]:
                    if room[a] > 0 and far[head[a]] < 0:
                        far[head[a]] = far[u] + 1
                        queue.append(head[a])
            if far[end] < 0:
                break
            at = [0] * (end + 1)
            for i in range(len(patterns)):
                while offer[i] > 0 and far[i] == 0:
                    path, u = [], i
                    while u != end:
                        if at[u] < len(out[u]):
                            a = out[u][at[u]]
                            if room[a] > 0 and far[head[a]] == far[u] + 1:
                                path.append(a)
                                u = head[a]
                            else:
                                at[u] += 1
                        elif path:
                            u = head[path.pop() ^ 1]
                            at[u] += 1
                        else:
                            break
                    if u != end:
                        break
                    sent = min(offer[i], *(room[a] for a in path))
                    for a in path:
                        room[a] -= sent
                        room[a ^ 1] += sent
                    offer[i] -= sent
    return {(p, sources[head[a] - len(patterns)]): room[a ^ 1] for i, p in enumerate(patterns) for a in out[i] if a % 2 == 0 and room[a ^ 1] > 0}


def _near(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of checked size; beyond that Spark joins it as it sees fit."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _cuts(docs: DataFrame, wanted: DataFrame, patterns: int, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """Where each pattern's seeded order is cut, and the documents beyond it that fill what is left.

    docs: _pattern, doc_id, _print, _order (62 bits), size; wanted: _pattern, _want.
    Returns (_pattern, _cut) and (_pattern, _doc, _print): all documents whose
    leading order bits are under _cut are taken whole, and so are the added ones.
    Rows that agree in doc_id and _print are added together or not at all.
    """
    near = wanted.select("_pattern", F.lit(0).cast("long").alias("_cut"), F.col("_want").alias("_left"))
    for turn in range(ROUNDS):
        shift = 62 - ROUND_BITS * (turn + 1)
        inside = docs.join(_near(near, patterns), "_pattern").where(F.shiftright("_order", shift + ROUND_BITS) == F.col("_cut"))
        bins = inside.groupBy("_pattern", "_left", F.shiftright("_order", shift).alias("_bin")).agg(F.sum("size").alias("_size"))
        w = Window.partitionBy("_pattern").orderBy("_bin")
        bins = bins.withColumn("_before", F.sum("_size").over(w) - F.col("_size")).where(F.col("_before") <= F.col("_left"))
        cut = bins.groupBy("_pattern").agg(F.max_by(F.struct("_bin", "_before", "_left"), "_bin").alias("c"))
        near = s.table(cut.select("_pattern", F.col("c._bin").alias("_cut"), (F.col("c._left") - F.col("c._before")).alias("_left")), f"cut{turn}")
    cut, left, added = near.select("_pattern", "_cut"), near.select("_pattern", "_left"), None
    after = docs.join(_near(cut, patterns), "_pattern").where((F.shiftright("_order", 62 - ROUND_BITS * ROUNDS) >= F.col("_cut")) & (F.col("size") > 0))
    tried = None
    for turn in range(FILLS):
        fit = after.join(_near(left, patterns), "_pattern").where(F.col("size") <= F.col("_left"))
        if tried is not None:
            fit = fit.join(_near(tried, FILLS * patterns), ["_pattern", "_doc", "_print"], "left_anti")
        best = fit.groupBy("_pattern").agg(F.max(F.struct("size", "_order", "_doc", "_print")).alias("b"))
        best = s.table(best.select("_pattern", F.col("b._doc").alias("_doc"), F.col("b._print").alias("_print")), f"best{turn}")
        if best.isEmpty():
            break
        # All rows of the document count.
        best = after.join(_near(best, patterns), ["_pattern", "_doc", "_print"]).groupBy("_pattern", "_doc", "_print").agg(F.sum("size").alias("_took"))
        best = best.join(_near(left, patterns), "_pattern").withColumn("_fits", F.col("_took") <= F.col("_left")).drop("_left")
        best = s.table(best, f"fill{turn}")
        tried = best.select("_pattern", "_doc", "_print") if tried is None else tried.unionByName(best.select("_pattern", "_doc", "_print"))
        best = best.where("_fits")
        more = best.select("_pattern", "_doc", "_print")
        added = more if added is None else added.unionByName(more)
        left = s.table(left.join(_near(best.select("_pattern", "_took"), patterns), "_pattern", "left").select("_pattern", (F.col("_left") - F.coalesce("_took", F.lit(0))).alias("_left")), f"left{turn}")
    return cut, docs.select("_pattern", "_doc", "_print").limit(0) if added is None else added


def _prints(sources: F.Column) -> list[F.Column]:
    """What tells rows apart besides doc_id: hashes of the id (a null is no number) and of text and sources."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.xxhash64(F.lit(53), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.to_json(F.struct(sources.alias("sources"))))]


def mix(docs: DataFrame, sources: F.Column, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    sources: an array column, the sources a document belongs to (null inside it
    is a source too).  Sources in order of code point, null last, weigh
    ``weights``, repeating, and share ``share`` of all sizes; none gets more than
    ``repeats`` times its size.  taken: words the mix takes, 0 to ``repeats``
    times the size.  For a document of several sources, source_size and target
    are those of the first of them.
    """
    return _mixed_rows(docs, sources, weights, share, repeats, seed).drop("_doc", "_print", "_copies")


def _mixed_rows(docs: DataFrame, sources: F.Column, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    spark = docs.sparkSession
    s = Scratch(spark, "mix")
    sources = F.array_sort(F.array_distinct(sources))
    doc, print_ = _prints(sources)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sources.alias("sources"), word_count(F.col("text")).alias("size"), doc.alias("_doc"), print_.alias("_print"))
    base = base.withColumns({"_pattern": F.to_json(F.struct("sources")), "_order": F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_doc", "_print"), 2)})
    base = s.table(base, "sizes")

    found = base.groupBy("_pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} distinct sets of sources")
    supply, members = {r._pattern: r.size for r in found}, {r._pattern: tuple(r.sources or ()) for r in found}
    names = sorted({x for m in members.values() for x in m}, key=lambda x: (x is None, (x or "").encode("utf-8", "surrogatepass")))
    place = {x: i for i, x in enumerate(names)}
    sizes = [0] * len(names)
    for p, m in members.items():
        for x in m:
            sizes[place[x]] += supply[p]
    targets = dict(zip(names, reshared_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, repeats)))
    flow = min_cost_flow(supply, {x: round(t) for x, t in targets.items()}, members, repeats)
    sent = dict.fromkeys(supply, 0)
    for (p, _), tokens in flow.items():
        sent[p] += tokens
    whole = {p: min(repeats, sent[p] // n) if n else 0 for p, n in supply.items()}
    rows = [(p, whole[p], sent[p] - whole[p] * supply[p], sizes[place[m[0]]] if m else 0, float(targets[m[0]]) if m else 0.0) for p, m in members.items()]
    plan = s.table(spark.createDataFrame(rows, "_pattern string, _whole long, _want long, source_size long, target double").coalesce(1), "plan")

    cut, added = _cuts(base, plan.where("_want > 0").select("_pattern", "_want"), len(rows), s)
    out = base.join(_near(plan, len(rows)), "_pattern").join(_near(cut, len(rows)), "_pattern", "left")
    out = out.join(_near(added.withColumn("_more", F.lit(1)), FILLS * len(rows)), ["_pattern", "_doc", "_print"], "left")
    before = F.shiftright("_order", 62 - ROUND_BITS * ROUNDS) < F.col("_cut")
    copies = F.col("_whole") + F.when(before | (F.col("_more") == 1), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("int")
    out = s.table(out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "_doc", "_print", copies.alias("_copies")), "result")
    s.drop(keep=("result",))
    return out


def mixed(docs: DataFrame, sources: F.Column, **kw) -> DataFrame:
    """The documents of the mix, all their columns kept; a document taken twice is there twice."""
    doc, print_, copies = (fresh(c, docs) for c in ("_doc", "_print", "_copies"))
    # Rows that agree in these have been taken alike.
    kept = _mixed_rows(docs, sources, **kw).where("_copies > 0").select(F.col("_doc").alias(doc), F.col("_print").alias(print_), F.col("_copies").alias(copies)).dropDuplicates([doc, print_])
    keys = dict(zip((doc, print_), _prints(F.array_sort(F.array_distinct(sources)))))
    taken = docs.withColumns(keys).join(kept, [doc, print_]).drop(doc, print_)
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
