"""Conversation repair, source audit and line dedup: both sizes' paths, brute force, awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, source_audit, turn_repair

TURNS = "conv_id long, turn long, role string, text string, place string, n_lines long"


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


# Conversation repair ----------------------------------------------------------


def brute_repair(rows):
    """The least (cost, audit) over all edits, role by role, by trying them all; at most two inserts in a gap."""
    best = None
    legal = re.compile(r"(s?(ua)+)?\Z")
    choices = []
    for fault, initial, _ in rows:
        one = [(2, "D", "")]
        if fault not in "bd":
            extra = 5 if fault == "t" else 0
            one += [(extra, "K", initial), (extra + 1, "R", "u"), (extra + 1, "R", "a")]
        choices.append(one)
    gaps = [(5 * len(x), "I" * len(x), x) for x in ("", "u", "a", "ua", "au")]
    for picks in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            steps = [x for pair in itertools.zip_longest(inserted, picks) for x in pair if x]
            if legal.match("".join(s[2] for s in steps)):
                found = sum(s[0] for s in steps), "".join(s[1] for s in steps)
                best = min(best, found) if best else found
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_is_least_of_all_edits(n):
    kinds = list(itertools.product("bdtf", "suax"))
    drawn = random.Random(n).sample(list(itertools.product(kinds, repeat=n)), k=min(len(kinds) ** n, 60))
    for picked in drawn:
        rows = tuple((f, i, 1) for f, i in picked)
        assert turn_repair.cheapest(rows) == brute_repair(rows), rows


def test_pieces_joined_are_the_whole():
    rng = random.Random(5)
    for _ in range(200):
        rows = tuple((rng.choice("bdtfff"), rng.choice("suuaax"), 1) for _ in range(rng.randrange(2, 14)))
        cut = rng.randrange(1, len(rows))
        table = turn_repair.joined(turn_repair.paths(rows[:cut]), turn_repair.paths(rows[cut:]))
        assert min(table[0, x] for x in turn_repair.WHOLE if (0, x) in table) == turn_repair.cheapest(rows)


def awkward_turns(spark):
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["One.", "Two", "", None, "Three!", "x\ny.", "ö?"])) for i in range(60)]
    rows += [(8, 3, "user", "same.")] * 5 + [(8, None, "user", "same."), (8, None, None, None)] + [(9, t, "assistant", "Ends ") for t in (None, 1, 1, 4)]
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", "Me."), (10, 0, "", "No role."), (11, 0, "user", " \n\t"), (12, 5, "user", "long " * 50_000 + "."), (12, 6, "assistant", "so.")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)


def test_long_conversations_give_what_short_ones_give(spark):
    turns = awkward_turns(spark)
    short, long = (rows_of(turn_repair.summaries(turns, most)) for most in (10_000, 1))
    assert short == long and len(short) == 7
    short, long = (rows_of(turn_repair.repaired(turns, most)) for most in (10_000, 1))
    assert short == long


def test_long_conversation_of_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "PIECE_BITS", 2)
    turns = awkward_turns(spark)
    assert rows_of(turn_repair.summaries(turns)) == rows_of(turn_repair.summaries(turns, 1))


def test_repaired_turns_have_the_hash_and_the_pattern(spark):
    turns = awkward_turns(spark)
    told = collections.defaultdict(list)
    for r in turn_repair.repaired(turns).orderBy("conv_id", "place").collect():
        if r.edit != "delete":
            told[r.conv_id].append((r.role, r.text))
    for r in turn_repair.summaries(turns).collect():
        mine = told[r.conv_id]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(role[:1] for role, _ in mine))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest() == r.repaired_sha256


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(10)]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)
    got = collections.defaultdict(list)
    for r in turn_repair.damaged(turns).collect():
        got[r.conv_id, r.turn].append((r.role, r.text))
    plain = [("assistant", "A. b! c?")]
    for c, t, *_ in rows:
        hit = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: [], 1: [("assistant", "")], 2: [("assistant", "A b c")], 3: 2 * plain, 4: [("user", "A. b! c?")]}.get(hit, plain)
        assert got[c, t] == want


def test_repair_of_nothing(spark):
    assert turn_repair.summaries(spark.createDataFrame([], TURNS)).collect() == []
    assert turn_repair.repaired(spark.createDataFrame([], TURNS), 1).collect() == []


# Source audit ------------------------------------------------------------------

AUDIT = "doc_id long, text string, lang string, source string, n int, value string, rank string, part string"


def brute_audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs = collections.defaultdict(lambda: collections.defaultdict(int))
    count = collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in rows:
        words = term.findall(low(text or ""))
        count[lang or "", source or ""].update(words)
        for w in set(words):
            docs[lang or ""][w] += 1
    out = []
    for lang in {k[0] for k in count}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        shares = {}
        names = {s for g, s in count if g == lang}
        every = sum((count[lang, s] for s in names), collections.Counter())
        for s, c in [(None, every), *((s, count[lang, s]) for s in names)]:
            total = sum(c[w] for w in kept)
            shares[s] = {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in names:
            pair = [(sum(f(shares[s][w], shares[o][w]) for w in kept), o) for o in names if o != s]
            one = [(f(shares[s][w], shares[None][w]), w) for w in kept if count[lang, s][w] and shares[s][w] > shares[None][w]]
            for part, found, most in (("pair", pair, None), ("term", one, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def test_audit_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["Alpha", "béta", "gamma", "Δελτα", "x", "日本", "omega", "don't", "A1b"]
    rows = [(i % 50, " ".join(rng.choices(words, weights=range(1, 10), k=rng.randrange(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ç", None, "hot", "hot", "hot"]), 1, "v", "r", "p") for i in range(300)]
    rows += [(1, None, "fr", "a", 1, "v", "r", "p"), (2, "", "fr", "b", 1, "v", "r", "p"), (3, "once", "it", "only", 1, "v", "r", "p"), (4, "1 2 3", "en", "wordless", 1, "v", "r", "p"), (5, "alpha " * 40_000, "en", "a", 1, "v", "r", "p")]
    docs = spark.createDataFrame(rows, AUDIT)
    want = brute_audit(rows, 10, 3)
    assert sorted(map(tuple, source_audit.divergence(docs, 10, 3).collect())) == want
    monkeypatch.setattr(source_audit, "SENT_SOURCES", 0)
    monkeypatch.setattr(source_audit, "COUNTED_BYTES", 100)
    assert sorted(map(tuple, source_audit.divergence(docs.repartition(3), 10, 3).collect())) == want


def test_audit_of_nothing(spark):
    assert source_audit.divergence(spark.createDataFrame([], AUDIT)).collect() == []


def test_shares_stay_exact_beyond_64_bits(spark):
    big = 10**15
    row = spark.createDataFrame([(big, 3 * big, 7)], "n long, t long, v long").select(source_audit._share("n", "t", "v")).first()
    assert row[0] == 1 + 10**9 * (big + 2) // (3 * big + 14)


# Line dedup ----------------------------------------------------------------------

LINES = "doc_id long, text string, body string, gone int, shard int"


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, (50_000, 2))
    made = line_dedup.PerfectHash.build(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    assert len(made.words) * 64 < 5 * len(keys)
    row = line_dedup.Shard.row(keys, np.arange(len(keys)), np.arange(len(keys)) + 7)
    shard = line_dedup.Shard(**row)
    at = shard.find(keys)
    assert (shard.counts[at] == np.arange(len(keys))).all() and (shard.largest[at] == np.arange(len(keys)) + 7).all()
    other = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, (50_000, 2))
    assert (shard.find(other) == -1).all()
    assert line_dedup.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def brute_lines(rows, min_chars, min_docs):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    split = [[(x, low(x.strip(" \t\n\v\f\r"))) for x in (t or "").split("\n")] for _, t, *_ in rows]
    holders = collections.defaultdict(set)
    for i, ((doc_id, *_), lines) in enumerate(zip(rows, split)):
        for _, key in lines:
            if len(key) >= min_chars:
                holders[key].add((doc_id is not None, i if doc_id is None else doc_id))
    out = []
    for (doc_id, *_), lines in zip(rows, split):
        kept = [x for x, key in lines if len(holders.get(key, ())) < min_docs or not max(holders[key])[0] or max(holders[key])[1] == doc_id and doc_id is not None]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("sent", [1 << 30, -1])
def test_lines_against_brute_force(spark, sent, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    rng = random.Random(2)
    common = [f"Shared line number {i} with some more words é" for i in range(40)] + ["é" * 39, "é" * 40, "short"]
    rows = []
    for i in range(200):
        lines = [rng.choice(common) for _ in range(rng.randrange(0, 6))] + [f"own {i} " * 8] * rng.randrange(0, 3)
        lines = [rng.choice(["{}", " {}\t", "{}\r", "\x0b{}"]).format(rng.choice([x, x.upper() if x.isascii() else x])) for x in lines]
        rows.append((rng.choice([i, i, i % 7, None]), "\n".join(lines), "clash", 1, 2))
    rows += [(3, None, "c", 1, 2), (4, "", "c", 1, 2), (5, "\n", "c", 1, 2), (-9, "x" * 300_000, "c", 1, 2), *[(None, "a line that only nameless rows hold, quite long", "c", 1, 2)] * 6, *[(900, "one document in several rows holds this line alone", "c", 1, 2)] * 6]
    docs = spark.createDataFrame(rows, LINES)
    got = [tuple(r) for r in line_dedup.dedup_lines(docs, 40, 5, sent).collect()]
    key = lambda r: (r[0] is not None, *((0,) if r[0] is None else r[:1]), *r[1:])
    assert sorted(got, key=key) == sorted(brute_lines(rows, 40, 5), key=key)


def test_lines_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], LINES)).collect() == []
