"""Quality rules as a short-circuit cascade of column expressions.

Each rule is a condition that rejects a document.  On a hashed sample the cost of
evaluating each rule and the share of documents that it rejects are estimated;
the rules are then tried in the order of rejection per cost, and a document is
settled by the first rule that rejects it.  The order changes the work and the
reported first rule, never the verdict.  Costs are work units, linear in the
sampled characters, words and lines, so that the same table always gives the
same order.

Everything is built-in functions on the JVM: no Python runs per row, and there
is no shuffle.

Rows: a null text has no words and fails the rule on too few words; so does an
empty one.  Ties and repeated rows are judged alike; an empty table gives an
empty result; a column of the input named like a result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
#: About so many documents, chosen by a hash of their id, give the estimates.
SAMPLE_ROWS = 400
WINDOW = 8


def _full(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lazily(value: Column, then) -> Column:
    """``then`` of a value computed once: it is bound as the element of a one-element array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(_full(text), F.lit(WORDS), F.lit(0))


def word_chars(text: Column) -> Column:
    """Code points in words: all but white space."""
    return (F.char_length(_full(text)) - F.regexp_count(_full(text), F.lit(r"[\x20\x09-\x0D]"))).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(_full(text), F.lit(r"[#*$%&|<>]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(_full(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return lazily(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(F.split(_full(text), "\n")).cast("long")


def n_capitals(text: Column) -> Column:
    return F.regexp_count(_full(text), F.lit(r"\p{Lu}")).cast("long")


def repeated_words(ws: Column) -> Column:
    """How many of the words stand in a window of WINDOW words that occurs twice or more.

    Windows are compared by a 64-bit hash.  Where no window repeats, which is
    the usual case, nothing but the distinct windows is computed.
    """
    hashes = F.transform(ws, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    def covered(g: Column) -> Column:
        at = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        here = lazily(at, lambda at: F.transform(at, lambda x, k: F.when((F.get(at, k - 1)["h"] == x["h"]) | (F.get(at, k + 1)["h"] == x["h"]), x["i"])))
        places = F.array_sort(F.filter(here, lambda x: x.isNotNull()))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p")), lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["p"])).alias("n"), p.alias("p")), lambda a: a["n"])

    counted = lazily(hashes, lambda h: lazily(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))
    return F.when(F.size(ws) < WINDOW + 1, F.lit(0)).otherwise(counted).cast("long")


def measures(text: Column, ws: Column) -> dict[str, Column]:
    """What the rules look at; each a column expression over the whole text or its words ``ws``."""
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": word_chars(text),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": repeated_words(ws),
        "n_lines": n_lines(text),
        "n_capitals": n_capitals(text),
    }


#: Work of a measure: per character, per word and per line, in units of one compared character.
UNITS = {"n_words": (0.0, 0.1, 0.0), "word_chars": (1.0, 2.0, 0.0), "n_symbols": (1.0, 0.0, 0.0), "n_dup_lines": (3.0, 0.0, 20.0), "n_repeat_words": (0.0, 60.0, 0.0), "n_lines": (0.5, 0.0, 5.0), "n_capitals": (1.5, 0.0, 0.0)}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    needs: tuple[str, ...]


def default_rules(m: dict[str, Column]) -> list[Rule]:
    """Rules over the measures, in integer arithmetic."""
    return [
        Rule("few_words", m["n_words"] < 20, ("n_words",)),
        Rule("symbols", m["n_symbols"] * 10 > m["n_words"], ("n_symbols", "n_words")),
        Rule("word_length", (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]), ("word_chars", "n_words")),
        Rule("dup_lines", m["n_dup_lines"] * 2 > m["n_lines"], ("n_dup_lines", "n_lines")),
        Rule("capitals", m["n_capitals"] * 2 > m["word_chars"], ("n_capitals", "word_chars")),
        Rule("repeated_words", m["n_repeat_words"] * 100 > m["n_words"] * 30, ("n_repeat_words", "n_words")),
    ]


def estimate(docs: DataFrame, rules, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """{rule: (work units, share rejected)} of a document, on about ``rows`` documents chosen by a hash of doc_id.

    The sample serves only to put the rules in order; every document is judged.
    One job that keeps sums alone; a table of at most ``rows`` is taken whole.
    """
    every = max(1, docs.count() // max(1, rows))
    m = measures(F.col("text"), words(F.col("text")))
    some = docs.where(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(every)) == 0).select(*[c.alias(k) for k, c in m.items()], F.char_length(_full(F.col("text"))).alias("chars"))
    made = rules({k: F.col(k) for k in m})
    sums = [F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in ("chars", "n_words", "n_lines")], *[F.count_if(F.coalesce(r.rejects, F.lit(False))).alias(r.name) for r in made]]
    got = some.agg(*sums).first()
    n = max(1, got["n"])
    sizes = (got["sum_chars"] / n, got["sum_n_words"] / n, got["sum_n_lines"] / n)
    return {r.name: (1.0 + sum(u * x for c in r.needs for u, x in zip(UNITS.get(c, (1.0, 1.0, 1.0)), sizes)), got[r.name] / n) for r in made}


def cascade_order(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Names of the rules, most rejection per cost first; ties by name.  A rule that rejected none comes by its cost."""
    return sorted(estimates, key=lambda r: (-(estimates[r][1] + 1e-4) / estimates[r][0], r))


def first_rejection(rules: list[Rule], order: list[str]) -> Column:
    """Name of the first rule in this order that rejects; later ones are not evaluated.  Null: kept."""
    by_name, verdict = {r.name: r for r in rules}, F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(by_name[name].rejects, F.lit(name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules=default_rules) -> DataFrame:
    """doc_id, the base measures, ``rejected_by`` and ``kept`` for every document.

    The base measures are asked for of every document, so they are computed once
    each; what else a rule needs is computed only where the cascade gets to it.
    """
    text = F.col("text")
    order = cascade_order(estimate(docs.select("doc_id", "text"), rules))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", words(text).alias("ws"))
    m = measures(text, F.col("ws"))
    asked = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measured = base.select("doc_id", "text", *[m[k].alias(k) for k in asked])
    known = m | {k: F.col(k) for k in asked}
    return measured.select("doc_id", *asked, first_rejection(rules(known), order).alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, rules=default_rules) -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    Words are found once and handed to the rules; every other measure is
    computed only as far as the cascade gets.
    """
    text = F.col("text")
    order = cascade_order(estimate(docs.select("doc_id", "text"), rules))
    return docs.where(lazily(words(text), lambda ws: F.coalesce(first_rejection(rules(measures(text, ws)), order), F.lit(""))) == "")
