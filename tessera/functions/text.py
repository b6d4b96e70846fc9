"""Text expressions: tokens, lexical rank, cleaning, titles, snippets, query classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"

# Unicode white space, and the four separators that Python's strip takes as well.
WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SEPARATORS = "\x1c\x1d\x1e\x1f"
# What ends a line besides \n in Markdown that is cleaned.
LINE_ENDS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Control and zero-width characters that cleaning drops.
DROPPED = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200d}\x{feff}]"

# Substrings that decide a query's class, in order of precedence.
QUERY_CLASSES = (
    ("List", ("sebutkan", "semua", "daftar", "list", "berapa jumlah", "berapa banyak", "seluruh", "lengkap", "mitra", "semua mitra", "apa saja", "siapa saja", "jumlah", "total", "kerjasama")),
    ("Procedural", ("bagaimana cara", "langkah", "prosedur", "syarat", "persyaratan", "cara mendaftar", "cara", "tahapan", "alur", "mekanisme", "tata cara", "ketentuan", "aturan", "bagaimana proses")),
    ("Comparison", ("bandingkan", "perbedaan", "persamaan", "vs", "versus", "lebih baik", "mana yang", "dibanding", "beda antara")),
    ("Definition", ("apa itu", "definisi", "pengertian", "jelaskan", "apakah", "maksud dari", "arti", "apa yang dimaksud")),
    ("List", ("prof", "profesor", "guru besar", "jabatan", "gelar", "siapa", "dosen", "pengajar", "lektor", "tenaga pendidik")),
)
# Marks of script code at the start of a snippet.
SCRIPT_MARKS = ("const ", "function ", "var ", "let ", "=>", "document.querySelector", "window.", "classList.", "getAttribute(", "getElementById", "addEventListener(", "toggleBodyColor", "bsSheetEl")


def bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used: the element of a one-element array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(text: Column, more: str = "") -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(WHITE + more))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def lexical_rank(toks: Column, terms: list[str]) -> Column:
    """Saturating term frequency over the query's terms, damped by document length; 0 without terms."""
    if not terms:
        return F.lit(0.0)
    score = F.lit(0.0)
    for w in terms:
        found = F.size(toks) - F.size(F.array_remove(toks, w))
        score = score + (1 - 1 / (1 + found.cast("double")))
    return F.round(score / len(terms) / (1 + F.log(F.greatest(F.size(toks), F.lit(1)).cast("double"))), 6)


def matches_all(toks: Column, terms: list[str]) -> Column:
    """All terms occur; nothing matches an empty query."""
    return F.size(F.array_except(F.array(*map(F.lit, terms)), toks)) == 0 if terms else F.lit(False)


def classify_query(query: Column) -> Column:
    q = F.lower(query)
    found = F.lit("General")
    for name, marks in reversed(QUERY_CLASSES):
        hit = F.lit(False)
        for m in marks:
            hit = hit | q.contains(m)
        found = F.when(hit, name).otherwise(found)
    return found


def classify(query: str) -> str:
    q = query.lower()
    return next((name for name, marks in QUERY_CLASSES if any(m in q for m in marks)), "General")


def clean_markdown(text: Column) -> Column:
    """Drop lines that recur three times or more and are short, collapse blank lines, drop control characters, rejoin hyphenated words."""
    lines = F.split(F.regexp_replace(text, LINE_ENDS, "\n"), "\n")

    def trimmed(x: Column) -> Column:
        return strip(x, SEPARATORS)

    def kept(ls: Column) -> Column:
        # Sorted, a line that occurs three times equals the one two places on.
        ordered = F.array_sort(F.filter(F.transform(ls, trimmed), lambda x: (F.char_length(x) > 0) & (F.char_length(x) < 60)))
        often = bound(ordered, lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 2))))
        return bound(often, lambda o: F.when(F.size(o) == 0, ls).otherwise(F.filter(ls, lambda x: ~F.array_contains(o, trimmed(x)))))

    out = F.regexp_replace(F.array_join(bound(lines, kept), "\n"), r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, DROPPED, "")
    out = F.regexp_replace(out, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    return strip(out, SEPARATORS)


def clean_source_title(title: Column, subcategory: Column) -> Column:
    """The subcategory with a space between number and word, else the last part of the title's path."""
    sub = strip(F.coalesce(subcategory, F.lit("")))
    last = strip(F.substring_index(title, "/", -1))
    return F.when(sub != "", F.regexp_replace(sub, r"([0-9.])(\p{L})", "$1 $2")).otherwise(F.when(last != "", last).otherwise(title))


def clean_snippet(text: Column) -> Column:
    """Trimmed text; empty if script code shows in its first 200 characters."""

    def checked(t: Column) -> Column:
        script = F.lit(False)
        for m in SCRIPT_MARKS:
            script = script | F.substring(t, 1, 200).contains(m)
        return F.when(script, "").otherwise(t)

    return bound(strip(text), checked)


def truncate_at_sentence(text: Column, most: int) -> Column:
    """At most ``most`` characters: to the last sentence end in the last two fifths, else to the last space, else cut.

    Positions are counted in characters throughout.
    """
    head, skip = F.substring(text, 1, most), int(most * 0.6)
    sentence = F.regexp_extract(head, rf"(?s)^(.{{{skip}}}.*[.!?\n])", 1)
    spaced = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(sentence != "", F.rtrim(sentence, F.lit(WHITE))).when(head.contains(" "), F.concat(spaced, F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.char_length(text) <= most, text).otherwise(cut)


def snippet(content: Column, terms: list[str], most: int = 400, window: int = 60, step: int = 20, after: int = 20) -> Column:
    """The window of words with most term hits, cut at a sentence; the earliest of equal windows wins.

    A word counts as often as it occurs, three times at most; a term of several
    words counts three if it occurs.  Each window is looked at once, and the
    winning words are bound before they are cut.
    """
    if not terms:
        return truncate_at_sentence(content, most)

    def hits(text: Column) -> Column:
        total = F.lit(0)
        for t in (t.lower() for t in terms):
            if " " in t:
                total = total + F.when(text.contains(t), 3).otherwise(0)
            elif t:
                found = (F.char_length(text) - F.char_length(F.replace(text, F.lit(t), F.lit("")))) / len(t)
                total = total + F.least(F.lit(3), found.cast("int"))
        return total

    def best(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - window, F.lit(step))
        scored = F.transform(starts, lambda s: F.struct(bound(F.lower(F.array_join(F.slice(ws, s + 1, window), " ")), hits).alias("n"), (-s).alias("s")))
        chosen = bound(-F.array_max(scored)["s"], lambda s: F.array_join(F.slice(ws, s + 1, window + after), " "))
        return F.when(F.size(ws) > window, chosen).otherwise(content)

    # Words are looked for only in what is longer than a snippet.
    words = F.filter(F.split(content, f"[{WHITE}]+"), lambda w: w != "")
    return F.when(F.char_length(content) <= most, content).otherwise(bound(bound(words, best), lambda t: truncate_at_sentence(t, most)))


def lines_of(text: Column) -> Column:
    """Lines as they are counted everywhere here: a final line break opens no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n"))


def detect_strategy(text: Column) -> Column:
    """``structural`` for numbered lists, tables and label lines, else ``sentence``."""

    def decide(lines: Column) -> Column:
        total = F.greatest(F.size(lines), F.lit(1))
        numbered = F.size(F.filter(lines, lambda x: strip(x).rlike(r"^[0-9][.)]")))
        piped = F.size(F.filter(lines, lambda x: x.contains("|")))
        labels = F.size(F.filter(lines, lambda x: x.contains(":") & (F.octet_length(strip(x)) < 80)))
        many = (numbered > F.floor(total / 5)) | (piped > F.floor(total / 4)) | (labels > F.floor(total / 3))
        return F.when(many, "structural").otherwise("sentence")

    return bound(lines_of(text), decide)


def session_title(query: Column) -> Column:
    return F.substring(query, 1, 50)
