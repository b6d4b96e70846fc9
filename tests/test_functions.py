"""Hand-derived cases of the text, URL, HTML, enrichment and chunking functions."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import chunking, enrich, html, prompts, tablefunctions, text, urls, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[(v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string")).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_acronyms():
    assert enrich.expand_text("Mahasiswa wajib minimal 36 SKS.") == "Mahasiswa wajib minimal 36 Satuan Kredit Semester (SKS)."
    assert enrich.expand_text("SKS (sudah)") == "SKS (sudah)"
    assert enrich.expand_text("UGM UGM UGM").count("Universitas Gadjah Mada") == 2
    assert enrich.expand_text("di ugm") == "di universitas gadjah mada (ugm)"


def test_table_prose():
    table = "| Kode | Mata Kuliah | SKS |\n| --- | --- | --- |\n| MKU101 | Kalkulus I | 3 |"
    assert html.table_prose(table) == "Kode: MKU101, Mata Kuliah: Kalkulus I, SKS: 3."
    assert html.table_prose("| a |") == "| a |"
    assert html.tables_to_prose_text(f"x\n{table}\ny\n") == "x\nKode: MKU101, Mata Kuliah: Kalkulus I, SKS: 3.\ny\n"


def test_auto_category(spark):
    def of(url):
        return tuple(one(spark, urls.auto_category(F.col("u")), u=url))

    assert of("https://pasca.jteti.ugm.ac.id/beasiswa-dalam-negeri/") == ("keuangan", "beasiswa_dalam_negeri")
    assert of("https://pasca.jteti.ugm.ac.id/2022/10/12/program-studi-magister/") == ("akademik", "program_studi")
    assert of("https://x.org/zzz") == ("informasi", "umum")


def test_urls(spark):
    assert one(spark, urls.document_id(F.col("u"), "https://a.b"), u="https://a.b/x y/z.html") == "x_y/z"
    assert one(spark, urls.document_id(F.col("u"), "https://a.b"), u="https://a.b/") == "index"
    assert one(spark, urls.normal_url(F.col("u"), "https://a.b/c"), u="https://a.b/c/d/?q#f") == "https://a.b/c/d"
    assert one(spark, urls.normal_url(F.col("u"), "https://a.b/c"), u="https://z.b/c") is None
    assert one(spark, urls.valid_url(F.col("u"), "a.b"), u="https://a.b/x.PDF?y") is False
    assert one(spark, urls.valid_url(F.col("u"), "a.b"), u="/rel/page") is True
    assert one(spark, urls.site_id(F.col("u")), u="https://a.b/x/some site/?q") == "some_site" and one(spark, urls.site_id(F.col("u")), u="https://a.b") is None
    assert one(spark, urls.folder(F.col("u"), 1, "General"), u="a/b/c.pdf") == "a"


def test_titles_and_snippets(spark):
    assert one(spark, text.clean_source_title(F.col("t"), F.col("s")), t="x", s="1.2Latar") == "1.2 Latar"
    assert one(spark, text.clean_source_title(F.col("t"), F.col("s")), t="chapter1/introduction", s="") == "introduction"
    assert one(spark, text.clean_snippet(F.col("t")), t="  const x = 1") == ""
    assert one(spark, text.truncate_at_sentence(F.col("t"), 20), t="abcdefghijklmno. pqrst uvw") == "abcdefghijklmno."
    assert one(spark, text.truncate_at_sentence(F.col("t"), 10), t="aaa bbb ccc ddd") == "aaa bbb..."
    assert one(spark, text.snippet(F.col("t"), ["z"]), t="short z") == "short z"
    long = " ".join(["word"] * 100 + ["needle"] * 3 + ["word"] * 100)
    assert "needle" in one(spark, text.snippet(F.col("t"), ["needle"], 1000), t=long)


def test_classify(spark):
    for q, kind in (("acara semua", "List"), ("artikel", "Definition"), ("halo", "General"), ("cara daftar", "List"), ("beda antara a", "Comparison"), ("siapa dia", "List")):
        assert text.classify(q) == kind == one(spark, text.classify_query(F.col("q")), q=q)


def test_strategy(spark):
    assert one(spark, text.detect_strategy(F.col("t")), t="1. a\n1. b\nc\nd\ne") == "structural"
    assert one(spark, text.detect_strategy(F.col("t")), t="a\nb\nc") == "sentence"


def test_white_space(spark):
    odd = "\t\xa0\u2003x y\u3000\r\x0b"
    assert one(spark, text.strip(F.col("t")), t=odd) == "x y" == odd.strip()
    assert one(spark, text.clean_snippet(F.col("t")), t="\t\n const x") == "" and one(spark, text.clean_snippet(F.col("t")), t="\t a\xa0") == "a"
    assert one(spark, text.clean_source_title(F.col("t"), F.col("s")), t="a/\tb\t", s=" \t") == "b"
    assert one(spark, text.detect_strategy(F.col("t")), t="\t1. a\n\t2. b\nc\nd\ne") == "structural"
    assert one(spark, text.clean_markdown(F.col("t")), t="\tmenu\nx\x0bmenu\u2028 menu\ny\x85") == "x\ny"


def slow_snippet(content, terms, most=400):
    """Window by window, as it is defined."""
    words = content.split()
    if len(content) <= most or len(words) <= 60:
        return cut(content, most)
    best = (0, 0)
    for start in range(0, len(words) - 59, 20):
        window = " ".join(words[start : start + 60]).lower()
        n = sum((3 if t.lower() in window else 0) if " " in t else min(3, window.count(t.lower())) for t in terms)
        best = max(best, (n, -start))
    return cut(" ".join(words[-best[1] : -best[1] + 80]), most)


def cut(t, most):
    if len(t) <= most:
        return t
    head = t[:most]
    end = max(head.rfind(c, int(most * 0.6)) for c in ".!?\n")
    return head[: end + 1].rstrip() if end >= 0 else head[: head.rindex(" ")] + "..." if " " in head else head + "..."


def test_snippet_against_its_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for terms in (["the", "that"], ["of the", "and"], ["zzz"]):
        for r in docs.select("text", text.snippet(F.col("text"), terms).alias("s")).collect():
            assert r.s == slow_snippet(r.text, terms)


def test_prompts(spark):
    for answer, kind in (("LIST", "List"), (" list of all ", "List"), ("Definition!", "Definition"), ("what?", "General"), (None, None)):
        assert one(spark, prompts.answered_class(F.col("a")), a=answer) == kind
    assert one(spark, prompts.classify(F.col("q"), lambda q: "COMPARISON" if q == "x" else None), q="x") == "Comparison"
    assert one(spark, prompts.classify(F.col("q"), lambda q: 1 / 0), q="sebutkan") == "List"
    assert one(spark, prompts.format_hint(F.col("k")), k="General") == "" and "numbered list" in one(spark, prompts.format_hint(F.col("k")), k="Procedural")
    assert one(spark, prompts.request(F.col("b"), prompts.ASK_BODY), b='{"query": "q", "top_k": 3}').top_k == 3
    assert one(spark, prompts.session_title(F.col("q")), q="q" * 60) == "q" * 50


def test_clean_markdown(spark):
    assert one(spark, text.clean_markdown(F.col("t")), t="menu\na\nmenu\nb\nmenu\nhy-\nphen\n\n\n\nend​ ") == "a\nb\nhyphen\n\nend"


def test_reference_without_its_semicolon_stays(spark):
    page = "<title>a &amp b&amp</title><body><h1>a &amp b&amp</h1><p>c&lt</p>&amp;lt; &#65; &#65 &notit; &ouml;&constructor;</body>"
    assert one(spark, html.page_title(F.col("h"), F.lit("u")), h=page) == html.site_title_text(page, "u") == "a &amp b&amp"
    assert one(spark, html.page_text(F.col("h")), h=page) == "a &amp b&amp\nc&lt\n&lt; A &#65 &notit; \xf6&constructor;"
    assert html.table_row_lines("<table><tr><td>R&D &amp x &lt; y</td></tr></table>") == ["R&D &amp x < y"]
    assert html.json_row_lines('<script type="application/json">{"data": [["a & b", "c&amp d"]]}</script>') == ["a & b | c&amp d"]


def test_html(spark):
    page = "<html><head><title> T &amp; U </title></head><body class='x'><nav>n</nav><p>one &lt; 2</p><!-- a > b --><script>x</script><p> two&nbsp;</p>3 < 4<br></body></html>"
    assert one(spark, html.page_text(F.col("h")), h=page) == "one < 2\ntwo\n3 < 4"
    assert one(spark, html.page_title(F.col("h"), F.lit("u")), h=page) == "T & U"
    assert one(spark, html.page_title(F.col("h"), F.lit("u")), h="<titles>no</titles><p>") == "u"
    assert one(spark, html.page_text(F.col("h")), h="<title>T</title><p>no body<p>&#233;t&eacute;") == "no body\n\xe9t\xe9"
    assert one(spark, html.page_text(F.col("h"), tables=True), h="<body>a<table><tr><td>x</td><td>y</td></tr></table>") == "a\nx\ny\nx | y"
    assert one(spark, html.long_enough(F.col("h"), html.LEAST_TEXT), h="\xe9" * 5) is True and one(spark, html.long_enough(F.col("h")), h="short") is False
    assert html.site_title_text("<title>A | B</title><main><h1> C <b>D</b></h1></main>", "u") == "CD"
    assert html.site_title_text("<title>A | B</title><h1> </h1>", "u") == "A"
    assert html.site_title_text('<meta property="og:title" content=" O ">', "u") == "O"
    assert html.site_title_text("", "https://a.b/c/some-page/") == "Some Page" and html.site_title_text("", "https://a.b/") == "https://a.b/"
    rows = "<table><tr><th>a</th><th>b</th></tr><tr><td> 1 </td><td></td></tr></table>"
    assert html.table_row_lines(rows) == ["a | b", "1"]
    assert html.json_row_lines('<script type="application/json">{"columns":[{"title":"N"},{"title":"P"}],"data":[["<b>x</b>",2],[null,true]]}</script>') == ["N: x | P: 2", "true"]
    assert html.site_markdown_text("<body><nav>x</nav><main><h2>H</h2><ul><li>i</li></ul></main></body>").split() == ["##", "H", "-", "i"]
    assert html.qmd_text("---\ntitle: x\n---\na\n```{r}\ncode\n```\n```csv\n1,2\n```\nb") == "a\n1,2\nb"
    assert one(spark, html.needs_script(F.col("h")), h="<tbody></tbody>") is True
    assert one(spark, html.needs_script(F.col("h")), h="<p>x</p>") is False


def test_enrich(spark):
    assert one(spark, enrich.normalize_numerics(F.col("t")), t="Sem. 1 Thn.2 Mhs.") == "Semester 1 Tahun 2 Mahasiswa"
    assert one(spark, enrich.repair_sentences(F.col("t")), t="kali-\nmat\nlanjut") == "kalimat lanjut"
    assert one(spark, enrich.breadcrumb(F.col("t"), F.lit("d"), F.lit(""), F.lit("s")), t="c") == "[d > s]\n\nc"


def test_cosine(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.cosine(a(0.0, 0.0), a(1.0, 2.0)), z="") == 0.0
    assert one(spark, vectors.cosine(a(1.0, 0.0), a(2.0, 0.0)), z="") == 1.0


def test_fixed():
    assert chunking.fixed("short", 100) == ["short"]
    assert chunking.fixed("aaa bbb ccc", 5) == ["aaa", "bbb", "ccc"]


def test_semantic():
    same = chunking.semantic("One sentence that is long enough. " * 20, vectors.HashEmbedder(16).embed)
    assert "".join(same).replace(" ", "") == ("One sentence that is long enough. " * 20).replace(" ", "")


def test_headings_and_recursive():
    assert chunking.by_heading("# A\nx\n## B\ny\n# C\nz") == [("x", ("A", "", "")), ("y", ("A", "B", "")), ("z", ("C", "", ""))]
    parts = chunking.recursive("word " * 1000, 100, 10)
    assert all(len(p) <= 100 for p in parts) and len(parts) > 40


bodies = st.text(st.sampled_from("ab .\n1é#:|"), max_size=400)


@settings(max_examples=60, deadline=None)
@given(bodies)
def test_chunks_keep_content(body):
    def squeezed(s):
        return "".join(s.split())

    for f in (chunking.by_sentence, chunking.structural):
        got = f(body, 20, 60)
        assert all(len(c) <= 121 for c in got)
        assert len(squeezed(body)) - len(squeezed("".join(got))) < 40 * (1 + len(body) // 40) and all(squeezed(c) in squeezed(body) for c in got)
    assert squeezed("".join(chunking.fixed(body, 30))) == squeezed(body)


def test_acronyms_absent_from_a_text_are_not_searched(monkeypatch):
    """The same as searching for each of them, also where case folds to other letters or a meaning brings one in."""
    known = enrich.ACRONYMS | {"Akhir": "the end", "A.B": "a b", "SKS": "s"}

    def plainly(text):
        for short, meaning in known.items():
            text = re.sub(rf"(?i)\b{re.escape(short)}\b(?!\s*[(\[])", lambda m, meaning=meaning: f"{meaning if m[0].isupper() else meaning.capitalize() if m[0][0].isupper() else meaning.lower()} ({m[0]})", text, count=2)
        return text

    for t in ("", "none here", "TA ta Ta TA", "\u017f\u212a\u017f S\u212aS s\u0131 \u0130p ip_ IP. a.b A.B", "sks-ai iot(IoT) IoT [x] x\nAPI akhir"):
        assert enrich.expand_text(t, acronyms=known) == plainly(t)
    searched = []
    sub = re.sub
    monkeypatch.setattr(enrich.re, "sub", lambda p, *a, **k: searched.append(p) or sub(p, *a, **k))
    assert enrich.expand_text("plain words and an api") == "plain words and an application programming interface (api)" and len(searched) == 1


def test_chunkers_get_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for made in (lambda d: chunking.explode_chunks(d, chunking.chunked(F.col("text"), "fixed")), lambda d: tablefunctions.lateral_chunks(d, strategy="fixed"), lambda d: tablefunctions.register(spark)):
            spark.conf.set(key, "10000")
            made(spark.createDataFrame([("a b",), (None,)], "text string"))
            assert int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, before)
