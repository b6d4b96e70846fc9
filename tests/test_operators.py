"""Operators on small frames, registered queries against DuckDB, and streams against batches."""

import glob
import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import accounts, analytics, ingest, search
from tessera.plans import registry
from tessera.sources import readers, sinks, tables
from tessera.streaming import streams


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    rel = duck.sql(registry.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


def ranked(spark, *scores):
    return spark.createDataFrame([(i + 1, s, f"u{i}") for i, s in enumerate(scores)], "pos int, score double, source_url string")


def test_filter_sources(spark):
    def of(df, kind="General", **kw):
        return [r.pos for r in search.filter_sources(df, kind, **kw).collect()]

    assert of(ranked(spark, 0.9, 0.8, 0.5)) == [1, 2]
    assert of(ranked(spark, 0.03, 0.03)) == [1]
    assert of(ranked(spark, 0.9, 0.8, 0.5), "List") == [1, 2, 3]
    assert of(ranked(spark, *[0.9] * 9)) == [1, 2, 3, 4, 5, 6]
    assert of(ranked(spark, 0.9, 0.9).withColumn("source_url", F.lit("same"))) == [1]


def test_search_modes(spark, sf):
    corpus = tables.corpus(spark, sf)
    v = registry._probe(spark, sf)
    for mode in ("semantic", "keyword", "hybrid", "anything"):
        assert search.search(corpus, mode, 5, ["the"], v).count() == 5
    assert search.search(corpus, "hybrid", 5, ["the"]).count() == 5
    with pytest.raises(ValueError):
        search.search(corpus, "semantic", 5, ["the"])
    assert search.fulltext_topk(corpus, [], 5).count() == 0
    top = search.rrf_topk(corpus, v, ["the"], 5).first()
    assert top.score <= round(2 / 61, 6)


def test_empty_inputs(spark, sf):
    none = tables.corpus(spark, sf).limit(0)
    assert search.hybrid_topk(none, [1.0], ["a"], 3).count() == 0
    assert analytics.summary(tables.query_logs(spark, sf).limit(0)).first().total == 0


def test_merges(spark):
    old = spark.createDataFrame([("a", 0, "x", "c1"), ("b", 0, "y", "c1")], "document_id string, chunk_index int, content string, category string")
    new = spark.createDataFrame([("a", 0, "z", "c2"), ("c", 0, "w", "c2")], old.schema)
    assert {tuple(r) for r in ingest.chunk_upsert(old, new).collect()} == {("a", 0, "z", "c1"), ("b", 0, "y", "c1"), ("c", 0, "w", "c2")}
    assert ingest.insert_new(old, new, ["document_id"]).count() == 3
    with pytest.raises(Exception, match="duplicate key"):
        ingest.insert_unique(old, new, ["document_id"]).collect()
    assert ingest.delete(old, new.select("document_id")).count() == 1
    assert ingest.update_documents(old, "a", category="q").where("category = 'q'").count() == 1
    assert ingest.update_chunk(old, "a", 0, "n").where("content = 'n'").count() == 1
    assert ingest.replace_documents(old, new).count() == 3


def test_accounts(spark, sf):
    now = datetime(2024, 1, 1)
    users = tables.users(spark, sf)
    new = spark.createDataFrame([("u7@example.com", "h", "X")], "email string, password_hash string, display_name string")
    with pytest.raises(Exception, match="taken"):
        accounts.create_users(users, new, now).collect()
    with pytest.raises(Exception, match="taken"):
        accounts.update_user(users, 7, now, email="u8@example.com").collect()
    assert accounts.update_user(users, 7, now).exceptAll(users).count() == 0
    assert accounts.update_user(users, 7, now, role="root").where("id = 7").first().role == "user"
    assert accounts.create_users(users.limit(0), new, now).first().id == 1
    first, again = (accounts.seed_admin(u, "u7@example.com", "new", "Root", now) for u in (users, users.where("id <> 7")))
    assert [df.where("email = 'u7@example.com'").select("role", "is_active", "password_hash").collect() for df in (first, again)] == [[("admin", True, "new")]] * 2


def test_tokens(spark, sf):
    now = datetime(2024, 1, 1)
    tokens = accounts.issue_token(tables.tokens(spark, sf).limit(0), 1, "t", "verification", now)
    for at, hits in ((now, 1), (now + timedelta(hours=24), 0)):
        out, who = accounts.consume_token(tokens, "t", at)
        assert who.count() == hits == out.where("used_at IS NOT NULL").count()
        assert accounts.consume_token(out, "t", now)[1].count() == 1 - hits
    assert accounts.consume_token(tokens, "none", now)[1].count() == 0
    reset = accounts.issue_token(accounts.issue_token(tokens.limit(0), 1, "a", "reset", now), 1, "b", "reset", now)
    assert [(r.token, r.expires_at) for r in reset.collect()] == [("b", now + timedelta(hours=1))]


def test_sessions_upsert_keeps_owner(spark, sf):
    old = tables.sessions(spark, sf).limit(1)
    row = old.first()
    new = old.withColumns({"user_id": F.lit(-5).cast("long"), "title": F.lit("t")})
    out = ingest.session_upsert(old, new).first()
    assert (out.user_id, out.title, out.created_at) == (row.user_id, "t", row.created_at)


def test_crawl(spark, tmp_path):
    site = {"https://h": ["/a", "b#x"], "https://h/a": ["/c?q"], "https://h/b": ["/a", "/x.pdf"], "https://h/c": ["https://other/z", "/d"], "https://h/d": []}
    pages = spark.createDataFrame([(u, "".join(f'<a href="{x}">' for x in to)) for u, to in site.items()], "url string, html string")

    def fetch(urls):
        return pages.join(urls.select("url"), "url", "left_semi")

    assert {r.url: r.depth for r in readers.crawl("https://h/", fetch, spark, checkpoint_dir=str(tmp_path / "crawl")).collect()} == {"https://h": 0, "https://h/a": 1, "https://h/b": 1, "https://h/c": 2, "https://h/d": 3}
    assert readers.crawl("https://h", fetch, spark, most=3).count() == 3


def test_sitemap_of_sitemaps(spark):
    store = spark.createDataFrame([
        ("https://h/wp-sitemap.xml", "<sitemapindex><sitemap><loc>https://h/one.xml</loc></sitemap><sitemap><loc>https://h/wp-sitemap.xml</loc></sitemap></sitemapindex>"),
        ("https://h/one.xml", "<urlset><url><loc>https://h/a/</loc></url><url><loc>https://h/a</loc></url><url><loc>https://z/b</loc></url></urlset>"),
        ("https://h/post-sitemap.xml", "<urlset><url><loc>https://h/never</loc></url></urlset>"),
    ], "url string, xml string")
    for base in ("https://h", "https://h/wp-sitemap.xml"):
        assert [r.url for r in readers.all_sitemap_urls(spark, lambda u: store.where(F.col("url").isin(u)), base).collect()] == ["https://h/a"]
    assert readers.all_sitemap_urls(spark, lambda u: store.where(F.col("url").isin(u)), "https://none").count() == 0


def test_checkpoints(spark, tmp_path):
    path = str(tmp_path / "cp")
    known = readers.checkpoint(spark, path)
    done = spark.createDataFrame([("u", "ok", "h", None), ("v", "error", None, "x")], readers.CHECKPOINT)
    sinks.save_checkpoint(readers.after_page(known, done), path)
    later = readers.after_page(readers.checkpoint(spark, path), done.where("url = 'v'").withColumn("status", F.lit("ok")))
    assert {(r.url, r.status) for r in later.collect()} == {("u", "ok"), ("v", "ok")}
    (tmp_path / "cp" / "broken.json").write_text("not json\n")
    assert readers.checkpoint(spark, path).count() == 2
    sinks.clear_checkpoint(spark, path)
    sinks.clear_checkpoint(spark, path)
    assert readers.checkpoint(spark, path).count() == 0


def test_log_append(spark, sf, tmp_path):
    logs = tables.query_logs(spark, sf)
    for _ in range(2):
        sinks.append_log(logs, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 * logs.count() and set(tables.QUERY_LOGS.names) <= set(back.columns)


def test_docx(tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
    path = tmp_path / "x.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    assert readers.docx_markdown(path.read_bytes()) == "## Head\n\none two\n\n| a | b |\n| --- | --- |\n| 1 |  |"


def test_retained_stream(spark, sf, tmp_path):
    logs = tables.query_logs(spark, sf).select("id", F.col("created_at").cast("timestamp").alias("created_at"))
    stream = streams.as_stream(logs.repartition(2), str(tmp_path / "in"))
    got = streams.run_to_end(streams.retained(stream, "created_at", 7, registry.AS_OF), "kept", "append")
    assert {r.id for r in got.collect()} == {r.id for r in ingest.retain(logs, registry.AS_OF, 7).collect()} != set()


def test_guest_counts_stream(spark, sf, tmp_path):
    asks = tables.query_logs(spark, sf).select(F.col("user_id").cast("string").alias("guest_token"))
    got = streams.run_to_end(streams.cumulative_counts(streams.as_stream(asks.repartition(3), str(tmp_path / "in"))), "guests")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in asks.groupBy("guest_token").count().collect()}


def test_conform(spark):
    df = tables.conform(spark.range(1).selectExpr("CAST(id AS string) id", "1 extra"), tables.USERS)
    assert df.columns == tables.USERS.names and df.first().email is None


def test_readers(spark, tmp_path):
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "a.html").write_text("<p>a</p>")
    (tmp_path / "site" / "404.html").write_text("x")
    (tmp_path / "site" / "p.qmd").write_text("---\nt: 1\n---\nbody")
    got = readers.site_files(spark, str(tmp_path / "site"), "https://h").collect()
    assert [(r.url, r.html) for r in got] == [("https://h/a.html", "<p>a</p>")]
    assert [r.markdown for r in readers.qmd_files(spark, str(tmp_path / "site"), "https://h").collect()] == ["body"]
    assert readers.checkpoint(spark, str(tmp_path / "none")).count() == 0
    users = spark.createDataFrame([("email,x",), ("a@b, N ,p,",), ("",)], "value string")
    assert [tuple(r) for r in readers.user_list(users).collect()] == [("a@b", "N", "p", "user")]
    found = readers.extracted(readers.files(spark, str(tmp_path), "*.html"), {"html": lambda b: b.decode().upper()})
    assert {r.markdown for r in found.collect()} == {"<P>A</P>", "X"}
    xml = spark.createDataFrame([("<urlset><loc> https://h/a </loc><loc>https://h/b.pdf</loc></urlset>",)], "xml string")
    assert [r.url for r in readers.sitemap_urls(xml, "https://h").collect()] == ["https://h/a"]
    sinks.export_json(spark.createDataFrame([("a", 0, [1.0, 2.0])], "document_id string, chunk_index int, embedding array<float>"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().embedding == "[1.0,2.0]"


def test_expansion_of_many_documents(spark):
    n = 10_050
    corpus = spark.range(2 * n).select((F.col("id") / 2).cast("long").alias("document_id"), (F.col("id") % 2).cast("int").alias("chunk_index"))
    hits = corpus.where("chunk_index = 1").withColumns({"score": F.lit(0.5), "pos": F.col("document_id").cast("int") + 1})
    for out in (search.expand_list(corpus, hits), search.expand_smart(corpus, hits)):
        rows = out.collect()
        assert len(rows) == len({(r.document_id, r.chunk_index) for r in rows}) == 2 * n and {r.score for r in rows} == {1.0}


def test_daily_stream_equals_batch(spark, sf, tmp_path):
    logs = tables.query_logs(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    logs.write.parquet(str(tmp_path / "logs"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "logs"))
    q = streams.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("daily").collect()} == {tuple(r) for r in streams.daily_counts(logs).collect()}


def test_limiter(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:0{i}:00", False) for i in range(6)] + [("k", "2024-01-01 00:20:00", True)]
    df = spark.createDataFrame(rows, "key string, at string, ok boolean").withColumn("at", F.to_timestamp("at"))
    df.orderBy(F.desc("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.limiter(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key").writeStream.format("memory").queryName("lim").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.blocked for r in spark.table("lim").orderBy("at").collect()] == [False] * 5 + [True, False]


def test_stream_ingest(spark, tmp_path):
    batches = [
        [("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3"), ("b", 0, "4")],
        [("a", 0, "5"), ("c", 0, "6"), (None, 0, "7")],
        [("c", 0, "8"), ("c", 1, "9"), (None, 0, "0")],
    ]
    schema, store, merged = "document_id string, idx int, content string", str(tmp_path / "store"), None
    for rows in batches:
        pages = spark.createDataFrame(rows, schema)
        pages.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # The stream starts again from its checkpoint for each batch.
        q = streams.ingest(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp"), lambda d: d, ["document_id", "idx"]).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"{store}/v=1").count() == 3
    want = {("a", 0, "5"), ("b", 0, "4"), ("c", 0, "8"), ("c", 1, "9"), (None, 0, "0")}
    got = [tuple(r) for r in streams.current(spark, store).collect()]
    assert len(got) == len(want) and set(got) == want
    streams.compact(spark, store, str(tmp_path / "new"))
    new = streams.current(spark, str(tmp_path / "new"), version=True).collect()
    assert {tuple(r)[:3] for r in new} == want and {r.v for r in new} == {2}


def test_stream_ingest_like_batch_replacement(spark, tmp_path):
    schema = "document_id string, idx int, content string"
    first = spark.createDataFrame([("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3")], schema)
    second = spark.createDataFrame([("a", 0, "4"), ("c", 0, "5")], schema)
    for n, df in enumerate((first, second)):
        df.write.parquet(str(tmp_path / f"v={n}"))
    want = ingest.replace_documents(first, second).collect()
    assert sorted(map(tuple, streams.current(spark, str(tmp_path)).collect())) == sorted(map(tuple, want))
    keyed = streams.one_per_key(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "k int, x string"), ["k"])
    assert {tuple(r) for r in keyed.collect()} == {(1, "b"), (None, "c")}
    assert streams.one_per_key(keyed.select("k"), ["k"]).count() == 2
