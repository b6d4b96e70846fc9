"""Readers of files, sites, sitemaps, user lists and checkpoints."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import html, urls

# Where sites keep their sitemap, in the order in which they are tried.
SITEMAPS = ("sitemap.xml", "sitemap-index.xml", "wp-sitemap.xml", "news-sitemap.xml", "page-sitemap.xml", "post-sitemap.xml")



def files(spark: SparkSession, folder: str, endings: str = "*.{pdf,docx}") -> DataFrame:
    """path, document_id (the name without its ending), modificationTime, length, content of files in all sub-folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", endings).load(folder)
    return found.withColumn("document_id", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))


def extracted(found: DataFrame, parsers: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """Markdown of each file by the parser for its ending; empty where a parser fails or is missing."""

    @F.arrow_udf("string")
    def run(paths: pa.Array, contents: pa.Array) -> pa.Array:
        out = []
        for path, content in zip(paths.to_pylist(), contents.to_pylist()):
            parse = parsers.get(path.rsplit(".", 1)[-1].lower())
            try:
                out.append(parse(content) if parse else "")
            except Exception:  # a broken file is an empty document
                out.append("")
        return pa.array(out, pa.string())

    return found.withColumn("markdown", run("path", "content"))


def docx_markdown(content: bytes) -> str:
    """Headings, paragraphs and tables of a Word file, by the standard library only."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    out = []
    for el in body:
        if el.tag == f"{w}p":
            text = "".join(t.text or "" for t in el.iter(f"{w}t")).strip()
            style = next((s.get(f"{w}val", "") for s in el.iter(f"{w}pStyle")), "").lower().replace(" ", "")
            level = int(style[7]) if style[:7] == "heading" and style[7:8] in "1234" and style[7:8] else 0
            if text:
                out.append(f"{'#' * level} {text}" if level else text)
        elif el.tag == f"{w}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{w}t")).replace("\n", " ").strip() for c in r.iter(f"{w}tc")] for r in el.iter(f"{w}tr")]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            out.append("\n".join([*lines[:1], "|" + " --- |" * len(rows[0]) if rows else "", *lines[1:]]))
    return "\n\n".join(out)


def site_files(spark: SparkSession, folder: str, base_url: str, pattern: str = "*.html") -> DataFrame:
    """url, html of a rendered site on disk, without its search and error pages."""
    pages = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True).withColumn("path", F.input_file_name())
    root = folder.split(":", 1)[-1].rstrip("/").replace("//", "")
    rel = F.regexp_replace(F.replace("path", F.lit(root), F.lit("\x00")), "^.*\x00/?", "")
    pages = pages.where(~F.substring_index("path", "/", -1).isin("404.html", "search.html"))
    return pages.select(F.regexp_replace(F.concat(F.lit(base_url.rstrip("/") + "/"), rel), r"/index\.html$", "").alias("url"), F.col("value").alias("html"))


def qmd_files(spark: SparkSession, folder: str, base_url: str) -> DataFrame:
    """url, markdown of Quarto sources, without build folders and index pages."""
    pages = site_files(spark, folder, base_url, "*.qmd")
    pages = pages.where(~F.col("url").rlike(r"/(_site|_book|_freeze|\.quarto|node_modules|\.git)/") & ~F.substring_index("url", "/", -1).isin("README.qmd", "index.qmd"))
    return pages.select(F.regexp_replace("url", r"\.qmd$", ".html").alias("url"), html.python_column(html.qmd_text)("html").alias("markdown"))


def sitemap_urls(xml: DataFrame, base: str) -> DataFrame:
    """Distinct page URLs of sitemap documents (a column ``xml``), of this site, in their first order; nested sitemaps come as ``is_index``."""
    locs = xml.select(F.col("xml").contains("<sitemapindex").alias("is_index"), F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("at", "url"))
    host = base.split("/")[2]
    return locs.where(F.col("is_index") | (urls.valid_url(F.col("url"), host) & F.col("url").startswith(base))).groupBy("url", "is_index").agg(F.min("at").alias("at"))


def all_sitemap_urls(spark: SparkSession, fetch: Callable[[list[str]], DataFrame], base: str, deepest: int = 10) -> DataFrame:
    """Distinct page URLs of a site's sitemaps, nested ones included.

    fetch: from URLs to (url, xml) of those that are there.  The first of the
    usual names that leads to any page counts; sitemaps are read level by level,
    each once.
    """
    schema = "url string, at long"
    for name in SITEMAPS if not base.endswith(".xml") else ("",):
        todo, seen = [f"{base.rstrip('/')}/{name}" if name else base], set()
        site = base.rstrip("/") if name else base.rsplit("/", 1)[0]
        found = spark.createDataFrame([], schema)
        for _ in range(deepest):
            seen |= set(todo)
            level = sitemap_urls(fetch(todo), site).withColumn("at", F.col("at").cast("long")).cache()
            found = found.unionByName(level.where("NOT is_index").select(F.regexp_replace("url", "/+$", "").alias("url"), "at"))
            todo = [r.url for r in level.where("is_index").orderBy("at").collect() if r.url not in seen]  # names of sitemaps, not pages
            if not todo:
                break
        found = found.groupBy("url").agg(F.min("at").alias("at"))
        if not found.isEmpty():
            return found
    return spark.createDataFrame([], schema)


def crawl(start: str, fetch: Callable[[DataFrame], DataFrame], spark: SparkSession, most: int = 500, checkpoint_dir: str | None = None) -> DataFrame:
    """url, html, depth of the pages that links lead to from ``start``, nearest first, at most ``most``.

    fetch: from a table of URLs to (url, html) of those that are pages.  One
    round per link distance; what was seen stays a table (checkpointed each
    round, as a written folder, where one is named).
    """
    base, depth = start.rstrip("/"), 0
    frontier = spark.createDataFrame([(base,)], "url string")
    seen, pages = frontier, None
    while True:
        have = pages.count() if pages is not None else 0
        got = fetch(frontier.orderBy("url").limit(most - have)).select("url", "html").withColumn("depth", F.lit(depth))
        if checkpoint_dir:
            got.write.mode("overwrite").parquet(f"{checkpoint_dir}/pages-{depth}")
            got = spark.read.parquet(f"{checkpoint_dir}/pages-{depth}")
        else:
            got = got.cache()
        pages = got if pages is None else pages.unionByName(got)
        frontier = next_frontier(links(got), seen, base)
        if checkpoint_dir:
            frontier.write.mode("overwrite").parquet(f"{checkpoint_dir}/frontier-{depth}")
            frontier = spark.read.parquet(f"{checkpoint_dir}/frontier-{depth}")
        else:
            frontier = frontier.cache()
        seen, depth = seen.unionByName(frontier), depth + 1
        if frontier.isEmpty() or pages.count() >= most:
            return pages


def next_frontier(links: DataFrame, seen: DataFrame, base: str) -> DataFrame:
    """URLs one link further: valid, normal, not seen.  A crawl is a loop of these."""
    found = links.where(urls.valid_url(F.col("href"), base.split("/")[2])).select(urls.normal_url(F.col("href"), base).alias("url")).where("url IS NOT NULL").distinct()
    return found.join(seen.select("url"), "url", "left_anti")


def links(pages: DataFrame) -> DataFrame:
    """url, href of every link of pages (url, html)."""
    return pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']*)["']"""), F.lit(1))).alias("href"))


def user_list(lines: DataFrame) -> DataFrame:
    """email, user_name, password, role from lines (``value``) of comma-separated fields; heading and blank lines are skipped."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = lines.where((F.trim("value") != "") & ~F.lower(F.trim("value")).startswith("email")).select(parts.alias("p"))
    return rows.select(F.get("p", F.lit(0)).alias("email"), F.get("p", F.lit(1)).alias("user_name"), F.get("p", F.lit(2)).alias("password"), F.coalesce(F.nullif(F.get("p", F.lit(3)), F.lit("")), F.lit("user")).alias("role"))


CHECKPOINT = "url string, status string, hash string, error string"


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """url, status, hash, error of earlier pages; empty without a checkpoint."""
    try:
        return spark.read.schema(CHECKPOINT).json(path).where("url IS NOT NULL")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], CHECKPOINT)
        raise


def after_page(known: DataFrame, done: DataFrame) -> DataFrame:
    """The checkpoint with the pages just done (url, status, hash, error): the latest of each URL counts."""
    return known.join(done.select("url"), "url", "left_anti").select(*known.columns).unionByName(done.select(*known.columns))


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 8, **options) -> DataFrame:
    """A database table, read in parallel ranges of a numeric key."""
    split = {"partitionColumn": key, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions} if key else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **split, **options).load()
