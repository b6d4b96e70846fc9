"""What goes around a language model: query classes with an outside classifier, answer-format hints, request bodies."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import classify_query, strip

# A model's one-word answers and the class each stands for.
ANSWERS = (("LIST", "List"), ("PROCEDURAL", "Procedural"), ("COMPARISON", "Comparison"), ("DEFINITION", "Definition"), ("GENERAL", "General"))
# Instructions on the form of an answer.
FORMAT_HINTS = {
    "List": "\n\nINSTRUKSI FORMAT: Query ini meminta daftar lengkap. Tampilkan SEMUA entri dalam format tabel Markdown (| No | Nama | ... |) atau numbered list. Jangan meringkas atau menghilangkan satu pun entri.",
    "Procedural": "\n\nINSTRUKSI FORMAT: Query ini meminta prosedur/langkah. Tampilkan sebagai numbered list yang urut (1. 2. 3. dst). Jika ada syarat/ketentuan, tampilkan dulu sebelum langkah.",
    "Comparison": "\n\nINSTRUKSI FORMAT: Query ini meminta perbandingan. Gunakan tabel Markdown untuk membandingkan aspek-aspek kunci secara berdampingan. Akhiri dengan ringkasan perbedaan utama.",
    "Definition": "\n\nINSTRUKSI FORMAT: Query ini meminta definisi/penjelasan. Mulai dengan definisi singkat (1-2 kalimat), lalu elaborasi dengan poin-poin penting.",
    "General": "",
}
# Fields of a question and of a page to ingest.
ASK_BODY = "query string, session_id string, category_filter string, search_mode string, top_k int"
INGEST_BODY = "url string, title string, content string, category string, subcategory string, chunk_strategy string"
PIN_BODY = "question string, sort_order int"


def answered_class(answer: Column) -> Column:
    """The class that a model's answer names: exactly, else by how it starts, else General; null for a null answer."""
    a = F.upper(strip(answer))
    found = F.lit("General")
    for mark, name in reversed(ANSWERS[:-1]):
        found = F.when(a.startswith(mark), name).otherwise(found)
    return F.when(answer.isNotNull(), found)


def classify(query: Column, model: Callable[[str], str | None] | None = None) -> Column:
    """The class of a query by an outside classifier; by its words where that gives no answer or there is none."""
    by_words = classify_query(query)
    if model is None:
        return by_words

    @F.arrow_udf("string")
    def ask(queries: pa.Array) -> pa.Array:
        out = []
        for q in queries.to_pylist():
            try:
                out.append(None if q is None else model(q))
            except Exception:  # an outside service may fail; the words decide then
                out.append(None)
        return pa.array(out, pa.string())

    return F.coalesce(answered_class(ask(query)), by_words)


def format_hint(kind: Column) -> Column:
    out = F.lit("")
    for name, hint in FORMAT_HINTS.items():
        out = F.when(kind == name, hint).otherwise(out)
    return out


def request(body: Column, fields: str) -> Column:
    """A JSON request body as a struct; null where it is no JSON object."""
    return F.from_json(body, fields)


def session_title(query: Column) -> Column:
    return F.substring(query, 1, 50)
