"""Text enrichment before and after chunking."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import python_column

# Acronyms and what they stand for, in the order in which they are expanded.
ACRONYMS = {
    "SKS": "Satuan Kredit Semester", "KRS": "Kartu Rencana Studi", "KHS": "Kartu Hasil Studi", "IPK": "Indeks Prestasi Kumulatif", "IP": "Indeks Prestasi",
    "IPS": "Indeks Prestasi Semester", "TA": "Tugas Akhir", "KKN": "Kuliah Kerja Nyata", "PKL": "Praktik Kerja Lapangan", "DO": "Drop Out", "TK": "Tidak Kehadiran",
    "PMPSTI": "Program Magister Pengelolaan Sistem Teknik Informasi", "MTI": "Magister Teknologi Informasi", "DTETI": "Departemen Teknik Elektro dan Teknologi Informasi",
    "FT": "Fakultas Teknik", "UGM": "Universitas Gadjah Mada", "FMIPA": "Fakultas Matematika dan Ilmu Pengetahuan Alam", "FK": "Fakultas Kedokteran",
    "EWMP": "Ekuivalensi Waktu Mendidik Penuh", "BKD": "Beban Kerja Dosen", "KBK": "Kelompok Bidang Keahlian", "NIDN": "Nomor Induk Dosen Nasional",
    "NIP": "Nomor Induk Pegawai", "NIM": "Nomor Induk Mahasiswa", "tendik": "Tenaga Kependidikan",
    "SK": "Surat Keputusan", "MOU": "Memorandum of Understanding", "PKS": "Perjanjian Kerja Sama", "RKAT": "Rencana Kegiatan dan Anggaran Tahunan",
    "SPP": "Sumbangan Pembinaan Pendidikan", "UKT": "Uang Kuliah Tunggal", "BPP": "Biaya Penyelenggaraan Pendidikan",
    "RPS": "Rencana Pembelajaran Semester", "SAP": "Satuan Acara Perkuliahan", "GBPP": "Garis-garis Besar Program Pengajaran", "KKNI": "Kerangka Kualifikasi Nasional Indonesia",
    "CPL": "Capaian Pembelajaran Lulusan", "CPMK": "Capaian Pembelajaran Mata Kuliah", "OBE": "Outcome Based Education",
    "KTI": "Karya Tulis Ilmiah", "BAB": "Bagian", "DOI": "Digital Object Identifier", "ISSN": "International Standard Serial Number", "ISBN": "International Standard Book Number",
    "TI": "Teknologi Informasi", "SI": "Sistem Informasi", "AI": "Kecerdasan Buatan", "ML": "Machine Learning", "DL": "Deep Learning",
    "NLP": "Natural Language Processing", "DB": "Database", "API": "Application Programming Interface", "IoT": "Internet of Things",
}


_FOLDED = str.maketrans("\u017f\u0131\u0130", "sii")


def _words(text: str) -> list[str]:
    """The text's words, in lower case as matching without case sees them."""
    return re.findall(r"\w+", text.translate(_FOLDED).lower())


def expand_text(text: str, most: int = 2, acronyms: dict[str, str] = ACRONYMS) -> str:
    """Put the meaning before the first ``most`` stand-alone uses of each acronym that has no bracket behind it, in the use's case."""
    held = set(_words(text))
    for short, meaning in acronyms.items():
        # Most acronyms are not in a text, nor put in by the meaning of another.
        if re.fullmatch(r"\w+", short) and short.lower() not in held:
            continue
        held.update(_words(meaning))

        def spell(m: re.Match, meaning=meaning) -> str:
            use = m[0]
            case = meaning if use.isupper() else meaning.capitalize() if use[0].isupper() else meaning.lower()
            return f"{case} ({use})"

        text = re.sub(rf"(?i)\b{re.escape(short)}\b(?!\s*[(\[])", spell, text, count=most)
    return text


def expand_acronyms():
    return python_column(expand_text)


def repair_sentences(text: Column) -> Column:
    text = F.regexp_replace(text, r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2")
    return F.regexp_replace(text, "([a-zàáâãäå])\n([a-zàáâãäå])", "$1 $2")


def normalize_numerics(text: Column) -> Column:
    for short, word in (("Sem", "Semester"), ("Thn", "Tahun")):
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_]){short}\.\s*([0-9])", f"{word} $1")
    return F.regexp_replace(text, r"(?<![\p{L}\p{N}_])Mhs\.", "Mahasiswa")


def enrich_text(text: Column) -> Column:
    return expand_acronyms()(normalize_numerics(repair_sentences(text)))


def breadcrumb(content: Column, *path: Column) -> Column:
    """``[a > b > c]`` and a blank line before the content; missing parts are left out."""
    parts = F.filter(F.array(*path), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(parts) > 0, F.concat(F.lit("["), F.array_join(parts, " > "), F.lit("]\n\n"), content)).otherwise(content)


def passage(content: Column, *path: Column) -> Column:
    """What is embedded for a stored chunk."""
    return F.concat(F.lit("passage: "), breadcrumb(content, *path))
