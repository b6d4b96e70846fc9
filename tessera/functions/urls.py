"""URL expressions: validity, normal form, document ids and categories by rule table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings that are not pages.
SKIPPED_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot", ".zip", ".pdf", ".docx", ".xlsx", ".mp4", ".mp3")

# Fixed values: (pattern on the lower-cased URL, category, subcategory); the first match wins.
GENERAL_RULES = (
    (r"pendaftaran|admisi|registrasi|seleksi|daftar", "pendaftaran", "prosedur"),
    (r"beasiswa.*(dalam|lokal|domestik)|dalam.negeri", "keuangan", "beasiswa_dalam_negeri"),
    (r"beasiswa.*(luar|internasional|asing)|luar.negeri", "keuangan", "beasiswa_luar_negeri"),
    (r"beasiswa", "keuangan", "beasiswa"),
    (r"ukt|biaya.studi|biaya.kuliah|spp|keuangan", "keuangan", "biaya"),
    (r"kurikulum|mata.kuliah|silabus|rps", "akademik", "kurikulum"),
    (r"program.studi|magister|doktor|s2|s3|prodi", "akademik", "program_studi"),
    (r"tesis|disertasi|tugas.akhir|ujian.pra|pendadaran|wisuda", "akademik", "tesis"),
    (r"kalender|jadwal|semester|akademik", "akademik", "jadwal"),
    (r"jurnal|publikasi|paper|konferensi|seminar|riset|penelitian", "penelitian", "publikasi"),
    (r"dosen|tenaga.pendidik|pengajar|pembimbing|promotor", "sdm", "dosen"),
    (r"staff|tenaga.kependidikan|pegawai", "sdm", "staff"),
    (r"fasilitas|laboratorium|lab|perpustakaan|sarana", "informasi", "fasilitas"),
    (r"profil|tentang|sejarah|visi|misi|akreditasi|about", "informasi", "profil"),
    (r"pengumuman|announcement|berita|news|agenda|event|kegiatan", "informasi", "berita"),
    (r"layanan|pelayanan|dokumen|surat.keterangan|legalisir", "akademik", "layanan"),
    (r"alumni|lulusan|tracer", "informasi", "alumni"),
    (r"international|foreign|global|oia|kerjasama", "informasi", "internasional"),
)
# Rules of single sites, tried before the general ones.
SITE_RULES = {
    "pasca.jteti.ugm.ac.id": (
        (r"category/beasiswa_dalam_negeri", "keuangan", "beasiswa_dalam_negeri"),
        (r"category/beasiswa_luar_negeri", "keuangan", "beasiswa_luar_negeri"),
        (r"category/pengumuman", "informasi", "berita"),
        (r"privacy.policy", "informasi", "profil"),
        (r"\d{4}/\d{2}/\d{2}/.*beasiswa", "keuangan", "beasiswa"),
        (r"\d{4}/\d{2}/\d{2}/.*pendaftaran|prosedur", "pendaftaran", "prosedur"),
        (r"\d{4}/\d{2}/\d{2}/.*program.studi|magister|doktor", "akademik", "program_studi"),
        (r"\d{4}/\d{2}/\d{2}/.*tesis|ujian|wisuda", "akademik", "tesis"),
    ),
}


def valid_url(url: Column, host: str) -> Column:
    """Of this host, or relative, and no file of a skipped kind."""
    own = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(host)) == host
    path = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""))
    skipped = F.lit(False)
    for e in SKIPPED_ENDINGS:
        skipped = skipped | path.endswith(e)
    return own & ~skipped


def normal_url(url: Column, base: str) -> Column:
    """Resolved against ``base``, without fragment, query and closing slashes; null outside ``base``."""
    base = base.rstrip("/")
    root = "/".join(base.split("/")[:3])
    full = F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).when(url.startswith("/"), F.concat(F.lit(root), url)).otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(url, r"^\./", "")))
    out = F.regexp_replace(F.substring_index(F.substring_index(full, "#", 1), "?", 1), "/+$", "")
    return F.when(out.startswith(base), out)


def document_id(url: Column, base: str) -> Column:
    rel = F.regexp_replace(F.replace(url, F.lit(base), F.lit("")), "^/+|/+$", "")
    rel = F.regexp_replace(F.regexp_replace(rel, r"\.(html|qmd)$", ""), r"[^\p{L}\p{N}_/\-]", "_")
    rel = F.regexp_replace(rel, "^[_/]+|[_/]+$", "")
    return F.when(rel == "", "index").otherwise(rel)


def site_id(url: Column) -> Column:
    """The last part of a site's path with other characters than letters, digits, ``_`` and ``-`` as ``_``; null without a path."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    last = F.substring_index(F.regexp_replace(path, "^/+|/+$", ""), "/", -1)
    return F.regexp_replace(F.nullif(last, F.lit("")), "[^a-zA-Z0-9_-]", "_")


def auto_category(url: Column) -> Column:
    """struct<category, subcategory> by the first rule that matches the lower-cased URL, else (informasi, umum)."""
    u = F.lower(url)

    def pair(category, subcategory):
        return F.struct(F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"))

    out = pair("informasi", "umum")
    for pattern, *names in reversed(GENERAL_RULES):
        out = F.when(u.rlike(pattern), pair(*names)).otherwise(out)
    for site, rules in SITE_RULES.items():
        for pattern, *names in reversed(rules):
            out = F.when(u.contains(site) & u.rlike(pattern), pair(*names)).otherwise(out)
    return out


def folder(path: Column, level: int, default: str) -> Column:
    """The folder at a level (from 1) of a relative path, if a further part follows."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > level, F.get(parts, F.lit(level - 1))).otherwise(default)
