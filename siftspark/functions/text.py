"""Text expressions: hashing, decoding, languages, tokens, snippets, labels."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftspark.config import IGNORED_DIRS, IGNORED_FILES, IGNORED_GLOBS, LANGUAGE_BY_SUFFIX, SPECIAL_LANGUAGE, SPECIAL_NAMES, SUPPORTED_SUFFIXES

#: English words left out of the keyword index.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Words of the keyword index: two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
#: Words a query is expanded by: ASCII identifiers of two or more characters.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{1,}"


def content_hash(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """Lower-cased last suffix; empty for none, a leading dot alone, or a trailing dot."""
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    name = file_name(path)
    low = F.lower(name)
    special = F.create_map(*[F.lit(x) for kv in SPECIAL_LANGUAGE.items() for x in kv])
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_SUFFIX.items() for x in kv])
    return F.coalesce(F.try_element_at(special, low), F.try_element_at(table, suffix(name)), F.lit("text"))


def ignored_name_pattern() -> str:
    """One anchored pattern for all name globs."""
    return "^(" + "|".join(g.replace(".", r"\.").replace("*", ".*") for g in IGNORED_GLOBS) + ")$"


def is_indexed_path(path: Column) -> Column:
    """Whether a relative path is taken up: directories, name and suffix allow it."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    name = file_name(path)
    dir_ok = ~F.exists(dirs, lambda d: d.isin(*sorted(IGNORED_DIRS)) | d.startswith("."))
    name_ok = ~name.startswith(".") & ~name.isin(*sorted(IGNORED_FILES)) & ~name.rlike(ignored_name_pattern())
    return dir_ok & name_ok & (suffix(name).isin(*sorted(SUPPORTED_SUFFIXES)) | F.lower(name).isin(*sorted(SPECIAL_NAMES)))


def line_count(c: Column) -> Column:
    """Physical lines: line feeds, plus one for an unfinished last line."""
    feeds = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.coalesce(feeds + F.when((c != "") & ~c.endswith("\n"), 1).otherwise(0), F.lit(0))


def keyword_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def query_terms(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0)), F.lower)


def snippet(c: Column, chars: int) -> Column:
    """Trailing blanks removed; longer texts cut and marked."""
    end = r"(?U)[\s\x1c-\x1f]+\z"
    whole = F.regexp_replace(c, end, "")
    return F.when(F.length(whole) <= chars, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, chars), end, ""), F.lit("\n...")))


def source_ref(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), F.coalesce(end.cast("string"), F.lit("?")))


def hit_label(bm25: Column, vector: Column, score: Column) -> Column:
    rank = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}#"), c.cast("string")), F.lit("--"))
    return F.concat_ws(" ", rank("bm25", bm25), rank("vec", vector), F.format_string("rrf=%.4f", F.bround(score, 4)))


def context_block(path: Column, start: Column, end: Column, lang: Column, text: Column) -> Column:
    """One labelled, fenced block of a retrieval context."""
    lang = F.coalesce(lang, F.lit("text"))
    fence = F.when(lang == "text", "").otherwise(lang)
    return F.concat(F.lit("### "), source_ref(path, start, end), F.lit(" ("), lang, F.lit(")\n```"), fence, F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n```"))


def decode_bytes(raw: bytes | None, compat: bool = True) -> str | None:
    """Text of a file: empty if a NUL byte is among the first 4096; UTF-8, else UTF-16 (compat), else Latin-1."""
    if raw is None:
        return None
    if b"\0" in raw[:4096]:
        return ""
    for codec in ("utf-8", "utf-16", "latin-1") if compat else ("utf-8", "latin-1"):
        try:
            return raw.decode(codec)
        except UnicodeError:
            continue
    return ""


def pdf_text(raw: bytes) -> str:
    """Page texts joined by blank lines; empty if unreadable, or without a reader (of which a build warns)."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return ""
    try:
        return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)
    except Exception:  # noqa: BLE001 - an unreadable document has no text
        return ""


def decode_text(content: Column, lang: Column) -> Column:
    """Text of file contents, by decode_bytes or, for PDF, pdf_text."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else pdf_text(b) if k == "pdf" else decode_bytes(b) for b, k in zip(raw, kind)], dtype=object)

    return decode(content, lang)
