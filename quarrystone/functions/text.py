"""Scalar functions on text, ids and JSON, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals of the data model.
NO_TITLE = "Text not found at source"
PASSAGE_JOIN = "\n\n---\n\n"
DOCUMENT_JOIN = "\n\n"
DOCUMENT_ID_HEAD = 500  # characters of a text that its document's id is made of
TRUNCATED = "\n\n[... truncated for length ...]"
FALLBACK_CONTEXT, FALLBACK_SECTION = "json parsing failed, returning empty context", "parsing failed"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(text: Column | str) -> Column:
    """Null, empty, or white space only (of any kind, not only spaces)."""
    return F.coalesce(~_c(text).rlike(r"[^\s\x0B]"), F.lit(True))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), r"^[\s\x0B]+", ""), r"[\s\x0B]+$", "")


def keyed_hash(*columns: Column | str, bits: int = 512) -> Column:
    """SHA-2 of the columns' strings in order, without a separator."""
    return F.sha2(F.concat(*[_c(c).cast("string") for c in columns]), bits)


def document_id(source: Column | str, text: Column | str, bits: int = 512) -> Column:
    return keyed_hash(source, F.substring(_c(text), 1, DOCUMENT_ID_HEAD), bits=bits)


def unit_id(text: Column | str, bits: int = 512) -> Column:
    return keyed_hash(text, bits=bits)


def point_id(unit: Column | str) -> Column:
    """The first 16 hex digits as an unsigned number."""
    return F.conv(F.substring(_c(unit), 1, 16), 16, 10).cast("decimal(20,0)")


def truncate(text: Column | str, limit: int = 400_000) -> Column:
    return F.when(F.length(_c(text)) > limit, F.concat(F.substring(_c(text), 1, limit), F.lit(TRUNCATED))).otherwise(_c(text))


def level_label(level: Column | str) -> Column:
    return F.when(_c(level) == 0, F.lit("Raw Chunk")).otherwise(level_title(level))


def level_title(level: Column | str) -> Column:
    return F.concat(F.lit("Level-"), _c(level).cast("string"), F.lit(" Summary"))


def safe_name(title: Column | str) -> Column:
    """A file name: word characters, spaces and hyphens only, 80 of them at most, spaces as underscores."""
    kept = F.regexp_replace(_c(title), r"[^\p{L}\p{N}_\s-]", "")
    return F.replace(strip(F.substring(kept, 1, 80)), F.lit(" "), F.lit("_"))


def transcript_name(video: Column | str, title: Column | str) -> Column:
    name = safe_name(title)
    return F.concat(F.lit("transcript_"), _c(video), F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("_"), name)).otherwise(F.lit("")), F.lit(".txt"))


def transcript_title(title: Column | str) -> Column:
    """The title without a leading 'Transcript of' and quotes around it."""
    return F.regexp_replace(F.regexp_replace(_c(title), r'^Transcript of\s*["“]?', ""), r'["”]\s*$', "")


def video_id(url: Column | str) -> Column:
    """The 11 characters of a video's id in any of its URL forms, or of the bare id; null if there is none."""
    found = F.regexp_extract(_c(url), r"(?:v=|/v/|youtu\.be/|/embed/)([a-zA-Z0-9_-]{11})", 1)
    bare = F.regexp_extract(_c(url), r"^([a-zA-Z0-9_-]{11})$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(bare, F.lit("")))


def python_list(items: Column | str) -> Column:
    """An array of strings as Python writes a list; null as None."""
    quoted = F.transform(_c(items), lambda x: F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.coalesce(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")), F.lit("None"))


def passage(index, text, level, section, role, entities, score) -> Column:
    """The labelled block of one retrieved passage."""
    shown = lambda c: F.coalesce(_c(c).cast("string"), F.lit("None"))
    pad = " " * 16
    return F.concat(
        F.lit("[Passage "), shown(index), F.lit(" \n Original Text: "), shown(text), F.lit(" \n RAPTOR tree level "), level_label(level), F.lit(f" \n \n{pad}Document Section: "), shown(section),
        F.lit(" \n Chunk Role: "), shown(role), F.lit(f" \n \n{pad}Entities: "), python_list(entities), F.lit(" \n RRF Retrieval Score: "), shown(score), F.lit("]\n\n    "),
    )


def parse_enrichment(answer: Column | str, schema: str) -> Column:
    """A provider's JSON as a struct; unreadable JSON gives the fixed fallback, absent keys empty values."""
    parsed = F.from_json(_c(answer), schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ok = parsed["_bad"].isNull() & parsed.isNotNull() & _c(answer).isNotNull() & (strip(answer) != "")
    empty = F.array().cast("array<string>")
    return F.struct(
        F.when(ok, F.coalesce(parsed["context"], F.lit(""))).otherwise(F.lit(FALLBACK_CONTEXT)).alias("context"),
        F.when(ok, F.coalesce(parsed["document_section"], F.lit(""))).otherwise(F.lit(FALLBACK_SECTION)).alias("document_section"),
        F.when(ok, F.coalesce(parsed["chunk_role"], F.lit(""))).otherwise(F.lit("")).alias("chunk_role"),
        F.when(ok, F.coalesce(parsed["entities"], empty)).otherwise(empty).alias("entities"),
    )


def enriched_text(section, role, entities, context, text) -> Column:
    """What is embedded: the enrichment's labelled lines, then the chunk."""
    s = lambda c: F.coalesce(_c(c), F.lit(""))
    return strip(F.concat(F.lit("Section: "), s(section), F.lit("\nRole: "), s(role), F.lit("\nEntities: "), F.coalesce(F.array_join(_c(entities), ", "), F.lit("")), F.lit("\n\n"), s(context), F.lit("\n\n"), s(text)))


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def to_json_pretty(struct: Column) -> Column:
    return F.to_json(struct, {"pretty": "true"})
