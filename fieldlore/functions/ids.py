"""Deterministic ids as column expressions: the first hex digits of a SHA-1 over normalized parts.

A part is trimmed, lower-cased and its white space collapsed. Zero, false and null count as the empty text, so that
ids stay equal to those of tables that were built so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Column | str


def _col(part: Part) -> Column:
    return F.col(part) if isinstance(part, str) else part


def part(value: Part) -> Column:
    text = _col(value).cast("string")
    empty = text.isNull() | text.isin("0", "false")
    return F.when(empty, "").otherwise(F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f\x85\xa0]+", " ")))


def text_part(value: Part) -> Column:
    """A part that is a text: only null is empty ('0' and 'false' are texts)."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(_col(value)), r"[\s\x1c-\x1f\x85\xa0]+", " ")), F.lit(""))


def stable_hash(*parts: Column, size: int = 16) -> Column:
    """Parts are results of part or text_part."""
    return F.substring(F.sha1(F.concat_ws("||", *parts).cast("binary")), 1, size)


def doc_id(title: Part, date_start: Part, date_end: Part, source_file: Part) -> Column:
    return F.concat(F.lit("doc_"), stable_hash(*map(text_part, (title, date_start, date_end, source_file))))


def page_id(doc: Part, number: Part) -> Column:
    return F.concat(_col(doc), F.format_string(":page:%04d", _col(number)))


def section_id(doc: Part, index: Part, heading: Part) -> Column:
    return F.concat(_col(doc), F.format_string(":section:%03d:", _col(index)), stable_hash(text_part(heading), size=8))


def paragraph_id(doc: Part, index: Part, page: Part) -> Column:
    return F.concat(_col(doc), F.format_string(":paragraph:%05d:p%04d", _col(index), _col(page)))


def annotation_id(doc: Part, page: Part, index: Part, kind: Part, text: Part) -> Column:
    return F.concat(_col(doc), F.format_string(":annotation:%04d:%03d:", _col(page), _col(index)), stable_hash(text_part(kind), text_part(text), size=8))


def claim_id(run: Part, paragraph: Part, index: Part, sentence: Part) -> Column:
    return F.concat(_col(run), F.format_string(":claim:%03d:", _col(index)), stable_hash(text_part(paragraph), text_part(sentence)))


def measurement_id(run: Part, claim: Part, index: Part, name: Part, raw: Part) -> Column:
    return F.concat(_col(run), F.format_string(":measurement:%03d:", _col(index)), stable_hash(text_part(claim), text_part(name), text_part(raw)))


def mention_id(run: Part, paragraph: Part, start: Part, end: Part, surface: Part) -> Column:
    return F.concat(_col(run), F.lit(":mention:"), stable_hash(text_part(paragraph), part(start), part(end), text_part(surface)))


def entity_id(label: Part, form: Part) -> Column:
    return F.concat(F.lower(_col(label)), F.lit("_"), stable_hash(text_part(label), text_part(form)))


def period_id(start: Part, end: Part, title: Part) -> Column:
    return F.concat(F.lit("period_"), stable_hash(*map(text_part, (start, end, title))))


def observation_id(run: Part, claim: Part, index: Part, kind: Part) -> Column:
    return F.concat(_col(run), F.format_string(":observation:%03d:", _col(index)), stable_hash(text_part(claim), text_part(kind)))


def event_id(run: Part, claim: Part, index: Part, kind: Part) -> Column:
    return F.concat(_col(run), F.format_string(":event:%03d:", _col(index)), stable_hash(text_part(claim), text_part(kind)))


def year_id(year: Part) -> Column:
    return F.concat(F.lit("year_"), _col(year).cast("string"))
