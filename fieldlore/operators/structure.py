"""Pages into sections and paragraphs, in built-in expressions only.

Headings are numbered or lettered lines. A section begins where a heading differs from the last one of the document;
a page without any section so far begins one of its own. Paragraphs are split at blank lines, long ones at sentence
ends, and short ones are joined with the next; they belong to the section that is current at the end of their page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlore.functions import ids
from fieldlore.functions.text import normalize_heading, normalize_text

SHORTEST, LONGEST = 150, 600
NUMBERED, LETTERED = r"^\s*(\d{1,2})[.)]\s+(.+?)\s*$", r"^\s*([A-Z])[.)]\s+(.+?)\s*$"


def heading_of(line: Column) -> Column:
    """struct(number, letter, heading), or null if the line is no heading."""
    number, letter = F.regexp_extract(line, NUMBERED, 1), F.regexp_extract(line, LETTERED, 1)
    return F.when(line.rlike(NUMBERED), F.struct(number.cast("int").alias("number"), F.lit(None).cast("string").alias("letter"), F.regexp_extract(line, NUMBERED, 2).alias("heading"))).when(
        line.rlike(LETTERED), F.struct(F.lit(None).cast("int").alias("number"), letter.alias("letter"), F.regexp_extract(line, LETTERED, 2).alias("heading"))
    )


def split_paragraphs(text: Column) -> Column:
    """The chunks between blank lines."""
    trimmed = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(trimmed, r"\n\s*\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _pack(chunk: Column, longest: int) -> Column:
    """P5: sentences packed greedily into pieces up to the limit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, sentence: Column) -> Column:
        first, fits = state["open"] == "", F.length(state["open"]) + 1 + F.length(sentence) <= longest
        return F.struct(
            F.when(first | fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"]))).alias("done"),
            F.when(first, sentence).when(fits, F.concat(state["open"], F.lit(" "), sentence)).otherwise(sentence).alias("open"),
        )

    packed = F.aggregate(F.split(chunk, r"(?<=[.!?])\s+"), start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.when(F.length(chunk) > longest, packed).otherwise(F.array(chunk))


def _join_short(chunks: Column, shortest: int) -> Column:
    """A chunk below the limit is joined with those that follow."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(state: Column, chunk: Column) -> Column:
        grown = F.when(state["open"].isNull(), chunk).otherwise(F.concat(state["open"], F.lit(" "), chunk))
        full = F.length(grown) >= shortest
        return F.struct(F.when(full, F.concat(state["done"], F.array(grown))).otherwise(state["done"]).alias("done"), F.when(~full, grown).alias("open"))

    return F.aggregate(chunks, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def sized_paragraphs(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """P4 to P6; chunks that are a single heading line are left out."""
    chunks = F.filter(split_paragraphs(text), lambda x: ~((x.rlike(NUMBERED) | x.rlike(LETTERED)) & ~x.contains("\n")))
    return _join_short(F.flatten(F.transform(chunks, lambda x: _pack(x, longest))), shortest)


def pages(raw: DataFrame) -> DataFrame:
    """Pages once each: doc_id, page_id, page_number, raw_ocr_text, clean_text."""
    once = raw.where("doc_id IS NOT NULL AND page_number IS NOT NULL").groupBy("doc_id", "page_number").agg(F.min("page_id").alias("page_id"), F.max("raw_ocr_text").alias("raw_ocr_text"))
    return once.withColumn("raw_ocr_text", F.coalesce("raw_ocr_text", F.lit(""))).withColumn("clean_text", normalize_text(F.col("raw_ocr_text")))


def sections(of: DataFrame) -> DataFrame:
    """P10: section_id, doc_id, heading, section_number, section_letter, normalized_heading, page_start, page_end, section_index."""
    lines = of.select("doc_id", "page_number", F.posexplode(F.split(F.regexp_replace("raw_ocr_text", "\r\n?", "\n"), "\n")).alias("line_no", "line"))
    heads = lines.withColumn("h", heading_of(F.regexp_replace("line", r"^\s+|\s+$", ""))).where("h IS NOT NULL").select("doc_id", "page_number", "line_no", "h.*").withColumn("normalized_heading", normalize_heading(F.col("heading")))
    first = heads.groupBy("doc_id").agg(F.min("page_number").alias("first_headed"))
    # a document whose first page has no heading begins with a section named after that page
    opening = of.groupBy("doc_id").agg(F.min("page_number").alias("page_number")).join(first, "doc_id", "left").where("first_headed IS NULL OR first_headed > page_number")
    name = F.concat(F.lit("Page "), F.col("page_number").cast("string"))
    opened = opening.select("doc_id", "page_number", F.lit(-1).alias("line_no"), F.lit(1).alias("number"), F.lit(None).cast("string").alias("letter"), name.alias("heading"), F.lower(name).alias("normalized_heading"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "line_no")
    rows = heads.unionByName(opened)
    # the section a page opens for want of a heading is no heading to compare with
    last = F.last(F.when(F.col("line_no") >= 0, F.col("normalized_heading")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", ((F.col("line_no") < 0) | ~F.col("normalized_heading").eqNullSafe(last)).cast("int")).withColumn("section_index", F.sum("new").over(order))
    by = rows.groupBy("doc_id", "section_index").agg(*[F.min_by(c, F.struct("page_number", "line_no")).alias(c) for c in ("heading", "number", "letter", "normalized_heading")], F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    return by.select(ids.section_id("doc_id", "section_index", "heading").alias("section_id"), "doc_id", "heading", F.col("number").alias("section_number"), F.col("letter").alias("section_letter"), "normalized_heading", "page_start", "page_end", "section_index")


def paragraphs(of: DataFrame, sections_: DataFrame | None = None) -> DataFrame:
    """paragraph_id, doc_id, page_id, section_id, paragraph_index, page_number, raw_ocr_text, clean_text, char_count; without
    sections the section_id is null, and none has to be found."""
    parts = of.select("doc_id", "page_id", "page_number", F.posexplode(sized_paragraphs(F.col("raw_ocr_text"))).alias("part", "text"))
    indexed = parts.withColumn("paragraph_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "part")))
    if sections_ is None:
        placed = indexed.withColumn("section_id", F.lit(None).cast("string"))
    else:
        # the section current at the end of a page is the last that begins on it or before: one row per page, found in one pass
        starts = sections_.select("doc_id", F.col("page_start").alias("page_number"), "section_index", "section_id")
        ends = of.select("doc_id", "page_number").unionByName(starts.select("doc_id", "page_number", "section_index", "section_id"), allowMissingColumns=True)
        current = Window.partitionBy("doc_id").orderBy("page_number").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        at_end = ends.withColumn("current", F.max(F.when(F.col("section_id").isNotNull(), F.struct("section_index", "section_id"))).over(current)).where("section_id IS NULL").select("doc_id", "page_number", F.col("current.section_id").alias("section_id"))
        placed = indexed.join(at_end, ["doc_id", "page_number"], "left")
    clean = normalize_text(F.col("text"))
    return placed.select(ids.paragraph_id("doc_id", "paragraph_index", "page_number").alias("paragraph_id"), "doc_id", "page_id", "section_id", "paragraph_index", "page_number", F.col("text").alias("raw_ocr_text"), clean.alias("clean_text"), F.length(clean).alias("char_count"))


def page_sections(of: DataFrame, sections_: DataFrame) -> DataFrame:
    """Pages with the sections whose range of pages covers them."""
    s = sections_.select("doc_id", "section_id", "page_start", "page_end")
    return of.select("doc_id", "page_id", "page_number").join(s, "doc_id").where("page_number BETWEEN page_start AND page_end").select("doc_id", "page_id", "section_id")
