"""Reading and writing of reports, bundles and tables in files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlore.functions import ids
from fieldlore.functions.text import report_year

METADATA = "title string, doc_title string, doc_type string, series string, date_start string, date_end string, report_year int, archive_ref string, language string, doc_id string, source_file string"
PAGE = "page_number int, ocr_confidence double, raw_ocr_text string, raw_text string, image_ref string, annotations array<struct<kind: string, text: string, bbox: array<double>>>"
REPORT = f"metadata struct<{', '.join(c.replace(' ', ': ', 1) for c in METADATA.split(', '))}>, pages array<struct<{PAGE.replace('page_number int', 'page_number: int').replace('ocr_confidence double', 'ocr_confidence: double').replace('raw_ocr_text string', 'raw_ocr_text: string').replace('raw_text string', 'raw_text: string').replace('image_ref string', 'image_ref: string').replace('annotations array', 'annotations: array')}>>"


def reports(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON reports of files and folders, with file_hash and file name; unknown keys are ignored."""
    raw = spark.read.schema(REPORT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(list(paths))
    return raw.withColumn("path", F.input_file_name())


def payload_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """Path and file_hash of JSON files: the SHA-1 of the payload with its keys in order, so that neither blanks nor the
    order of keys count; a file that is no JSON has none."""

    def kernel(batches):
        import hashlib
        import json

        import pandas as pd

        for b in batches:
            out = []
            for text in b["value"]:
                try:
                    out.append(hashlib.sha1(json.dumps(json.loads(text), sort_keys=True).encode()).hexdigest())
                except ValueError:
                    out.append(None)
            yield pd.DataFrame({"path": b["path"], "file_hash": out})

    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(list(paths), wholetext=True)
    return raw.withColumn("path", F.input_file_name()).select("path", "value").mapInPandas(kernel, "path string, file_hash string")


def documents(of: DataFrame) -> DataFrame:
    """One row per report: the document's record."""
    m = F.col("metadata")
    title = F.coalesce(m["title"], m["doc_title"])
    source = F.coalesce(m["source_file"], F.regexp_replace("path", r"^.*/", ""))
    given = F.coalesce(m["doc_id"], ids.doc_id(title, m["date_start"], m["date_end"], source))
    return of.select(
        given.alias("doc_id"), title.alias("title"), F.coalesce(m["doc_type"], F.lit("narrative_report")).alias("doc_type"), m["series"].alias("series"), m["date_start"].alias("date_start"), m["date_end"].alias("date_end"),
        report_year(m["report_year"], m["date_start"], source).alias("report_year"), source.alias("source_file"), m["archive_ref"].alias("archive_ref"), F.coalesce(m["language"], F.lit("en")).alias("language"), F.size("pages").alias("page_count"), F.sha1(F.to_json(F.struct("metadata", "pages")).cast("binary")).alias("file_hash"), "pages",
    )


def pages(docs: DataFrame) -> DataFrame:
    """The pages of documents(): doc_id, page_id, page_number, raw_ocr_text, ocr_confidence, image_ref."""
    p = docs.select("doc_id", F.explode("pages").alias("p"))
    return p.select("doc_id", ids.page_id("doc_id", "p.page_number").alias("page_id"), "p.page_number", F.coalesce("p.raw_ocr_text", "p.raw_text").alias("raw_ocr_text"), "p.ocr_confidence", "p.image_ref")


def annotations(docs: DataFrame) -> DataFrame:
    p = docs.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", F.posexplode("p.annotations").alias("i", "a"))
    return p.select(ids.annotation_id("doc_id", "page_number", F.col("i") + 1, "a.kind", "a.text").alias("annotation_id"), "doc_id", "page_number", "a.kind", "a.text", "a.bbox")


#: Older names of columns and the new ones (fixed values).
ALIASES = {"certainty": "epistemic_status", "normalized_name": "normalized_form", "refuge_id": "anchor_entity_id", "label": "source_title"}


def tolerant(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with exactly the columns of a schema: older names are read, missing columns are null, others are dropped."""
    have = set(rows.columns)

    def value(field: T.StructField) -> Column:
        names = [n for n in (field.name, *(old for old, new in ALIASES.items() if new == field.name)) if n in have]
        return (F.coalesce(*map(F.col, names)) if names else F.lit(None)).cast(field.dataType).alias(field.name)

    return rows.select(*map(value, schema.fields))


def bundles(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key with an array of structs for each part."""
    nested = [df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(name)) for name, df in parts.items()]
    return functools.reduce(lambda a, b: a.join(b, key, "full"), nested)


def unbundled(rows: DataFrame, key: str, part: str) -> DataFrame:
    """S3: the rows of one part of bundles."""
    return rows.select(key, F.explode(part).alias("x")).select(key, "x.*")


def cells(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a row fits into CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in rows.schema.fields])


def write_csv(frames: list[DataFrame], path: str) -> None:
    """Rows of different columns under the union of their headers."""
    functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(cells, frames)).write.mode("overwrite").csv(path, header=True, escape='"')


def flattened(rows: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns whose names join the path; arrays and maps as JSON."""
    out = []

    def walk(column: Column, dtype: T.DataType, name: str) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(column[f.name], f.dataType, f"{name}{separator}{f.name}" if name else f.name)
        else:
            out.append((F.to_json(column) if isinstance(dtype, (T.ArrayType, T.MapType)) else column).alias(name))

    for f in rows.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return rows.select(*out)


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def not_yet(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key a checkpoint or cache lacks."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A long CSV of (entity_type, name, prop_key, prop_value) as one row per entity with a map of its properties, the first value of each key."""
    raw = spark.read.csv(path, header=True).withColumn("n", F.monotonically_increasing_id())
    first = raw.where("prop_key IS NOT NULL").groupBy("entity_type", "name", "prop_key").agg(F.min_by("prop_value", "n").alias("v"), F.min("n").alias("n"))
    props = first.groupBy("entity_type", "name").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("n", "prop_key", "v"))), lambda x: F.struct(x["prop_key"], x["v"]))).alias("properties"))
    return raw.groupBy("entity_type", "name").agg(F.min("n").alias("seed_order")).join(props, ["entity_type", "name"], "left")


def rules(path: str) -> dict:
    """A YAML file of rules (a JSON file is one too)."""
    try:
        import yaml
    except ImportError:
        import json

        with open(path, encoding="utf-8") as f:
            return json.load(f)
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """The text layer of PDF files, page by page; needs a PDF library on the workers."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf, which is not installed") from e

    def kernel(batches):
        import io

        import pandas as pd
        import pypdf

        for b in batches:
            rows = [(p, i + 1, page.extract_text() or "") for p, c in zip(b["path"], b["content"]) for i, page in enumerate(pypdf.PdfReader(io.BytesIO(c)).pages)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "raw_ocr_text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(kernel, "path string, page_number int, raw_ocr_text string")
