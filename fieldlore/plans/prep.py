"""Queries of the data preparation operators that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlore.operators import eav, units
from fieldlore.session import cut, table


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    return eav.wide(table(spark, d, "seed_entities"), table(spark, d, "seed_attributes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return eav.filled(p2_wide(spark, d))


def _converted(spark: SparkSession, d: str) -> DataFrame:
    return units.to_common_units(table(spark, d, "measurements"), table(spark, d, "claims"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _converted(spark, d).where("changed").select("measurement_id")


def p3_common(spark: SparkSession, d: str) -> DataFrame:
    common = table(spark, d, "measure_units").select("name", "common_unit").dropDuplicates(["name"])
    return _converted(spark, d).join(F.broadcast(common.limit(10_000)) if common.count() <= 10_000 else common, "name", "left").select("measurement_id", "name", "basis", "common_value", "common_lower", "common_upper", "common_unit", "changed")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "document_records").groupBy("doc_id").agg(F.max("series").alias("source"))
    return table(spark, d, "extraction_runs").select("run_id", "doc_id").dropDuplicates(["run_id"]).join(docs, "doc_id").select("run_id", "source")


def p3_shifts(spark: SparkSession, d: str) -> DataFrame:
    return units.unit_shifts(_converted(spark, d), _sources(spark, d))


def p3_reversed(spark: SparkSession, d: str) -> DataFrame:
    converted, sources = cut(_converted(spark, d).where("basis IS NULL")), _sources(spark, d)
    return units.reverse_shifts(converted, sources, units.unit_shifts(converted, sources))


QUERIES = {"p2_found": p2_found, "p2_wide": p2_wide, "p3_found": p3_found, "p3_common": p3_common, "p3_shifts": p3_shifts, "p3_reversed": p3_reversed}
_KEY = r"regexp_replace(regexp_replace(lower(regexp_replace(trim({}), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(v, '^([+-]?)\s*[$€£]\s*', '\1'), '^([+-]?\d{1,3}),(\d{3})', '\1\2'), '^([+-]?\d+),(\d{1,2})$', '\1.\2')"
_DATES = " OR ".join(f"try_strptime(regexp_replace(v, ',(\\d)', ', \\1'), '{f}') IS NOT NULL" for f in ("%Y-%m-%d", "%Y%m%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y", "%d %B %Y", "%B %d, %Y"))
ORACLES = {
    "p2_found": f"""SELECT DISTINCT entity_type, name, attribute FROM (SELECT e.entity_type, e.name, a.attribute, a.value_type, trim(regexp_replace(prop_value, '[\\s\u00a0]+', ' ', 'g')) AS v FROM seed_entities e JOIN seed_attributes a ON a.entity_type = e.entity_type AND {_KEY.format('a.attribute')} = {_KEY.format('e.prop_key')})
WHERE v IS NOT NULL AND lower(v) NOT IN {eav.NOTHING} AND CASE value_type WHEN 'int' THEN try_cast({_PLAIN} AS double) = floor(try_cast({_PLAIN} AS double)) WHEN 'double' THEN try_cast({_PLAIN} AS double) IS NOT NULL WHEN 'boolean' THEN lower(v) IN {eav.TRUE + eav.FALSE} WHEN 'date' THEN {_DATES} ELSE true END""",
}
