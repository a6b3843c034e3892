"""Attribute-value rows into wide tables.

The read values of an entity are collected into an array sorted by attribute position, the positions of its type's
grid that have none are added as empty cells, and fixed indices of that array are projected through casts by type.
The grid is completed inside the array and not by a join of rows, so rows are shuffled once, by entity.

Defined results: null or blank keys and keys that are no wanted attribute are ignored; a value that says that
nothing is known, or cannot be read as the attribute's type, counts as missing; of several readable values the
first in file order wins (a list keeps all, each once, in file order); an entity without any readable value is
one row of nulls; rows without entity_type or name are dropped, as they have no entity; an empty table gives an
empty table with all columns. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say that nothing is known (fixed values, compared in lower case without outer spaces).
NOTHING = ("", "-", "--", "?", "n/a", "na", "n.a.", "none", "none given", "nil", "null", "nan", "unknown", "unk", "unk.", "not known", "not given", "not recorded", "tbd", "t.b.d.", "see card", "missing", "no data")
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
#: Attribute tables above this size are no table schema.
MOST_COLUMNS = 2000
SQL_TYPES = {"string": "string", "int": "int", "double": "double", "boolean": "boolean", "date": "date", "string list": "array<string>"}


def normal_key(key: Column) -> Column:
    """snake_case of a key however it is written: 'Tenure Start:', 'tenureStart' and ' TENURE-START' agree."""
    own = F.trim(key)
    spaced = F.regexp_replace(own, r"([a-z0-9])([A-Z])", "$1_$2")
    # most keys are written so and need one match only; \z is the very end, $ also stands before a last line break
    return F.when(own.rlike(r"^[a-z0-9]++(?:_[a-z0-9]++)*+\z"), own).otherwise(F.btrim(F.regexp_replace(F.lower(spaced), r"[^\p{L}\p{N}]+", "_"), F.lit("_")))


def plain_number(text: Column) -> Column:
    """'1,234.5', '$12', '99,41' and '+1944' as text that casts to a double; other texts as they are."""
    t = F.regexp_replace(text, r"^([+-]?)\s*[$€£]\s*|\s*(?:USD|usd|dollars?)$", "$1")
    return F.regexp_replace(F.regexp_replace(t, r",(?=\d{3}(?:[,.]|$))", ""), r"^([+-]?\d+),(\d{1,2})$", "$1.$2")


def read_date(text: Column) -> Column:
    forms = [
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"), (r"^[A-Za-z]{4,9} \d{1,2}, ?\d{4}$", "MMMM d, yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^[A-Za-z]{3} \d{1,2}, ?\d{4}$", "MMM d, yyyy"),
    ]
    return F.coalesce(*[F.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(form)).cast("date")) for pattern, form in forms])


def with_reading(rows: DataFrame) -> DataFrame:
    """Adds value: prop_value as text that casts to its value_type, or null if it has no readable value.

    The steps are columns of their own, so that no expression is written out again inside the next.
    """
    v = F.col("_v")
    kind, number, date = F.col("value_type"), F.col("_number"), F.col("_date")
    return (
        rows.withColumn("_v", F.trim(F.regexp_replace("prop_value", r"[\s\u00a0]+", " ")))
        .withColumn("_low", F.lower("_v"))
        .withColumn("_v", F.when(~F.col("_low").isin(*NOTHING), v))
        .withColumn("_plain", F.when(kind.isin("int", "double"), F.when(v.rlike(r"^[+-]?\d++(?:\.\d++)?\z"), v).otherwise(plain_number(v))))
        .withColumn("_number", F.when(F.col("_plain").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.col("_plain").try_cast("double")))
        .withColumn("_date", F.when(kind == "date", F.regexp_replace(F.initcap(v), r",(?=\d)", ", ")))
        .withColumn("_date", read_date(date))
        .withColumn(
            "value",
            F.when(kind.isin("string", "string list"), v)
            .when((kind == "int") & (number == F.floor(number)) & (F.abs(number) <= 2147483647), number.cast("bigint").cast("string"))
            .when(kind == "double", number.cast("string"))
            .when((kind == "boolean") & v.isNotNull(), F.when(F.col("_low").isin(*TRUE), "true").when(F.col("_low").isin(*FALSE), "false"))
            .when(kind == "date", date.cast("string")),
        )
        .drop("_v", "_low", "_plain", "_number", "_date")
    )


def readable_cells(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per entity and readable value: entity_type, name, position, value, seed_row (of its first writing), and
    for each entity with rows without one a row whose position and value are null.

    Rows without a reading stay: a filter on the value would be moved into the join with all steps of the reading
    written out in it, each as often as a later one refers to it.
    """
    keyed = rows.where("entity_type IS NOT NULL AND name IS NOT NULL").select("entity_type", "name", "seed_row", "prop_value", normal_key(F.col("prop_key")).alias("_key"))
    read = with_reading(keyed.join(wanted, ["entity_type", "_key"], "left")).withColumn("position", F.when(F.col("value").isNotNull(), F.col("position")))
    # one shuffle, by entity, in which repeated facts melt before they are gathered: no entity gathers more than its distinct values
    return read.repartition("entity_type", "name").groupBy("entity_type", "name", "position", "value").agg(F.min("seed_row").alias("seed_row"))


def wide(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """entity_type, name and a typed column for each attribute (attributes that types share have one column)."""
    schema = sorted((r.entity_type, r.attribute, r.value_type) for r in attributes.select("entity_type", "attribute", "value_type").distinct().limit(MOST_COLUMNS + 1).collect())
    if len(schema) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} attributes are no table schema")
    places: dict[str, list[str]] = {}
    kinds: dict[str, str] = {}
    for entity_type, attribute, value_type in schema:
        if attribute not in places.setdefault(entity_type, []):
            places[entity_type].append(attribute)
        kinds[attribute] = value_type if kinds.get(attribute, value_type) == value_type else "string"
    if not places:
        return rows.where("entity_type IS NOT NULL AND name IS NOT NULL").select("entity_type", "name").distinct()
    wanted = rows.sparkSession.createDataFrame([(t, a, k, places[t].index(a)) for t, a, k in schema], "entity_type string, attribute string, value_type string, position int")
    wanted = F.broadcast(wanted.select("entity_type", normal_key(F.col("attribute")).alias("_key"), "value_type", "position"))
    cells = readable_cells(rows, wanted).groupBy("entity_type", "name").agg(F.sort_array(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "seed_row", "value")))).alias("cells"))
    # the grid: the first cell of each position, and an empty one for each position of the type that has none
    grid = F.try_element_at(F.create_map(*[x for t, names in places.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in range(len(names))]))]), F.col("entity_type"))
    first = F.filter("cells", lambda c, i: (i == 0) | (c["position"] != F.get("cells", i - 1)["position"]))
    empty = F.transform(F.array_except(grid, F.col("cells.position")), lambda at: F.struct(at.alias("position"), F.lit(None).cast("bigint").alias("seed_row"), F.lit(None).cast("string").alias("value")))
    arrays = cells.withColumn("grid", F.sort_array(F.concat(first, empty)))

    def all_at(at: int) -> Column:
        return F.filter("cells", lambda c: c["position"] == at)["value"]

    columns = []
    for attribute, kind in kinds.items():
        own = [(t, names.index(attribute)) for t, names in places.items() if attribute in names]
        if kind == "string list":
            listed = F.coalesce(*[F.when(F.col("entity_type") == t, all_at(at)) for t, at in own])
            columns.append(F.when(F.size(listed) > 0, listed).alias(attribute))
        else:
            columns.append(F.coalesce(*[F.when(F.col("entity_type") == t, F.get("grid", F.lit(at))) for t, at in own])["value"].try_cast(SQL_TYPES[kind]).alias(attribute))
    return arrays.select("entity_type", "name", *columns)


def filled(wide_rows: DataFrame) -> DataFrame:
    """The filled cells of a wide table as entity_type, name, attribute."""
    names = [c for c in wide_rows.columns if c not in ("entity_type", "name")]
    return wide_rows.select("entity_type", "name", F.explode(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names]), lambda a: a.isNotNull())).alias("attribute"))
