"""Sinks and registries over files: a graph of node and edge tables, a warehouse of versioned tables, a registry of corpora,
append-only lines.

Tables are folders of Parquet files. A write makes a new version beside the old one and then names it in one small file,
so that a reader sees the old table or the new one, never half of one, and a write that dies leaves the old one as it was.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlore.plans.graph import Graph
from fieldlore.plans.ingest import safe_id

# -- files, wherever the session's file system keeps them -----------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if it is not there."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one step: written beside its place, then moved there."""
    p, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{path} could not be written")


# -- warehouse (S17) -----------------------------------------------------------------------------------------------------


class Warehouse:
    """Named tables in a folder, each with the version that is current, and migrations that ran once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str) -> str:
        return f"{self.root}/{safe_id(name)}"

    def version(self, name: str) -> str | None:
        return read_text(self.spark, f"{self._folder(name)}/CURRENT")

    def exists(self, name: str) -> bool:
        return self.version(name) is not None

    def read(self, name: str) -> DataFrame:
        if (v := self.version(name)) is None:
            raise KeyError(f"no table {name!r}")
        return self.spark.read.parquet(f"{self._folder(name)}/{v}")

    def write(self, name: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        """Replace a table. Rows may be read from the table itself: the old version stays until the new one is named."""
        old, new = self.version(name), uuid.uuid4().hex
        rows.write.partitionBy(*partition_by).parquet(f"{self._folder(name)}/{new}")
        write_text(self.spark, f"{self._folder(name)}/CURRENT", new)
        if old:
            p, fs = _path(self.spark, f"{self._folder(name)}/{old}")
            fs.delete(p, True)

    def append(self, name: str, rows: DataFrame) -> None:
        if (v := self.version(name)) is None:
            self.write(name, rows)
        else:
            rows.write.mode("append").parquet(f"{self._folder(name)}/{v}")

    def upsert(self, name: str, rows: DataFrame, key: str) -> None:
        """Rows replace stored ones of the same key."""
        if self.exists(name):
            kept = self.read(name).join(rows.select(key), key, "left_anti")
            rows = kept.unionByName(rows, allowMissingColumns=True)
        self.write(name, rows)

    def migrate(self, migrations: Iterable[tuple[str, Callable[[Warehouse], None]]]) -> list[str]:
        """Run the migrations that have not run yet, in order, and return their names."""
        known = json.loads(read_text(self.spark, f"{self.root}/MIGRATIONS") or "[]")
        ran = []
        for name, step in migrations:
            if name not in known:
                step(self)
                known.append(name)
                # after each: one that fails does not undo those before it
                write_text(self.spark, f"{self.root}/MIGRATIONS", json.dumps(known))
                ran.append(name)
        return ran


# -- graph sink (S13, S14) ------------------------------------------------------------------------------------------------


def merged(old: DataFrame | None, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Properties of new rows over those of old ones with the same keys; a property that a new row lacks stays."""
    if old is None:
        return new.dropDuplicates(list(keys))
    a, b = old.dropDuplicates(list(keys)), new.dropDuplicates(list(keys))
    rest = [c for c in dict.fromkeys([*a.columns, *b.columns]) if c not in keys]
    joined = a.withColumns({f"_a_{c}": F.col(c) for c in rest if c in a.columns}).select(*keys, *[f"_a_{c}" for c in rest if c in a.columns]).join(b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in rest if c in b.columns]), list(keys), "full")
    value = lambda c: F.coalesce(*[F.col(f"_{s}_{c}") for s, df in (("b", b), ("a", a)) if c in df.columns]).alias(c)
    return joined.select(*keys, *map(value, rest))


class GraphSink:
    """Nodes by label and edges by relation, merged into the tables of a warehouse. Writing the same rows twice
    changes nothing."""

    def __init__(self, warehouse: Warehouse):
        self.warehouse = warehouse

    def nodes(self, label: str, rows: DataFrame, key: str) -> None:
        name = f"node.{label}"
        old = self.warehouse.read(name) if self.warehouse.exists(name) else None
        self.warehouse.write(name, merged(old, rows.where(F.col(key).isNotNull()), (key,)))

    def edges(self, relation: str, rows: DataFrame, source: str, target: str) -> None:
        name = f"edge.{relation}"
        old = self.warehouse.read(name) if self.warehouse.exists(name) else None
        self.warehouse.write(name, merged(old, rows.where(F.col(source).isNotNull() & F.col(target).isNotNull()), (source, target)))

    def graph(self, g: Graph) -> None:
        """All nodes and edges of a graph, one pass for each table."""
        for label, rows, key in (("Document", g.docs, "doc_id"), ("ExtractionRun", g.runs, "run_id"), ("Claim", g.claims, "claim_id"), ("Measurement", g.measurements, "measurement_id"), ("Entity", g.entities, "entity_id"), ("Observation", g.observations, "observation_id")):
            self.nodes(label, rows, key)
        self.edges("PROCESSED_BY", g.runs.select("doc_id", "run_id"), "doc_id", "run_id")
        self.edges("PRODUCED", g.claims.select("run_id", "claim_id"), "run_id", "claim_id")
        self.edges("HAS_MEASUREMENT", g.measurements.select("claim_id", "measurement_id"), "claim_id", "measurement_id")
        # one table for all relations of claims, read by the one that is asked for
        self.warehouse.write("edge.CLAIM_ENTITY", g.edges.select("claim_id", "entity_id", "relation_type"), ("relation_type",))


# -- saved searches (Q11) ----------------------------------------------------------------------------------------------------


class SavedSearches:
    """Q11: searches that users keep, by user and name: the newest of a name counts; another user's are out of reach."""

    TABLE = "saved_searches"
    SCHEMA = "user_id string, name string, query string, saved_at timestamp, deleted boolean"

    def __init__(self, warehouse: Warehouse):
        self.warehouse = warehouse

    def _put(self, user: str, name: str, query: str | None, deleted: bool) -> None:
        spark = self.warehouse.spark
        rows = spark.createDataFrame([(user, name, query, None, deleted)], self.SCHEMA).withColumn("saved_at", F.current_timestamp())
        self.warehouse.append(self.TABLE, rows)

    def save(self, user: str, name: str, query: str) -> None:
        self._put(user, name, query, False)

    def delete(self, user: str, name: str) -> bool:
        """Whether there was one to delete."""
        there = self.of(user).where(F.col("name") == name).limit(1).count() > 0
        if there:
            self._put(user, name, None, True)
        return there

    def of(self, user: str) -> DataFrame:
        """name, query and saved_at of a user's searches."""
        if not self.warehouse.exists(self.TABLE):
            return self.warehouse.spark.createDataFrame([], "name string, query string, saved_at timestamp")
        own = self.warehouse.read(self.TABLE).where(F.col("user_id") == user)
        last = own.groupBy("name").agg(F.max_by(F.struct("query", "saved_at", "deleted"), "saved_at").alias("x"))
        return last.where("NOT x.deleted").select("name", "x.query", "x.saved_at")


# -- queries by text and by name (S15, S16) ---------------------------------------------------------------------------------


def connected(warehouse: Warehouse, tables: Iterable[str]) -> Callable[..., DataFrame]:
    """run(text, **parameters) over the tables, whose dots are underscores; parameters never become part of the text."""
    for name in tables:
        warehouse.read(name).createOrReplaceTempView(re.sub(r"\W", "_", name))
    return lambda text, **parameters: warehouse.spark.sql(text, args=parameters)


class Templates:
    """Plans by name. One that is not there says which are."""

    def __init__(self, known: dict[str, Callable[..., DataFrame]] | None = None):
        self.known = dict(known or {})

    def register(self, name: str, plan: Callable[..., DataFrame]) -> None:
        if name in self.known:
            raise ValueError(f"template {name!r} is there already")
        self.known[name] = plan

    def run(self, name: str, *args, **parameters) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"no template {name!r}: {', '.join(sorted(self.known))}")
        return self.known[name](*args, **parameters)


# -- corpora (S20) ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Corpus:
    corpus_id: str
    display_name: str
    resources: str
    description: str = ""
    institutions: tuple[str, ...] = ()
    is_default: bool = False


class CorpusRegistry:
    """The corpora of an installation, in one small file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def all(self) -> list[Corpus]:
        return [Corpus(**c | {"institutions": tuple(c.get("institutions", ()))}) for c in json.loads(read_text(self.spark, self.path) or "[]")]

    def _save(self, corpora: list[Corpus]) -> None:
        write_text(self.spark, self.path, json.dumps([asdict(c) for c in corpora], indent=1))

    def get(self, corpus_id: str) -> Corpus:
        for c in self.all():
            if c.corpus_id == corpus_id:
                return c
        raise KeyError(f"no corpus {corpus_id!r}")

    def default(self) -> Corpus:
        """The one marked, else the first."""
        corpora = self.all()
        if not corpora:
            raise KeyError("no corpus")
        return next((c for c in corpora if c.is_default), corpora[0])

    def register(self, corpus: Corpus) -> None:
        safe_id(corpus.corpus_id)
        corpora = self.all()
        if any(c.corpus_id == corpus.corpus_id for c in corpora):
            raise ValueError(f"corpus {corpus.corpus_id!r} is there already")
        self._save([*corpora, corpus])

    def set_default(self, corpus_id: str) -> None:
        self.get(corpus_id)
        self._save([replace(c, is_default=c.corpus_id == corpus_id) for c in self.all()])


# -- lines (S19, S22) ---------------------------------------------------------------------------------------------------------


def append_lines(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines added to a folder; ``files.lines`` reads them and skips broken ones."""
    rows.write.mode("append").json(folder)


# -- exports of the review (S18) --------------------------------------------------------------------------------------------------


def accepted_patches(proposals: DataFrame, revisions: DataFrame) -> DataFrame:
    """The newest patch of each proposal that is accepted and waits; proposals without a revision have none."""
    newest = revisions.groupBy("proposal_id").agg(F.max_by("patch", F.struct("revision_number")).alias("patch_spec"))
    return proposals.where("status = 'accepted_pending_apply'").join(newest, "proposal_id").select("proposal_id", "issue_class", "proposal_type", "patch_spec", "confidence", "priority_score")


def revision_history(proposals: DataFrame, revisions: DataFrame, events: DataFrame) -> DataFrame:
    """Each proposal with its revisions and its correction events, both in order."""
    r = revisions.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("revision_number", "revision_kind", "patch"))).alias("revisions"))
    e = events.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "event_id", "action"))).alias("correction_events"))
    return proposals.join(r, "proposal_id", "left").join(e, "proposal_id", "left")


# -- queries -----------------------------------------------------------------------------------------------------------------


def _written(spark: SparkSession, d: str) -> tuple[Warehouse, Graph]:
    from fieldlore.session import scratch

    g = Graph(spark, d)
    w = Warehouse(spark, scratch(spark, "warehouse"))
    GraphSink(w).graph(g)
    return w, g


TABLES = ("node.Document", "node.ExtractionRun", "node.Claim", "node.Measurement", "node.Entity", "node.Observation", "edge.PROCESSED_BY", "edge.PRODUCED", "edge.HAS_MEASUREMENT", "edge.CLAIM_ENTITY")


def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    """The graph written and read back: rows of each table."""
    w, _ = _written(spark, d)
    counts = [w.read(t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def connector_query(spark: SparkSession, d: str) -> DataFrame:
    """A template that runs a text with parameters over the written graph."""
    w, _ = _written(spark, d)
    run = connected(w, TABLES)
    text = "SELECT e.relation_type, count(*) AS links FROM edge_CLAIM_ENTITY e JOIN node_Claim c USING (claim_id) WHERE c.claim_type = :kind GROUP BY e.relation_type"
    return Templates({"links_of": lambda kind: run(text, kind=kind)}).run("links_of", kind="fire_incident")


QUERIES = {"s14_graph_counts": graph_counts, "s15_connector": connector_query}
from fieldlore.plans.retrieval import _WITH  # noqa: E402

ORACLES = {
    "s14_graph_counts": _WITH + "SELECT 'node.Document' AS table_name, (SELECT count(DISTINCT doc_id) FROM docs) AS rows UNION ALL SELECT 'node.ExtractionRun', (SELECT count(DISTINCT run_id) FROM runs) UNION ALL SELECT 'node.Claim', (SELECT count(DISTINCT claim_id) FROM claim) UNION ALL SELECT 'node.Measurement', (SELECT count(DISTINCT measurement_id) FROM meas) UNION ALL SELECT 'node.Entity', (SELECT count(DISTINCT entity_id) FROM entity) UNION ALL SELECT 'node.Observation', (SELECT count(*) FROM obs) UNION ALL SELECT 'edge.PROCESSED_BY', (SELECT count(*) FROM (SELECT DISTINCT doc_id, run_id FROM runs)) UNION ALL SELECT 'edge.PRODUCED', (SELECT count(*) FROM (SELECT DISTINCT run_id, claim_id FROM claim)) UNION ALL SELECT 'edge.HAS_MEASUREMENT', (SELECT count(*) FROM (SELECT DISTINCT claim_id, measurement_id FROM meas)) UNION ALL SELECT 'edge.CLAIM_ENTITY', (SELECT count(*) FROM edge)",
    "s15_connector": _WITH + "SELECT relation_type, count(*) AS links FROM edge JOIN claim USING (claim_id) WHERE claim_type = 'fire_incident' GROUP BY 1",
}
