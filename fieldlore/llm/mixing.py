"""Mixing sources to target shares of tokens.

Token sums by source, language and topic are raked (iterative proportional fitting) to the target shares of the
sources and to the corpus' own shares of languages and topics, without any cell going beyond its source's cap. The
raked weight of a cell over its tokens is the expected number of uses of its documents: the whole part is given to
all of them, the rest is a calibrated probability. A document's uniform number comes from a hash of its id, and the
scale of the probabilities is set by source on a histogram of the numbers, so that the chosen tokens meet the
source's share.

Only the cell sums (sources x languages x topics) and the histogram (sources x BINS) reach the driver; both are
bounded whatever the number of documents.

Defined results: rows with null source, of a source that is no target, or without tokens are not chosen; a source
without documents has share 0 and the others keep their shares of the rest; a document id given twice counts as two
records; a null language is 'und'; an empty table gives an empty mixture.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlore.llm.tokenizer import default_path, encoder

BINS = 4096
ROUNDS = 200
#: Topics by word (fixed values of this operator); the topic with the most words wins, ties go to the earlier.
TOPICS = {"birds": r"\b(?:teals?|ducks?|swans?|geese|goose|coots?|herons?|nests?|brood|banded|bitterns?|pheasants?|mallards?|pintails?)\b", "water": r"\b(?:water|gauge|dike|rain|rainfall|snow|ice|flow|dam|level)\b", "land": r"\b(?:acres?|fence|hay|haying|grazing|burned|fire|seed|timber|posts?|ditch)\b", "people": r"\b(?:visitors|permit|letters?|office|members|association|club|school|observer)\b"}


def measured(documents: DataFrame, path: str | None = None, topics: dict[str, str] = TOPICS) -> DataFrame:
    """doc_id, source, language, topic and tokens of every row; topics are patterns of their words."""
    path = path or default_path()
    lang = F.lower(F.trim("lang"))
    counts = [F.regexp_count(F.lower("text"), F.lit(p)).alias(t) for t, p in topics.items()]
    base = documents.select("doc_id", "source", F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("und").alias("language"), "text", *counts)
    most = F.greatest(*topics, F.lit(0), F.lit(0))
    topic = F.when(most.isNull() | (most == 0), "other")
    for t in topics:
        topic = topic.when(F.col(t) == most, t)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            b["tokens"] = [len(e.encode(t if isinstance(t, str) else None)) for t in b["text"]]
            yield b.drop(columns="text")

    rows = base.select("doc_id", "source", "language", topic.alias("topic"), "text")
    return rows.mapInPandas(kernel, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, language string, topic string, tokens bigint")


def rake(cells: pd.DataFrame, targets: dict[str, float], caps: dict[str, float], rounds: int = ROUNDS) -> pd.DataFrame:
    """cells (source, language, topic, tokens) with uses: the raked number of uses of each cell's documents. The frame's
    attrs tell the rounds taken, whether they converged, and the largest distance of a marginal from its goal, as a share."""
    cells = cells.reset_index(drop=True)
    size = cells["tokens"].to_numpy(float)
    by = cells.groupby("source")["tokens"].sum()
    live = {s: targets[s] for s in by.index if targets.get(s, 0) > 0}
    if not live or not len(cells):
        out = cells.assign(uses=0.0)
        out.attrs.update(rounds=0, converged=True, off={})
        return out
    whole = sum(live.values())
    share = cells["source"].map(live).fillna(0.0).to_numpy() / whole
    cap = cells["source"].map(caps).fillna(0.0).to_numpy(float)
    total = min(caps[s] * by[s] / (t / whole) for s, t in live.items())
    groups = {d: [np.flatnonzero((cells[d] == v).to_numpy()) for v in sorted(cells[d].unique())] for d in ("source", "language", "topic")}
    goal = {"source": [total * share[g[0]] for g in groups["source"]]}
    natural = np.where(share > 0, size, 0)
    for d in ("language", "topic"):
        goal[d] = [total * natural[g].sum() / natural.sum() for g in groups[d]]
    w = np.where(share > 0, size, 0.0)

    def meet_sources() -> None:
        """Scale within each source up to its goal; what a capped cell can't take goes to the others."""
        for g, want in zip(groups["source"], goal["source"]):
            most, free = cap[g] * size[g], np.ones(len(g), bool)
            for _ in range(len(g) + 1):
                left = want - most[~free].sum()
                held = w[g][free].sum()
                if held <= 0:
                    break
                scaled = np.where(free, w[g] * left / held, most)
                over = free & (scaled > most * (1 + 1e-12))
                w[g] = np.minimum(scaled, most)
                if not over.any():
                    break
                free &= ~over

    meet_sources()
    converged, done = False, 0
    for done in range(1, rounds + 1):
        before = w.copy()
        for d in ("topic", "language"):
            for g, want in zip(groups[d], goal[d]):
                if (held := w[g].sum()) > 0:
                    w[g] *= want / held
        w[:] = np.minimum(w, cap * size)
        meet_sources()
        if np.abs(w - before).max() <= 1e-9 * max(total, 1):
            converged = True
            break
    out = cells.assign(uses=np.where(size > 0, w / np.maximum(size, 1), 0.0))
    off = {d: max(abs(w[g].sum() - want) for g, want in zip(groups[d], goal[d])) / max(total, 1) for d in groups}
    out.attrs.update(rounds=done, converged=converged, off=off)
    return out


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 42) -> DataFrame:
    """The chosen documents: doc_id, source, language, topic, tokens, repeats."""
    spark = documents.sparkSession
    wanted = {r.source: (r.target_share, r.max_repeats) for r in targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(10_001).collect()}
    if len(wanted) > 10_000:
        raise ValueError("more than 10,000 sources have no common mixture")
    from fieldlore.session import cut

    # ids are counted once: the sizes are written before they are used three times
    sized = cut(measured(documents, path).where(F.col("tokens") > 0).where(F.col("source").isin(list(wanted))))
    cells = sized.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens")).toPandas().sort_values(["source", "language", "topic"])
    raked = rake(cells, {s: t for s, (t, _) in wanted.items()}, {s: float(m) for s, (_, m) in wanted.items()})
    schema = "source string, language string, topic string, uses double"
    uses = spark.createDataFrame([(r.source, r.language, r.topic, float(r.uses)) for r in raked.itertuples()], schema)
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)).cast("double") + 0.5) / (1 << 30)
    rows = sized.join(F.broadcast(uses), ["source", "language", "topic"]).withColumn("whole", F.floor(F.col("uses") + 1e-9).cast("int")).withColumn("part", F.greatest(F.lit(0.0), F.col("uses") - F.col("whole")))
    # a document is chosen once more if its number over its probability is at most the scale of its source, which is near 1
    rows = rows.withColumn("at", F.when(F.col("part") > 1e-9, F.least(unit / F.col("part"), F.lit(4.0)))).withColumn("bin", F.floor(F.col("at") * (BINS / 4)).cast("int"))
    sums = rows.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("whole")).alias("given"), F.sum(F.col("tokens") * F.col("uses")).alias("goal")).toPandas()
    limits = []
    for source, g in sums.groupby("source"):
        need = g["goal"].sum() - g["given"].sum()
        bins = g.dropna(subset="bin").sort_values("bin")
        reached = np.concatenate([[0.0], bins["tokens"].cumsum().to_numpy(float)])
        k = int(np.argmin(np.abs(reached - need)))
        limits.append((source, int(bins["bin"].iloc[k - 1]) if k else -1))
    scale = spark.createDataFrame(limits, "source string, last_bin int")
    chosen = rows.join(F.broadcast(scale), "source").withColumn("repeats", F.col("whole") + F.coalesce((F.col("bin") <= F.col("last_bin")).cast("int"), F.lit(0)))
    return chosen.where("repeats > 0").select("doc_id", "source", "language", "topic", "tokens", "repeats")


def marginals(documents: DataFrame, mixture: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """dimension, value, goal_share and actual_share of the mixture: of sources their targets, of languages and topics the
    shares of the tokens of the mixed sources' documents. Caps may keep a mixture from all goals at once; sources come first."""
    wanted = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target"))
    cells = measured(documents, path).where(F.col("tokens") > 0).groupBy("source", "language", "topic").agg(F.sum("tokens").alias("natural"))
    given = mixture.groupBy("source", "language", "topic").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed"))
    rows = cells.join(F.broadcast(wanted), "source").join(given, ["source", "language", "topic"], "left").fillna(0, ["mixed"])
    long = rows.select("natural", "mixed", "target", "source", F.explode(F.map_from_arrays(F.array(F.lit("source"), F.lit("language"), F.lit("topic")), F.array("source", "language", "topic"))).alias("dimension", "value"))
    by = long.groupBy("dimension", "value").agg(F.sum("natural").alias("natural"), F.sum("mixed").alias("mixed"), F.max("target").alias("target"))
    total = by.groupBy("dimension").agg(F.sum("natural").alias("all_natural"), F.sum("mixed").alias("all_mixed"), F.sum("target").alias("all_target"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return by.join(F.broadcast(total), "dimension").select("dimension", "value", F.when(F.col("dimension") == "source", share("target", "all_target")).otherwise(share("natural", "all_natural")).alias("goal_share"), share("mixed", "all_mixed").alias("actual_share"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens and documents of the mixture."""
    by = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("doc_id").alias("documents"))
    total = by.agg(F.sum("tokens").alias("total"))
    return targets.select("source", "target_share").join(F.broadcast(by), "source", "left").join(F.broadcast(total)).select("source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
