"""Mentions to entities by the similarity of names.

Distinct forms meet the vocabulary in blocks of bounded size, sent once and never with a form; inside a block a bound on
the matching characters, computed for all names at once, leaves few pairs for the exact measure. Scores, preferences, priors and the choice of
the best candidate are columns and windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlore.functions.text import similarity, subsequence_with

REFERS, MAYBE, GAP, TOGETHER = 0.85, 0.65, 0.05, 0.03
BOOSTS, ABSENT = (0.05, 0.03, 0.01), -0.02
BLOCK = 2000
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 -"


def _counts(names: list[str]) -> np.ndarray:
    out = np.zeros((len(names), len(ALPHABET) + 1), np.int16)
    place = {c: i for i, c in enumerate(ALPHABET)}
    for row, name in zip(out, names):
        for c in name:
            row[place.get(c, len(ALPHABET))] += 1
    return out


class Block:
    """Names with their letters counted, compared with one form at a time."""

    def __init__(self, names: list[str]):
        self.names, self.counts = names, _counts(names)
        self.sizes, self.words = np.array([len(n) for n in names]), [set(n.split()) for n in names]
        self.by_word: dict[str, list[int]] = {}
        for i, ws in enumerate(self.words):
            for w in ws:
                self.by_word.setdefault(w, []).append(i)

    def similar(self, form: str, least: float) -> list[tuple[str, str, float]]:
        own, size = _counts([form])[0], len(form)
        # twice the common characters over both lengths bounds the ratio from above
        near = np.minimum(self.counts, own).sum(axis=1)
        bound = 2.0 * near / np.maximum(self.sizes + size, 1)
        longest = subsequence_with(form)
        # matching blocks are a common subsequence, so that the longest one bounds the ratio more closely
        wanted = {i for i in np.flatnonzero(bound >= least - 1e-4).tolist() if 2.0 * longest(self.names[i]) >= (least - 1e-4) * (size + len(self.names[i]))}
        # below the bounds only common words, or one being a part of the other, can reach the threshold
        words = set(form.split())
        shared = Counter(i for w in words for i in self.by_word.get(w, ()))
        wanted.update(i for i, n in shared.items() if n >= (least - 1e-4) * max(len(words), len(self.words[i])))
        wanted.update(i for i in np.flatnonzero(near >= np.minimum(self.sizes, size)).tolist() if form in self.names[i] or self.names[i] in form)
        return [(form, self.names[i], s) for i in sorted(wanted) if (s := similarity(form, self.names[i])) >= least]


#: Parts into which the forms are cut for each block of a vocabulary that no worker holds whole.
PARTS = 16
PAIRS = "form string, name_form string, score double"


def similar(forms: DataFrame, names: DataFrame, least: float = MAYBE) -> DataFrame:
    """Form, name_form, score of all pairs at or above the threshold; forms(form) and names(name_form). Up to
    BROADCAST_ROWS names go to every worker once; beyond it forms and names meet in groups of one block of names (BLOCK of
    them) and one part of the forms, each name sent once for a group and never with a form."""
    from fieldlore import session

    distinct = names.select("name_form").where("name_form IS NOT NULL").distinct()
    asked = forms.select("form").where("form IS NOT NULL").distinct()
    if (n := distinct.count()) <= session.BROADCAST_ROWS:
        every = forms.sparkSession.sparkContext.broadcast(sorted(r.name_form for r in distinct.toLocalIterator()))

        def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            blocks = [Block(every.value[i : i + BLOCK]) for i in range(0, len(every.value), BLOCK)]
            for b in batches:
                yield pd.DataFrame([r for form in b["form"] for block in blocks for r in block.similar(form, least)], columns=["form", "name_form", "score"])

        # few forms are many comparisons: they are spread over all tasks
        return asked.repartition(int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")), "form").mapInPandas(kernel, PAIRS)
    blocks = -(-n // BLOCK)
    parts = PARTS * max(1, asked.count() // 1_000_000)
    left = asked.withColumn("part", F.pmod(F.xxhash64("form"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = distinct.withColumn("block", F.pmod(F.xxhash64("name_form"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def group(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        block = Block(sorted(b["name_form"]))
        return pd.DataFrame([r for form in a["form"] for r in block.similar(form, least)] if len(b) else [], columns=["form", "name_form", "score"])

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(group, PAIRS)


def adjustment(entity_type: Column, claim_types: Column, preferred: dict[str, tuple[str, ...]]) -> Column:
    """D3: the best boost of the claim types' preferences, or if none helps the worst."""
    if not preferred:
        return F.lit(0.0)
    lists = F.create_map(*[x for k, v in preferred.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])

    def of(claim_type: Column) -> Column:
        names = F.try_element_at(lists, claim_type)
        at = F.array_position(names, entity_type)
        boost = F.when(at == 0, ABSENT)
        for i, b in enumerate(BOOSTS, 1):
            boost = boost.when(at == i, b)
        return F.when(F.size(names) > 0, boost.otherwise(0.0))

    values = F.filter(F.transform(F.coalesce(claim_types, F.array().cast("array<string>")), of), lambda x: x.isNotNull())
    return F.when(F.size(values) == 0, 0.0).when(F.exists(values, lambda x: x > 0), F.array_max(values)).otherwise(F.array_min(values))


def candidates(mentions: DataFrame, entities: DataFrame, contexts: DataFrame | None = None, preferred: dict[str, tuple[str, ...]] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """D3: mention_id, paragraph_id, entity_id, entity_type, seed_order, score.

    mentions(mention_id, paragraph_id, normalized_form), entities(entity_id, entity_type, normalized_form, seed_order),
    contexts(paragraph_id, claim_types), counts(entity_id, n).
    """
    pairs = similar(mentions.select(F.col("normalized_form").alias("form")), entities.select(F.col("normalized_form").alias("name_form")))
    named = pairs.join(entities.withColumnRenamed("normalized_form", "name_form"), "name_form").select(F.col("form").alias("normalized_form"), "entity_id", "entity_type", "seed_order", "score")
    rows = mentions.select("mention_id", "paragraph_id", "normalized_form").join(named, "normalized_form")
    if contexts is not None:
        rows = rows.join(contexts.select("paragraph_id", "claim_types"), "paragraph_id", "left")
        moved = F.greatest(F.least(F.col("score") + adjustment(F.col("entity_type"), F.col("claim_types"), preferred or {}), F.lit(1.0)), F.lit(MAYBE))
        rows = rows.withColumn("score", F.when(F.size("claim_types") > 0, moved).otherwise(F.col("score"))).drop("claim_types")
    if counts is not None:
        rows = rows.join(counts.select("entity_id", "n"), "entity_id", "left")
        rows = rows.withColumn("score", F.least(F.col("score") + F.coalesce(F.least(0.02 * F.log1p("n"), F.lit(0.06)), F.lit(0.0)), F.lit(1.0))).drop("n")
    return rows.select("mention_id", "paragraph_id", "entity_id", "entity_type", "seed_order", "score")


def best(rows: DataFrame) -> DataFrame:
    """The best candidate of each mention, REFERS_TO if it is good and stands apart, else POSSIBLY_REFERS_TO."""
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "seed_order", "entity_id")
    first = rows.withColumn("place", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0))).where("place = 1")
    sure = (F.col("score") >= REFERS) & (F.col("score") - F.col("second") >= GAP)
    return first.where(F.col("score") >= MAYBE).select("mention_id", "paragraph_id", "entity_id", "entity_type", F.when(sure, "REFERS_TO").otherwise("POSSIBLY_REFERS_TO").alias("relation_type"), F.round("score", 4).alias("match_score"))


def resolve(mentions: DataFrame, entities: DataFrame, contexts: DataFrame | None = None, preferred: dict[str, tuple[str, ...]] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """D4 without contexts, D5 with them: the types that a paragraph's sure mentions mostly have help its other ones."""
    if contexts is None:
        return best(candidates(mentions, entities, None, None, counts))
    from fieldlore.session import cut

    scored = cut(candidates(mentions, entities, contexts, preferred, counts))
    sure = best(scored).where("relation_type = 'REFERS_TO'")
    first = mentions.select("mention_id", "paragraph_id").withColumn("seen", F.col("mention_id"))
    types = sure.groupBy("paragraph_id", "entity_type").agg(F.count("mention_id").alias("n"), F.min("mention_id").alias("seen"))
    mode = types.groupBy("paragraph_id").agg(F.max_by("entity_type", F.struct("n", F.col("seen"))).alias("mostly"))
    rest = scored.join(sure.select("mention_id"), "mention_id", "left_anti").join(mode, "paragraph_id", "left")
    helped = rest.withColumn("score", F.when(F.col("entity_type") == F.col("mostly"), F.least(F.col("score") + TOGETHER, F.lit(1.0))).otherwise(F.col("score"))).drop("mostly")
    del first
    return sure.unionByName(best(helped))


def supplemented(seed: DataFrame, others: DataFrame) -> DataFrame:
    """The vocabulary with candidates of the graph that it lacks, after its own."""
    return seed.unionByName(others.join(seed.select("entity_type", "normalized_form"), ["entity_type", "normalized_form"], "left_anti").withColumn("seed_order", F.col("seed_order") + F.lit(1 << 40)))


def frequency_prior(resolutions: DataFrame, order: str) -> DataFrame:
    """For each document (in the given order) and entity the resolutions of the documents before it."""
    per = resolutions.where("relation_type = 'REFERS_TO'").groupBy("entity_id", "doc_id", order).agg(F.count("mention_id").alias("own"))
    before = Window.partitionBy("entity_id").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("n", F.coalesce(F.sum("own").over(before), F.lit(0))).select("doc_id", "entity_id", "n")


def contexts(claims: DataFrame) -> DataFrame:
    """The claim types of each paragraph."""
    return claims.groupBy("paragraph_id").agg(F.sort_array(F.collect_set("claim_type")).alias("claim_types"))
