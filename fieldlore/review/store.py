"""The store of proposals as append-only tables: every change is an event, the newest event is the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The state after an action, by the state before (fixed values).
MOVES = {("queued", "accept"): "accepted_pending_apply", ("queued", "reject"): "rejected", ("queued", "defer"): "deferred", ("deferred", "accept"): "accepted_pending_apply", ("deferred", "reject"): "rejected", ("queued", "edit"): "queued", ("deferred", "edit"): "queued", ("queued", "split"): "superseded"}


def upsert(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Found proposals replace stored ones of the same id but keep their status and creation time."""
    old = stored.select("proposal_id", F.col("status").alias("old_status"), F.col("created_at").alias("old_created"))
    new = found.join(old, "proposal_id", "left").withColumn("status", F.coalesce("old_status", "status")).withColumn("created_at", F.coalesce("old_created", "created_at")).drop("old_status", "old_created")
    return stored.join(found.select("proposal_id"), "proposal_id", "left_anti").unionByName(new, allowMissingColumns=True)


def applied(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """The status after each proposal's actions in order (events: proposal_id, action, created_at, event_id); actions that the state forbids do nothing."""
    moves = F.create_map(*[x for (s, a), t in MOVES.items() for x in (F.lit(f"{s}|{a}"), F.lit(t))])
    listed = events.groupBy("proposal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "event_id", "action"))), lambda e: e["action"]).alias("actions"))
    rows = proposals.join(listed, "proposal_id", "left")
    step = lambda state, action: F.coalesce(F.try_element_at(moves, F.concat_ws("|", state, action)), state)
    return rows.withColumn("status", F.aggregate(F.coalesce("actions", F.array().cast("array<string>")), F.col("status"), step)).drop("actions")


def revisions(events: DataFrame) -> DataFrame:
    """The newest revision of each proposal and the number of the next."""
    edits = events.where("action = 'edit'")
    return edits.groupBy("proposal_id").agg(F.max_by("patch", F.struct("created_at", "event_id")).alias("patch"), (F.count("event_id") + 1).alias("next_revision"))


def included(targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Targets without those whose newest override excludes them."""
    last = overrides.groupBy("proposal_id", "target_id").agg(F.max_by("included", F.struct("created_at", "event_id")).alias("included"))
    return targets.join(last, ["proposal_id", "target_id"], "left").where("coalesce(included, true)").drop("included")


def training_rows(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """Decided proposals with the action that decided them, and their patch as a variant."""
    decided = events.where(F.col("action").isin("accept", "reject")).groupBy("proposal_id").agg(F.max_by("action", F.struct("created_at", "event_id")).alias("action"))
    return proposals.join(decided, "proposal_id").withColumn("patch", F.try_parse_json("patch"))


#: What a patch of each type holds (fixed values): keys it must have, keys it may have; '*' marks a list of sorted, distinct texts.
PATCHES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "merge_entities": (("canonical_entity_id", "canonical_name", "merge_entity_ids*"), ("alias_mode",)),
    "create_alias": (("canonical_entity_id", "alias_entity_id", "canonical_name"), ("alias_name",)),
    "suppress_mention": (("mention_ids*", "suppression_reason", "scope"), ()),
    "relabel_claim_link": (("claim_id", "entity_id", "old_relation_type", "new_relation_type", "evidence_basis"), ()),
    "add_claim_entity_link": (("claim_id", "entity_id", "relation_type", "evidence_basis"), ()),
    "add_claim_location_link": (("claim_id", "entity_id", "relation_type", "evidence_basis"), ()),
    "exclude_claim_from_derivation": (("claim_id", "derivation_kind", "reason"), ()),
    "quarantine_claim": (("claim_id", "reason"), ()),
    "quarantine_document": (("doc_id", "reason"), ()),
    "restrict_permanently": (("target_id", "target_kind", "reason"), ()),
}
#: Pairs of keys whose values must differ.
DIFFERENT = {"create_alias": ("canonical_entity_id", "alias_entity_id"), "relabel_claim_link": ("old_relation_type", "new_relation_type")}
#: The values that a key allows, by type of patch and key; a key that is not listed allows all texts.
VALUES: dict[tuple[str, str], tuple[str, ...]] = {("add_claim_location_link", "relation_type"): ("OCCURRED_AT",), ("suppress_mention", "suppression_reason"): ("header_contamination", "boilerplate_contamination", "short_generic_token", "ocr_garbage"), ("suppress_mention", "scope"): ("mention", "document", "corpus"), ("exclude_claim_from_derivation", "derivation_kind"): ("observation", "event", "both")}
SCHEMA_VERSION = "v1"


def patch_errors(patches: DataFrame, values: dict[tuple[str, str], tuple[str, ...]] = VALUES) -> DataFrame:
    """proposal_id and the errors of its patch (a JSON text) for its proposal_type: no object, another version or type,
    keys that are missing or unknown, values that are no text, not allowed, equal where they must differ, or lists that are
    not sorted and distinct. No error is an empty list; all rules are columns."""
    lists = {k.rstrip("*") for must, _ in PATCHES.values() for k in must if k.endswith("*")}
    at = lambda k: F.get_json_object("patch", f"$.{k}")
    keys = F.coalesce(F.json_object_keys("patch"), F.array().cast("array<string>"))
    common = ("schema_version", "proposal_type")
    found = []

    def check(kind: str, error: Column) -> None:
        found.append(F.when(F.col("proposal_type") == kind, error))

    for kind, (must, may) in PATCHES.items():
        names = [k.rstrip("*") for k in must]
        check(kind, F.transform(F.array_except(F.array(*map(F.lit, (*common, *names))), keys), lambda k: F.concat(F.lit("missing:"), k)))
        check(kind, F.transform(F.array_except(keys, F.array(*map(F.lit, (*common, *names, *may)))), lambda k: F.concat(F.lit("unknown:"), k)))
        for k in (*names, *may):
            if k in lists:
                own = F.from_json(at(k), "array<string>")
                check(kind, F.when(at(k).isNotNull() & (own.isNull() | F.exists(own, lambda x: x.isNull())), F.array(F.lit(f"no_list:{k}"))))
                check(kind, F.when(own.isNotNull() & ~(F.array_sort(F.array_distinct(own)) == own), F.array(F.lit(f"not_sorted:{k}"))))
            else:
                # a text stands in quotes in the patch itself
                check(kind, F.when(at(k).isNotNull() & ~F.regexp_like("patch", F.lit(rf'"{k}"\s*:\s*"')), F.array(F.lit(f"no_text:{k}"))))
        for (of, k), allowed in values.items():
            if of == kind:
                check(kind, F.when(at(k).isNotNull() & ~at(k).isin(*allowed), F.array(F.lit(f"not_allowed:{k}"))))
        if kind in DIFFERENT:
            x, y = DIFFERENT[kind]
            check(kind, F.when(at(x) == at(y), F.array(F.lit(f"equal:{x}"))))
    merged = F.from_json(at("merge_entity_ids"), "array<string>")
    check("merge_entities", F.when(F.array_contains(merged, at("canonical_entity_id")), F.array(F.lit("merged_into_itself"))))
    check("suppress_mention", F.when(F.size(F.from_json(at("mention_ids"), "array<string>")) == 0, F.array(F.lit("empty:mention_ids"))))
    empty = F.array().cast("array<string>")
    rules = F.array_distinct(F.flatten(F.array(*[F.coalesce(f, empty) for f in found])))
    version = F.when(at("schema_version") != SCHEMA_VERSION, F.array(F.lit("version"))).otherwise(empty)
    other = F.when(at("proposal_type") != F.col("proposal_type"), F.array(F.lit("other_type"))).otherwise(empty)
    errors = F.when(F.json_object_keys("patch").isNull(), F.array(F.lit("not_an_object"))).when(~F.col("proposal_type").isin(*PATCHES), F.array(F.lit("unknown_type"))).otherwise(F.concat(version, other, rules))
    return patches.select("proposal_id", errors.alias("errors"))


def split(proposals: DataFrame, targets: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, targets) of the children of split proposals: one child for each group of targets, queued, with a
    name that follows from the parent's and the group's. groups(proposal_id, group_no, target_id); targets of the parent in
    no group stay with it."""
    from fieldlore.functions import ids

    child = F.concat(F.lit("proposal_"), ids.stable_hash(ids.text_part("proposal_id"), ids.text_part(F.col("group_no").cast("string"))))
    named = groups.select("proposal_id", "group_no", "target_id").distinct().withColumn("child_id", child)
    own = targets.join(named, ["proposal_id", "target_id"])
    sizes = own.groupBy("proposal_id", "child_id").agg(F.count_distinct("target_id").alias("impact"))
    rows = proposals.join(sizes, "proposal_id")
    kept = [c for c in proposals.columns if c not in ("proposal_id", "status", "impact_size")]
    children = rows.select(F.col("child_id").alias("proposal_id"), F.col("proposal_id").alias("parent_id"), F.lit("queued").alias("status"), F.col("impact").alias("impact_size"), *kept)
    return children, own.drop("proposal_id", "group_no").withColumnRenamed("child_id", "proposal_id")


def batch_actions(events: DataFrame, proposals: DataFrame, action: str, reviewer: str, at: Column, **filters: str) -> DataFrame:
    """The events with one action more for every proposal that the filters pick, in one pass."""
    rows = proposals
    for column, value in filters.items():
        rows = rows.where(F.col(column) == value)
    name = F.concat(F.lit("event_"), F.substring(F.sha1(F.concat_ws("|", "proposal_id", F.lit(action), F.lit(reviewer), at.cast("string")).cast("binary")), 1, 16))
    return events.unionByName(rows.select("proposal_id", F.lit(action).alias("action"), F.lit(reviewer).alias("reviewer"), at.alias("created_at"), name.alias("event_id")), allowMissingColumns=True)
