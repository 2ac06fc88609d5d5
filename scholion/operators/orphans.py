"""References to records that do not exist.

State is kept per (target table kind, key): what is known of the key, the references
that name it, and which of them are orphans now. New references probe the parents,
arriving parents resolve waiting orphans, deletions reopen them; counts are taken per
table and period from the state. Parents and references are only ever appended; what a
step looks at again are the references of the keys that it changes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scholion.runtime import drop, materialize, shared_dir

# The outcomes of a reference.
MISSING, DELETED, LATE = "missing", "deleted", "late"

UUID = r"([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})"


def record_key(writing: Column) -> Column:
    """The usual writing of a record key: lower-case hex with hyphens; other text trimmed; blank is null."""
    low = F.lower(F.trim(writing))
    found = F.regexp_extract(low, UUID, 0)
    dashed = F.regexp_replace(low, "^.*?" + UUID + ".*$", "$1-$2-$3-$4-$5")
    return F.when(found != "", dashed).when(low != "", low)


def work_key(writing: Column) -> Column:
    """The usual writing of a work id: W and digits; other text trimmed; blank is null."""
    up = F.upper(F.trim(writing))
    found = F.regexp_extract(up, r"(W[0-9]+)/?$", 1)
    return F.when(found != "", found).when(up != "", F.trim(writing))


def exploded(owners: DataFrame, table: str, field: str, space: str, owner: Column, refs: Column, updated: Column, fetched: Column) -> DataFrame:
    """One row per reference of a list column: (src_table, field, space, owner_id, ref_id, owner_updated, owner_fetched)."""
    key = work_key if space == "work" else record_key
    listed = owners.select(owner.alias("owner_id"), updated.alias("owner_updated"), fetched.alias("owner_fetched"), F.explode(refs).alias("ref"))
    return listed.select(
        F.lit(table).alias("src_table"), F.lit(field).alias("field"), F.lit(space).alias("space"), "owner_id", key(F.col("ref")).alias("ref_id"), "owner_updated", "owner_fetched"
    ).where("ref_id is not null and owner_id is not null")


def references(papers: DataFrame, seeds: DataFrame) -> DataFrame:
    """All references of paper_responses and seed_papers; null, empty and null lists give none."""
    paper = (F.col("id"), F.col("updated_at"), F.col("fetched_at"))
    seed = (F.col("point_id"), F.col("updated_at"), F.col("fetched_at"))
    out = exploded(papers, "paper_responses", "resolved_references", "record", paper[0], F.col("resolved_references"), *paper[1:])
    out = out.unionByName(exploded(papers, "paper_responses", "cited_by", "record", paper[0], F.col("cited_by"), *paper[1:]))
    return out.unionByName(exploded(seeds, "seed_papers", "referenced_works", "work", seed[0], F.col("payload.referenced_works"), *seed[1:]))


def parents(papers: DataFrame, seeds: DataFrame, stubs: DataFrame) -> DataFrame:
    """(space, ref_id, first_seen, deleted_at): what can be referred to, repeats included."""
    never = F.lit(None).cast("timestamp_ntz")
    cast = lambda c: F.col(c).cast("timestamp_ntz")
    frames = [
        papers.select(F.lit("record").alias("space"), record_key(F.col("id")).alias("ref_id"), cast("fetched_at").alias("first_seen"), cast("deleted_at").alias("deleted_at")),
        seeds.select(F.lit("record").alias("space"), record_key(F.col("point_id")).alias("ref_id"), never.alias("first_seen"), never.alias("deleted_at")),
        stubs.select(F.lit("record").alias("space"), record_key(F.col("point_id")).alias("ref_id"), never.alias("first_seen"), never.alias("deleted_at")),
        papers.select(F.lit("work").alias("space"), work_key(F.col("openalex_id")).alias("ref_id"), cast("fetched_at").alias("first_seen"), cast("deleted_at").alias("deleted_at")),
        seeds.select(F.lit("work").alias("space"), work_key(F.col("payload.openalex_id")).alias("ref_id"), never.alias("first_seen"), never.alias("deleted_at")),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.where("ref_id is not null")


def _known(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy("space", "ref_id").agg(F.min("first_seen").alias("first_seen"), F.max("deleted_at").alias("deleted_at"))


KEY = ["space", "ref_id"]


class OrphanState:
    """The parents and references that have come so far, and in ``open`` the references that are orphans now.

    ``advance`` takes what arrived since the last call, in any split; whatever the split,
    the orphans after it are the same.
    """

    def __init__(self) -> None:
        self.parents: list[DataFrame] = []
        self.references: list[DataFrame] = []
        self.open: DataFrame | None = None

    def advance(self, new_references: DataFrame, new_parents: DataFrame, stored: bool = False) -> DataFrame:
        """Bring the state up to date; the orphans of now are returned and kept in ``open``.

        What arrives is written to the state, unless it is ``stored`` where it can be read again.
        """
        arrived = new_parents if stored else materialize(_known(new_parents), "parents")
        fresh = new_references if stored else materialize(new_references, "references")
        touched = arrived.select(*KEY)
        # Of the earlier references only those are judged again whose parent came, changed or went.
        again = [r.join(touched, KEY, "left_semi") for r in self.references]
        self.parents.append(arrived)
        self.references.append(fresh)
        asked = reduce(DataFrame.unionByName, [fresh, *again])
        keys = asked.select(*KEY).distinct()
        # A parent without a mark of its own must still be told from none: there is one row for each known key.
        known = _known(reduce(DataFrame.unionByName, self.parents).join(keys, KEY, "left_semi")).withColumn("here", F.lit(True))
        kind = (
            F.when(F.col("here").isNull(), MISSING)
            .when(F.col("deleted_at").isNotNull(), DELETED)
            .when(F.col("first_seen") > F.col("owner_updated").cast("timestamp_ntz"), LATE)
        )
        judged = asked.join(known, KEY, "left").withColumn("kind", kind).drop("here", "first_seen", "deleted_at").where("kind is not null")
        before = self.open
        if before is not None:
            judged = judged.unionByName(before.join(touched, KEY, "left_anti"))
        self.open = materialize(judged, "orphans")
        if before is not None:
            drop(before)
        return self.open


def replay(references: DataFrame, parents: DataFrame, unit: str = "quarter", snapshots: bool = False) -> tuple[OrphanState, DataFrame | None]:
    """The state after all periods, taken one by one in order, and, if asked for, (period, src_table, field, kind, orphans) after each.

    References arrive with their owner's lists (owner_updated), parents when first seen,
    deletions when they happen; what has no time is there from the start.
    """
    period = lambda c: F.date_trunc(unit, c).cast("date")
    refs = references.withColumn("_at", period(F.col("owner_updated")))
    # A deletion is an arrival of its own, at its own time.
    never = F.lit(None).cast("timestamp_ntz")
    came = parents.select(*KEY, "first_seen", never.alias("deleted_at"), period(F.col("first_seen")).alias("_at"))
    went = parents.where("deleted_at is not null").select(*KEY, "first_seen", "deleted_at", period(F.col("deleted_at")).alias("_at"))
    arrivals = came.unionByName(went).distinct()
    # Both are laid out by period, so that a step reads its own.
    refs, arrivals = (_by_period(frame) for frame in (refs, arrivals))
    times = sorted({r[0] for f in (refs, arrivals) for r in f.select("_at").distinct().collect() if r[0]})
    state, taken = OrphanState(), []
    for number, at in enumerate(times):
        now = F.col("_at") == F.lit(at)
        due = (now | F.col("_at").isNull()) if number == 0 else now
        # What came before is one scan of the earlier periods' folders.
        earlier = (F.col("_at") < F.lit(at)) | F.col("_at").isNull()
        if number:
            state.references, state.parents = [refs.where(earlier).drop("_at")], [arrivals.where(earlier).drop("_at")]
        state.advance(refs.where(due).drop("_at"), arrivals.where(due).drop("_at"), stored=True)
        if snapshots:
            taken.append(snapshot(state.open, at))
    if not times:
        state.advance(refs.drop("_at"), arrivals.drop("_at"), stored=True)
        taken = [snapshot(state.open, None)] if snapshots else []
    return state, reduce(DataFrame.unionByName, taken) if snapshots else None


def _by_period(frame: DataFrame) -> DataFrame:
    """``frame`` written with a folder for each value of ``_at``."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex[:12]}"
    frame.write.partitionBy("_at").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def snapshot(orphans: DataFrame, at) -> DataFrame:  # noqa: ANN001
    """(period, src_table, field, kind, orphans): how many orphans there are now."""
    once = orphans.select("src_table", "field", "owner_id", "ref_id", "kind").distinct()
    counted = once.groupBy("src_table", "field", "kind").agg(F.count(F.lit(1)).alias("orphans"))
    return materialize(counted.select(F.lit(at).cast("date").alias("period"), "*"), "snapshot")


def found(orphans: DataFrame) -> DataFrame:
    """(src_table, field, owner_id, ref_id, kind), each once."""
    return orphans.select("src_table", "field", "owner_id", "ref_id", "kind").distinct()


def report(orphans: DataFrame) -> DataFrame:
    """Orphans per source table, field, kind and month of the referrer's fetched_at (null stays a period of its own)."""
    month = F.date_format(F.col("owner_fetched"), "yyyy-MM").alias("month")
    once = orphans.select("src_table", "field", "owner_id", "ref_id", "kind", month).distinct()
    return once.groupBy("src_table", "field", "kind", "month").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("owner_id").alias("owners"))
