"""Problem 4: linking the variant spellings of names that mean one person.

Every spelling is rewritten by nickname, initial, title, token-order, accent and typing
rules into canonical forms; the forms are exploded and equi-joined. A form counts by its
rarity: a full form links outright, a form with a letter dropped after a check of the
slips, and an initial form only where it leads to a single person, alone or together
with an affiliation. Organisations are known by their legal forms, which say nothing of
which one it is. ``people`` gives every name its person; pairs are only written out where
a query asks for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scholion.llm.components import connected_components
from scholion.llm.names import affiliation_stem, dropped, forms, look, shared_keys, shortened
from scholion.llm.titles import slips
from scholion.runtime import materialize

SLIPS = 2


def _spelled(names: DataFrame) -> DataFrame:
    """(name, look, spelling, full, initial_keys, short, cut, shared): the canonical forms of distinct names."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [forms(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([look(x) for x in texts]), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found]), pa.array([shortened(x) for x in texts], pa.list_(pa.string())), pa.array([shared_keys(x) for x in texts], pa.list_(pa.string()))],
                names=["name", "look", "full", "initial_keys", "short", "cut", "shared"],
            )

    schema = "name string, look string, full string, initial_keys array<string>, short boolean, cut array<string>, shared array<string>"
    return names.mapInArrow(rewrite, schema).withColumn("spelling", F.xxhash64("look"))


def _slipped(keys: DataFrame) -> DataFrame:
    """(a, b): keys of two words of which one differs by slips of typing."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = [], []
            for row, key in enumerate(batch.column(0).to_pylist()):
                x, y = key.split("|")
                for v in {f"{x}|{v}" for v in dropped(y)} | {f"{y}|{v}" for v in dropped(x)}:
                    ids.append(row)
                    variants.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(variants, pa.string())], names=["key", "variant"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = set(a.split("|")), set(b.split("|"))
                only = (list(p - q), list(q - p))
                keep.append(len(only[0]) == len(only[1]) == 1 and slips(only[0][0], only[1][0], SLIPS) <= (SLIPS if min(len(only[0][0]), len(only[1][0])) > 3 else 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    variants = keys.mapInArrow(drop, "key string, variant string").select("key", F.xxhash64("variant").alias("v"))
    pairs = variants.select("v", F.col("key").alias("a")).join(variants.select("v", F.col("key").alias("b")), "v").where("a < b").select("a", "b").distinct()
    return pairs.mapInArrow(verify, "a string, b string")


def _told_by_others(spellings: DataFrame) -> DataFrame:
    """``spellings`` with the full key of a shared short form (Alex, Chris) set to the one of its names that others of
    that surname bear; to the usual one where none is borne, and to none where several are."""
    asked = spellings.where("size(shared) > 0").select("spelling", F.posexplode("shared").alias("place", "full"))
    borne = spellings.where("size(shared) = 0").select("full").join(asked.select("full"), "full", "left_semi").distinct().withColumn("borne", F.lit(True))
    told = asked.join(borne, "full", "left").groupBy("spelling").agg(F.count_if("borne").alias("n"), F.min_by("full", F.struct(F.col("borne").isNull(), "place")).alias("told"))
    joined = spellings.join(told, "spelling", "left")
    kept = F.when(F.col("n").isNull() | (F.size("shared") == 0), F.col("full")).when(F.col("n") < 2, F.col("told"))
    return joined.withColumn("full", kept).drop("n", "told", "shared")


def people(mentions: DataFrame, others: DataFrame) -> DataFrame:
    """(name, spelling, person): every distinct name of both tables and the person it means.

    ``mentions`` has (name, affiliation, orcid, openalex_id), ``others`` (name). Null
    and blank names mean nobody; a name without a given name stands alone. Slips of a
    full form are those that leave the two equal once each has lost at most one letter.
    """
    named = lambda frame: frame.where("name is not null and trim(name) <> ''")
    names = materialize(_spelled(named(mentions.select("name")).unionByName(named(others.select("name"))).distinct()), "names")

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([affiliation_stem(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, *batch.columns[2:]], names=["name", "stem", "orcid", "openalex_id"])

    told = named(mentions).select("name", "affiliation", "orcid", "openalex_id").distinct().mapInArrow(stems, "name string, stem string, orcid string, openalex_id string")
    told = materialize(told.join(names.select("name", "spelling"), "name").drop("name").distinct(), "told")

    spellings = names.select("spelling", "full", "short", "initial_keys", "cut", "shared").dropDuplicates(["spelling"])
    spellings = materialize(_told_by_others(spellings), "spellings")
    firsts = spellings.where("full is not null").groupBy("full").agg(F.min("spelling").alias("first"))
    by_full = spellings.join(firsts, "full").select(F.col("spelling").alias("src"), F.col("first").alias("dst"))
    firsts = materialize(firsts, "firsts")
    slipped = materialize(_slipped(firsts.select("full")), "slipped")
    by_slip = slipped.join(firsts.select(F.col("full").alias("a"), F.col("first").alias("src")), "a").join(firsts.select(F.col("full").alias("b"), F.col("first").alias("dst")), "b").select("src", "dst")
    by_cut = spellings.select("spelling", F.explode("cut").alias("full")).join(firsts, "full").select(F.col("spelling").alias("src"), F.col("first").alias("dst"))
    marks = told.select("spelling", F.explode(F.array(F.concat(F.lit("o"), F.trim("orcid")), F.concat(F.lit("a"), F.trim("openalex_id")))).alias("mark")).where("mark is not null and length(mark) > 1").distinct()
    mark_firsts = marks.groupBy("mark").agg(F.min("spelling").alias("dst"))
    by_mark = marks.join(mark_firsts, "mark").select(F.col("spelling").alias("src"), "dst")
    groups = connected_components(by_full.unionByName(by_slip).unionByName(by_cut).unionByName(by_mark).where("src <> dst"))
    settled = materialize(
        spellings.select("spelling", "short", "initial_keys").join(groups.select(F.col("node").alias("spelling"), "component"), "spelling", "left"), "settled"
    )
    certain = settled.withColumn("person", F.coalesce("component", F.when(~F.col("short"), F.col("spelling"))))
    # Initial forms: those still alone look for the one person their form leads to.
    leads = materialize(certain.where("person is not null").select(F.explode("initial_keys").alias("form"), "person").distinct(), "leads")
    alone = certain.where("person is null").select("spelling", F.element_at("initial_keys", 1).alias("form"))
    single = lambda frame, *by: frame.groupBy(*by).agg(F.min("person").alias("person"), F.max("person").alias("last")).where("person = last").drop("last")
    clear = materialize(alone.join(single(leads, "form"), "form").select("spelling", "form", "person"), "clear")
    unclear = alone.join(clear.select("spelling"), "spelling", "left_anti")
    stem_of = told.where("stem is not null").select("spelling", "stem").distinct()
    stem_leads = leads.join(unclear.select("form").distinct(), "form", "left_semi").join(certain.select("spelling", "person"), "person").join(stem_of, "spelling").select("form", "stem", "person").distinct()
    by_stem = unclear.join(stem_of, "spelling").join(single(stem_leads, "form", "stem"), ["form", "stem"])
    by_stem = materialize(single(by_stem, "spelling"), "by_stem")
    clear = clear.select("spelling", "person").unionByName(by_stem)
    rest = materialize(unclear.join(by_stem.select("spelling"), "spelling", "left_anti"), "rest")
    # A slip in the surname of an initial form.
    variants = lambda frame: frame.select(*frame.columns, F.explode(F.expr("array_union(array(form), transform(sequence(3, length(form)), i -> concat(left(form, i - 1), substring(form, i + 1))))")).alias("variant")).where("length(form) > 6")
    # Forms that lead to someone outright are not looked at again; the others share the person of their slip, or one of their own.
    near = single(variants(rest).join(variants(leads).select("variant", "person").distinct(), "variant"), "spelling").join(
        rest.join(leads.select("form").distinct(), "form", "left_anti").select("spelling"), "spelling", "left_semi"
    )
    near = materialize(near, "near")
    clear = clear.unionByName(near)
    lonely = rest.join(near.select("spelling"), "spelling", "left_anti")
    nobody = lonely.join(leads.select("form").distinct(), "form", "left_anti")
    own = nobody.join(nobody.groupBy("form").agg(F.min("spelling").alias("person")), "form").select("spelling", "person")
    unknown = lonely.join(own.select("spelling"), "spelling", "left_anti").select("spelling", F.col("spelling").alias("person"))
    all_people = certain.where("person is not null").select("spelling", "person").unionByName(clear).unionByName(own).unionByName(unknown)
    return names.select("name", "spelling").join(all_people, "spelling")


def same_person_pairs(named: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: different spellings of one person, look-alike ones left out."""
    a = named.select("person", F.col("spelling").alias("sa"), F.col("name").alias("name_a"))
    b = named.select("person", F.col("spelling").alias("sb"), F.col("name").alias("name_b"))
    return a.join(b, "person").where("sa <> sb and name_a < name_b").select("name_a", "name_b").distinct()
