"""Problem 6: the best representative of each duplicate group, field by field.

Every field is one aggregation: the greatest of a struct of usability, preference and
member, so no group is ever gathered. Texts that many different groups share are no
abstracts of their own but a source's boilerplate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scholion.llm.identifiers import own_doi

# What sources write where there is no abstract.
NO_ABSTRACT = r"(?i)^(n/?a|null|none|nil|unknown|tba|tbd|loading.*|abstract|\[?no abstract.*|no summary.*|abstract not (available|provided).*|not available.*|[-–—.?]*)$"
CUT_OFF = r"(…|\.\.\.|\[(truncated|…|\.\.\.)\])\s*$"
SHARED_BY = 4


def plain_text(text: Column) -> Column:
    """A text without markup and outer or repeated white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", " "), r"[\s ]+", " "))


def citers(cited_by: Column) -> Column:
    """How many different citers a list names; nulls, blanks, case and repeats aside."""
    usable = F.filter(F.transform(cited_by, lambda c: F.lower(F.trim(c))), lambda c: c.isNotNull() & (c != ""))
    return F.size(F.array_distinct(usable))


def survivors(members: DataFrame, stubs: DataFrame, papers: DataFrame) -> DataFrame:
    """(group_id, field, member_table, member_key): whose value survives for each field.

    ``abstract`` is the longest real text (a cut-off one only where none is whole),
    ``doi`` a complete one, ``cited_by`` the list with most different citers, all of
    stubs; ``openalex_id`` a complete work id of raw papers. Ties go to the least
    member_key. Fields without a usable value give no row; repeated and unknown
    members, null groups and empty tables add nothing.
    """
    of = members.where("group_id is not null and member_key is not null").select("group_id", "member_table", "member_key").distinct()
    stub_values = stubs.select(
        F.col("point_id").alias("member_key"),
        F.when(~plain_text(F.col("payload.abstract")).rlike(NO_ABSTRACT), plain_text(F.col("payload.abstract"))).alias("abstract"),
        own_doi(F.col("payload.doi")).alias("doi"),
        F.trim(F.col("payload.doi")).alias("doi_written"),
        citers(F.col("payload.cited_by")).alias("citers"),
    ).select(
        "member_key",
        F.xxhash64("abstract").alias("text_id"),
        F.length(F.regexp_replace("abstract", CUT_OFF, "")).alias("length"),
        (~F.col("abstract").rlike(CUT_OFF)).alias("whole"),
        F.col("doi").isNotNull().alias("has_doi"),
        (F.col("doi") == F.col("doi_written")).alias("plain_doi"),
        "citers",
        F.col("abstract").isNotNull().alias("has_abstract"),
    )
    stub_rows = of.where("member_table = 'seed_stubs'").join(stub_values, "member_key")
    shared = stub_rows.where("has_abstract").select("text_id", "group_id").distinct().groupBy("text_id").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") >= SHARED_BY)
    judged = stub_rows.join(shared.select("text_id", F.lit(True).alias("boilerplate")), "text_id", "left")

    def best(field: str, usable: Column, *preference: Column) -> Column:
        # Of equal preference the least key: the struct's greatest is turned round by min on a negated order.
        order = [F.when(p.isNull(), 0).otherwise(-p.cast("bigint")) for p in preference]
        key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("member_key").alias("k"))
        return F.min(F.when(usable, key))["k"].alias(field)

    real = F.col("has_abstract") & F.col("boilerplate").isNull() & (F.col("length") > 0)
    stub_best = judged.groupBy("group_id").agg(
        best("abstract", real, F.col("whole").cast("int"), F.col("length")),
        best("doi", F.col("has_doi"), F.col("plain_doi").cast("int")),
        best("cited_by", F.col("citers") > 0, F.col("citers")),
    )
    raw = of.where("member_table = 'raw_papers'").select("group_id", "member_key", F.expr("try_cast(member_key as bigint)").alias("raw_id")).where("raw_id is not null")
    work = papers.select("raw_id", F.regexp_like(F.trim("openalex_id"), F.lit(r"^([a-zA-Z]+://[^\s]+/)?[Ww][1-9][0-9]{3,}$")).alias("complete"), F.trim("openalex_id").startswith("W").alias("plain")).where("complete")
    paper_best = raw.join(work, "raw_id").groupBy("group_id").agg(best("openalex_id", F.col("complete"), F.col("plain").cast("int")))

    def rows(frame: DataFrame, field: str, table: str) -> DataFrame:
        return frame.where(F.col(field).isNotNull()).select("group_id", F.lit(field).alias("field"), F.lit(table).alias("member_table"), F.col(field).alias("member_key"))

    unpivoted = stub_best.select(
        "group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("member_key")) for f in ("abstract", "doi", "cited_by")])).alias("x")
    ).select("group_id", "x.field", F.lit("seed_stubs").alias("member_table"), "x.member_key").where("member_key is not null")
    return reduce(DataFrame.unionByName, [unpivoted, rows(paper_best, "openalex_id", "raw_papers")])
