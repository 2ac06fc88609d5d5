"""Problem 2: the links that pairwise match results state, and their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scholion.llm.components import connected_components
from scholion.runtime import materialize

# Match types that link two records.
LINKING_TYPES = ("doi", "openalex_id", "acl_id", "title_year")


def plain_type(match_type: Column) -> Column:
    """A match type in its usual writing: trimmed, lower case, underscores."""
    return F.regexp_replace(F.lower(F.trim(match_type)), r"[\s-]+", "_")


def work_id(writing: Column) -> Column:
    """W and its digits out of any writing of a work id, else null."""
    found = F.upper(F.regexp_extract(F.trim(writing), r"(?i)(?:^|[/:\s])(w[0-9]+)/?$", 1))
    return F.when(found != "", found)


def linking_pairs(results: DataFrame) -> DataFrame:
    """(src, dst) of the results that link two different records; nulls link nothing."""
    return (
        results.where(F.col("is_duplicate") & plain_type(F.col("match_type")).isin(*LINKING_TYPES))
        .select(work_id(F.col("checked_id")).alias("src"), work_id(F.col("matched_id")).alias("dst"))
        .where("src is not null and dst is not null and src <> dst")
    )


#: Digits that fit in a number with their count; longer ids are grouped as text.
DIGITS = 17


def id_number(identifier: Column) -> Column:
    """A number that orders as the work id does as text: its digits filled up behind, then how many there are; null if they are too many."""
    n = F.length(identifier) - 1
    return F.when(n <= DIGITS, F.rpad(F.substr(identifier, F.lit(2)), F.lit(DIGITS), F.lit("0")).cast("bigint") * (DIGITS + 1) + n)


def id_text(number: Column) -> Column:
    """The work id that ``id_number`` made the number of."""
    digits = F.lpad(F.floor(number / (DIGITS + 1)).cast("string"), DIGITS, "0")
    return F.concat(F.lit("W"), F.left(digits, F.pmod(number, F.lit(DIGITS + 1)).cast("int")))


def consolidate(results: DataFrame) -> DataFrame:
    """(record_id, group_id): every linked record with the least record of its group.

    Ids go through the rounds as numbers in the order of their text; only where one is
    too long for that do all go as text.
    """
    pairs = linking_pairs(results)
    coded = materialize(pairs.select(id_number(F.col("src")).alias("src"), id_number(F.col("dst")).alias("dst")).distinct(), "pairs")
    if coded.where("src is null or dst is null").limit(1).count():
        return connected_components(pairs).select(F.col("node").alias("record_id"), F.col("component").alias("group_id"))
    return connected_components(coded).select(id_text(F.col("node")).alias("record_id"), id_text(F.col("component")).alias("group_id"))
