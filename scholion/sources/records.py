"""Sources: landed files and semi-structured strings as tables of records."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

WORK = """id STRING, doi STRING, title STRING, display_name STRING, publication_year INT, publication_date STRING, language STRING, type STRING,
authorships ARRAY<STRUCT<author: STRUCT<id: STRING, display_name: STRING, orcid: STRING>>>, referenced_works ARRAY<STRING>, abstract_inverted_index MAP<STRING, ARRAY<INT>>,
cited_by_count INT, updated_date STRING, concepts ARRAY<STRUCT<id: STRING, display_name: STRING, score: DOUBLE>>"""
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def snapshot_works(spark: SparkSession, folder: str, done: list[str] | None = None) -> DataFrame:
    """Works of a snapshot: ``folder/updated_date=*/*.gz`` with one JSON object a line.

    Blank and malformed lines are dropped and unreadable files skipped; ``done`` are the
    full paths of files taken before (as in ``file``, which every row has), anti-joined.
    """
    read = spark.read.schema(WORK).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").option("basePath", folder)
    works = read.json(f"{folder}/updated_date=*/*").withColumn("file", F.col("_metadata.file_path")).where("id is not null")
    if not done:
        return works
    return works.join(spark.createDataFrame([(d,) for d in done], "file string").distinct(), "file", "left_anti")


def works_stream(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """The same files as a stream: each is taken once, as the query's checkpoint records.

    ``since`` leaves out works last updated before that date (yyyy-mm-dd); those without a date stay.
    """
    works = spark.readStream.schema(WORK).option("mode", "DROPMALFORMED").json(folder).where("id is not null")
    return works if since is None else works.where(F.coalesce(F.left("updated_date", F.lit(10)) >= since, F.lit(True)))


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line) of the non-blank lines of a snapshot that are no JSON object: a dead-letter table."""
    lines = spark.read.text(f"{folder}/updated_date=*/*").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
    return lines.where(F.try_parse_json("line").isNull())


def anthology(spark: SparkSession, path: str) -> DataFrame:
    """Papers of anthology XML: (paper, title, authors, year, month, doi), marked-up titles as plain text."""
    schema = "_id STRING, title STRING, author ARRAY<STRUCT<first: STRING, last: STRING>>, year INT, month STRING, doi STRING"
    papers = spark.read.format("xml").option("rowTag", "paper").schema(schema).load(path)
    return papers.select(F.col("_id").alias("paper"), "title", F.transform("author", lambda a: F.concat_ws(" ", a["first"], a["last"])).alias("authors"), "year", month_number(F.col("month")).alias("month"), "doi")


def month_number(month: Column) -> Column:
    """1 to 12 out of a month's English name, its first three letters or a number, the first month of a range; else null."""
    first = F.left(F.lower(F.trim(month)), F.lit(3))
    place = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), first)
    number = F.expr("null").cast("int")
    number = F.regexp_extract(month, r"^\s*(\d{1,2})\b", 1).try_cast("int")
    return F.coalesce(F.nullif(place, F.lit(0)).cast("int"), F.when(number.between(1, 12), number))


@F.pandas_udf(StringType())
def resolved(texts: pd.Series) -> pd.Series:
    """Text with its character references and named entities (XML's and the Latin ones of DBLP's DTD) resolved, each once."""
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


def xml_title(xml: Column) -> Column:
    """The text of an XML title element with its inner markup removed and its entities resolved."""
    inner = F.regexp_extract(xml, r"(?s)<title(?:\s[^>]*)?>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(resolved(F.regexp_replace(inner, r"<[^>]+>", "")), r"\s+", " "))


def escaped(text: Column) -> Column:
    """Text as it stands in XML content."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def dblp_hits(raw: DataFrame, column: str) -> DataFrame:
    """(key, title, authors, year) of search hits, whose authors come as one object or a list.

    Numbers that tell namesakes apart are cut off names, and final stops off titles;
    authors without a name are left out.
    """
    doc = F.try_parse_json(column)
    listed = F.coalesce(
        F.try_variant_get(doc, "$.info.authors.author", "array<struct<text: string>>"),
        F.array_compact(F.array(F.try_variant_get(doc, "$.info.authors.author", "struct<text: string>"))),
    )
    return raw.select(
        F.try_variant_get(doc, "$.info.key", "string").alias("key"),
        F.regexp_replace(F.try_variant_get(doc, "$.info.title", "string"), r"\.+$", "").alias("title"),
        F.transform(F.filter(listed, lambda a: a["text"].isNotNull()), lambda a: F.regexp_replace(a["text"], r"\s*\d{4}$", "")).alias("authors"),
        F.try_variant_get(doc, "$.info.year", "string").try_cast("int").alias("year"),
    )


def note_field(note: Column, field: str) -> Column:
    """A field of a note, in either API version: the value itself or an object with a value."""
    doc = F.try_parse_json(note)
    return F.coalesce(F.try_variant_get(doc, f"$.content.{field}.value", "string"), F.try_variant_get(doc, f"$.content.{field}", "string"))


def accepted(venue: Column) -> Column:
    """Whether a note's venue line says it was accepted: rejections are ruled out first."""
    low = F.lower(F.coalesce(venue, F.lit("")))
    return F.when(low.rlike("reject|withdrawn|desk|submitted to"), False).otherwise(low.rlike("accept|poster|oral|spotlight|conference|findings"))


def html_title(html: Column) -> Column:
    """The page title of HTML, entities for the five XML characters resolved."""
    text = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.nullif(text, F.lit(""))


def tei_references(xml: Column) -> Column:
    """DOIs that a TEI document's bibliography names, in order."""
    return F.regexp_extract_all(xml, F.lit(r'<idno type="DOI">\s*([^<\s]+)\s*</idno>'), F.lit(1))


def two_digit_year(year: Column) -> Column:
    """A year of two digits in its century: under 50 this one, else the last; other years stay."""
    number = year.try_cast("int")
    return F.when(number < 50, number + 2000).when(number < 100, number + 1900).otherwise(number)
