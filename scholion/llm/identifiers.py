"""Digital object identifiers as records carry them: one writing, and whose they are."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What the suffix of a DOI says. Zeros fill a field; a name and a year stand for a whole volume; the last is a preprint server's.
FILLER = r"^10\.(0+/.*|[0-9]+/0+)$"
VOLUME = r"^10\.[0-9]+/[a-z]+[.\-_]?(18|19|20)[0-9]{2}$"
PREPRINT = r"^10\.[0-9]+/(preprint|arxiv)[.\-_:]"


def plain_doi(writing: Column) -> Column:
    """The DOI in lower case without resolver, prefix, escapes, spaces or final stops; null if there is no complete one."""
    decoded = F.try_url_decode(F.replace(writing, F.lit("+"), F.lit("%2B")))
    found = F.regexp_extract(F.lower(F.coalesce(decoded, writing)), r"(10\.[0-9]{4,9}/[^\s\"<>]*[^\s\"<>.,;])", 1)
    return F.when(found != "", found)


def own_doi(writing: Column) -> Column:
    """A DOI that can be a single work's own (a preprint's included), else null."""
    doi = plain_doi(writing)
    return F.when(~doi.rlike(FILLER) & ~doi.rlike(VOLUME), doi)


def is_preprint(doi: Column) -> Column:
    return doi.rlike(PREPRINT)
