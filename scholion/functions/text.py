"""Scalar text functions as Column expressions that stay inside code generation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Words an acronym cannot be (a sample of English function words).
NOT_KEYWORDS = ("IT", "IS", "OR", "AN", "AS", "AT", "BE", "BY", "DO", "GO", "IF", "IN", "NO", "OF", "ON", "SO", "TO", "UP", "WE", "US", "THE", "FOR", "AND", "WITH", "FROM", "NOT", "BUT", "ALL", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")
# Accented Latin letters and their bases, for JVM-side folding.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçšžşÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇŠŽŞ"
BASES = "aaaaaaeeeeiiiiooooouuuuncszsAAAAAAEEEEIIIIOOOOOUUUUNCSZS"


def has_value(column: Column, kind: str = "string") -> Column:
    """Whether a value is really there: not null, not blank text, not an empty list."""
    if kind == "string":
        return F.coalesce(F.trim(column) != "", F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(column) > 0, F.lit(False))
    return column.isNotNull()


def normalize_title(title: Column) -> Column:
    """Lower case, Latin accents folded, only letters, digits and single spaces; null gives ''."""
    folded = F.translate(F.lower(F.coalesce(title, F.lit(""))), ACCENTED, BASES)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


@F.pandas_udf(StringType())
def normalize_title_nfkd(titles: pd.Series) -> pd.Series:
    """The same over all of Unicode: compatibility forms decomposed and marks dropped."""

    def one(title: str | None) -> str:
        text = unicodedata.normalize("NFKD", (title or "").lower())
        text = "".join(c for c in text if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() or c == "_" or c.isspace() else "" for c in text).split())

    return titles.map(one)


def title_year_key(title: Column, year: Column) -> Column:
    """Folded title and year; year null or 0 is unknown."""
    shown = F.when(F.coalesce(year, F.lit(0)) == 0, "unknown").otherwise(year.cast("string"))
    return F.concat_ws("|", normalize_title(title), shown)


def plain_doi(doi: Column) -> Column:
    """Trimmed lower-case DOI without resolver or scheme; blank is null."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://[a-z.]*/)?(doi:\s*)?", "")
    return F.nullif(bare, F.lit(""))


def classify_identifier(reference: Column) -> Column:
    """title, doi, arxiv, openalex or unknown, tested in this order."""
    text = F.trim(reference)
    return (
        F.when(text.rlike(r"(?i)^title:"), "title")
        .when(text.rlike(r"(?i)^(https?://[a-z.]*/)?(doi:\s*)?10\.[0-9]{4,9}/\S+$"), "doi")
        .when(text.rlike(r"(?i)^(arxiv:)*[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$"), "arxiv")
        .when(text.rlike(r"(?i)^(openalex:|https?://\S+/)?w[0-9]+$"), "openalex")
        .otherwise("unknown")
    )


def normalize_identifier(reference: Column) -> Column:
    """An identifier with one prefix of its kind: doi:, arxiv:, openalex: or title:."""
    text, kind = F.trim(reference), classify_identifier(reference)
    bare = (
        F.when(kind == "doi", plain_doi(text))
        .when(kind == "arxiv", F.regexp_replace(F.lower(text), r"^(arxiv:)+|v[0-9]+$", ""))
        .when(kind == "openalex", F.upper(F.regexp_extract(text, r"(?i)(w[0-9]+)$", 1)))
        .when(kind == "title", F.regexp_replace(F.lower(text), r"^title:\s*", ""))
    )
    return F.when(kind != "unknown", F.concat(kind, F.lit(":"), bare))


def surname(name: Column) -> Column:
    """The last word of a name, in lower case."""
    return F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def hashed_uuid(identifier: Column) -> Column:
    """A UUID-shaped key out of the SHA-256 of the lower-cased identifier."""
    digest = F.sha2(F.lower(identifier), 256)
    cut = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cut])


def uuid5_url(name: Column) -> Column:
    """UUID version 5 in the URL namespace (RFC 4122)."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "utf-8")))
    high = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)
    variant = F.lower(F.lpad(F.hex(high), 2, "0"))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def text_of_inverted_index(index: Column) -> Column:
    """The text of a map word -> positions, words in order of position."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def acronyms(title: Column) -> Column:
    """Acronyms of a title in order, without repeats: a name before a colon or dash, in brackets, or in capitals."""
    leads = F.array(F.regexp_extract(title, r"^([A-Za-z][A-Za-z0-9-]{1,14})\s*[:–]", 1))
    found = F.concat(leads, F.regexp_extract_all(title, F.lit(r"\(([A-Z][A-Za-z0-9-]{1,14})\)"), 1), F.regexp_extract_all(title, F.lit(r"\b([A-Z]{2}[A-Z0-9-]{0,13})\b"), 1))
    return F.array_distinct(F.filter(found, valid_keyword))


def valid_keyword(word: Column) -> Column:
    """2 to 15 letters, digits and hyphens, with a letter, and no function word."""
    return word.rlike(r"^[A-Za-z0-9-]{2,15}$") & word.rlike(r"[A-Za-z]") & ~F.upper(word).isin(*NOT_KEYWORDS)


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences by terminal punctuation after white space is collapsed."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?]) "), lambda s: s != "")


def with_singulars(keywords: Column) -> Column:
    """Keywords without repeats in any case, first wins; a plural acronym brings its singular along."""
    both = F.flatten(F.transform(keywords, lambda k: F.when(k.rlike(r"^[A-Z0-9-]{2,}s$"), F.array(k, F.expr("null").cast("string"), F.regexp_replace(k, "s$", ""))).otherwise(F.array(k))))
    kept = F.filter(both, lambda k: k.isNotNull())
    lower = F.transform(kept, lambda k: F.lower(k))
    return F.filter(kept, lambda k, i: F.array_position(lower, F.lower(k)) == i + 1)


def repository_urls(text: Column) -> Column:
    """Addresses of code repositories in a text, without trailing marks, each once."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)https?://(?:www\.)?(?:github|gitlab)\.com/[\w.-]+/[\w.-]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(F.lower(u), r"(\.git)?[.,;]*$", "")))


def section_class(heading: Column) -> Column:
    """The kind of a section by the words of its heading, tested in order."""
    low = F.lower(F.coalesce(heading, F.lit("")))
    out = F.when(low.rlike("abstract"), "abstract").when(low.rlike("introduc"), "introduction").when(low.rlike("related|background|prior"), "related")
    out = out.when(low.rlike("method|approach|model"), "method").when(low.rlike("experiment|evaluation|setup"), "experiment").when(low.rlike("result"), "result")
    return out.when(low.rlike("discuss|limitation|conclu|outlook"), "conclusion").otherwise("other")


def lexical_weights(query: str) -> tuple[float, float]:
    """(dense, lexical) weights of a query's legs: short, quoted and acronym queries lean on words, long ones on meaning."""
    words_ = query.split()
    short = [w for w in words_ if len(w) > 1 and w.strip('"').isupper()]
    if query.strip().startswith('"') or len(words_) <= 3 or len(short) >= max(1, len(words_) // 2):
        return 0.7, 1.3
    return (1.4, 0.6) if len(words_) >= 12 else (1.0, 1.0)


def lettered(text: Column) -> Column:
    """Letters, digits, underscores and single spaces of a text."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def preprint_of_doi(doi: Column) -> Column:
    """The preprint's own id out of the DOI that its server gives it, else null."""
    return F.nullif(F.regexp_extract(doi, r"^10\.[0-9]+/(?:preprint|arxiv)[.\-_:](.+)$", 1), F.lit(""))


def by_prefix(text: Column, prefixes: dict[str, str]) -> Column:
    """The name of the first prefix that a text begins with, else unknown."""
    return by_rules(text, tuple((n, "^" + p) for n, p in prefixes.items()), "unknown")


def by_rules(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """The name of the first rule (name, pattern) that a text meets."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def first_most(text: Column, words_of: dict[str, tuple[str, ...]]) -> Column:
    """The name of which the text has the most words, the first of equals; null if it has none."""
    hits = {n: sum((F.contains(text, F.lit(w)).cast("int") for w in ws), F.lit(0)) for n, ws in words_of.items()}
    most = F.greatest(*hits.values())
    out = F.when(most == 0, F.lit(None).cast("string"))
    for name, n in hits.items():
        out = out.when(n == most, name)
    return out


def latin_words(text: Column) -> Column:
    """Runs of Latin letters, digits and hyphens, as they are written."""
    return F.filter(F.split(text, "[^A-Za-z0-9-]+"), lambda w: w != "")


def acronym_ways(title: Column) -> dict[str, Column]:
    """Candidates for acronyms of a title by how they are written: leading, in brackets, in capitals, in mixed case."""
    return {
        "lead": F.array(F.regexp_extract(title, r"^([A-Za-z][A-Za-z0-9-]{1,14})\s*[:–—]", 1)),
        "brackets": F.regexp_extract_all(title, F.lit(r"\(([A-Z][A-Za-z0-9-]{1,14})\)"), F.lit(1)),
        "capitals": F.filter(latin_words(title), lambda w: w.rlike("^[A-Z]{2}[A-Z0-9-]{0,13}$")),
        "mixed": F.filter(latin_words(title), lambda w: w.rlike("^[A-Z][a-z]+[A-Z][A-Za-z0-9]{0,12}$")),
    }
