"""Problem 1: new batches against all history, by an incremental inverted index.

The index is a set of tables in one folder: the record classes accepted so far, the
distinct titles, the postings of their rare-token prefixes, and the similar titles found.
Each is bucketed by the key that it is probed with (postings by token), so a delivery is
shuffled to the index's buckets and the history stays where it is. A delivery is reduced
to classes, the tokens of the titles that are new probe the postings, lengths are
filtered, slips verified, and everything new is appended. No history row is paired with
another history row.

Prefix: the P rarest words of a title in one global order (a count sketch of fixed size,
frozen when the index is made, then the word's hash). Two titles that differ in at most
K words share at least P - K prefix words, so every combination of P - K prefix words is
one token: titles within K words share a token for certain. Words count with their place
and the title's number of words, as slips move no word; that keeps postings short. Short
titles have rules of their own, certain within what the verifier accepts of them.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scholion.llm.components import connected_components
from scholion.llm.identifiers import is_preprint, own_doi
from scholion.llm.titles import MOST_DAMAGED, damaged_words, fold_words, same_but_slips, series_mark, shortened_forms, slips_allowed
from scholion.runtime import brief_plans, drop, materialize, read_text, shared_dir, write_text

PREFIX = 5
SKETCH = 1 << 15
#: Damaged words times the edits of each.
LENGTH_GAP = 6
YEAR_GAP = 1


def normalised(papers: DataFrame, *keep: str) -> DataFrame:
    """(raw_id, dk, open, title_id, year, words, *keep) of (raw_id, title, year, doi).

    dk is the hash of the row's own DOI, open tells that it has none but a preprint's,
    title_id the hash of the folded title's letters. Rows with neither are dropped:
    nothing identifies them.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([" ".join(fold_words(x)) or None for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([words, *batch.columns[1:]], names=["words", *batch.schema.names[1:]])

    doi = own_doi(F.col("doi"))
    keyed = papers.where("raw_id is not null").select(
        "title",
        F.col("raw_id").cast("bigint").alias("raw_id"),
        F.coalesce(F.col("year").cast("int"), F.lit(-1)).alias("year"),
        F.when(doi.isNotNull(), F.xxhash64(doi)).alias("dk"),
        F.coalesce(is_preprint(doi), F.lit(True)).alias("open"),
        *keep,
    )
    kinds = dict(papers.dtypes)
    folded = keyed.mapInArrow(fold, "words string, raw_id bigint, year int, dk bigint, open boolean" + "".join(f", {c} {kinds[c]}" for c in keep))
    title = F.when(F.col("words").isNotNull(), F.xxhash64(F.replace("words", F.lit(" "), F.lit(""))))
    return folded.withColumn("title_id", title).where("dk is not null or title_id is not null")


def word_sketch(normal: DataFrame) -> list[int]:
    """Word counts of all titles in a fixed number of buckets (bounded whatever the corpus)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        total = np.zeros(SKETCH, dtype=np.int64)

        def settle() -> None:
            for word, n in seen.items():
                total[zlib.crc32(word.encode()) % SKETCH] += n
            seen.clear()

        for batch in batches:
            for words in batch.column(0).to_pylist():
                seen.update(words.split())
            if len(seen) > 500_000:
                settle()
        settle()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = [0] * SKETCH
    counted = normal.select("words").where("words is not null").mapInArrow(count, "bucket int, n bigint")
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def prefix_tokens(words: list[str], rank) -> list[int]:  # noqa: ANN001
    """The index tokens of a title: combinations of its rarest words, tied to their places, its length and its numerals.

    One word: the word and its forms with a letter left out. Two: either word with a form
    of the other. More: combinations of as many of the rarest words as stay whole
    whichever are damaged.
    """
    n = len(words)
    mark = series_mark(words)
    head = f"{n}\x1f{mark}\x1f"
    token = lambda *parts: xxhash.xxh3_64_intdigest(head + "\x1e".join(parts)) - (1 << 63)
    if n == 0:
        return []
    if n == 1:
        return sorted({token(f) for f in shortened_forms(words[0], slips_allowed(words[0], True))})
    if n == 2:
        forms = [shortened_forms(w, slips_allowed(w, i == 1)) for i, w in enumerate(words)]
        return sorted({token(words[0], f) for f in forms[1]} | {token(f, words[1]) for f in forms[0]})
    ranked = sorted(range(n), key=lambda i: (rank(words[i]), i))[:PREFIX]
    size = len(ranked) - damaged_words(n)
    ranked.sort()
    return [token(*(f"{i}\x1d{words[i]}" for i in some)) for some in combinations(ranked, size)]


def signature(words: list[str]) -> int:
    """Four bits of each word's hash, by its place modulo 16: as many of the 16 groups differ as words do, or fewer."""
    out = 0
    for at, word in enumerate(words):
        out ^= (zlib.crc32(word.encode()) >> 7 & 15) << at % 16 * 4
    return out - (1 << 64) if out >> 63 else out


def _groups_apart(a: str, b: str) -> Column:
    """In how many groups of four bits two signatures differ."""
    x = F.col(a).bitwiseXOR(F.col(b))
    any_of = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.bit_count(any_of.bitwiseAND(F.lit(0x1111111111111111)))


def _ranker(sketch: list[int]):  # noqa: ANN202
    ranks: dict[str, tuple[float, int]] = {}

    def rank(word: str) -> tuple[float, int]:
        found = ranks.get(word)
        if found is None:
            if len(ranks) > 500_000:
                ranks.clear()
            crc = zlib.crc32(word.encode())
            # Counts in steps of doubling: the order of rare words does not hang on small changes.
            found = ranks[word] = (math.frexp(sketch[crc % SKETCH])[1], crc)
        return found

    return rank


def postings(titles: DataFrame, sketch: list[int]) -> DataFrame:
    """(tok, text_id, length, sig, open) out of distinct (text_id, words, open)."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = _ranker(sketch)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(0).to_pylist()
                split = [x.split() for x in texts]
                lists = [prefix_tokens(x, rank) for x in split]
                signs = pa.array([signature(x) for x in split], pa.int64())
                rows = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                lengths = pa.array([len(x) - x.count(" ") for x in texts], pa.int32())
                arrays = [pa.array([t for x in lists for t in x], pa.int64()), part.column(1).take(rows), lengths.take(rows), signs.take(rows), part.column(2).take(rows)]
                yield pa.RecordBatch.from_arrays(arrays, names=["tok", "text_id", "length", "sig", "open"])

    return titles.select("words", "text_id", "open").mapInArrow(tokens, "tok bigint, text_id bigint, length int, sig bigint, open boolean")


class AcceptedIndex:
    """Everything accepted so far, as bucketed tables of one folder; ``open`` finds it again.

    ``classes`` holds, by key, the first row of every class of records of a delivery, once
    under its title and once under its DOI, which is a title without year that slips do
    not change; ``titles`` the distinct titles by text; ``postings``
    their tokens; ``similar`` similar titles, in both directions. Every row tells the
    delivery that brought it: in letters, as generated code holds numbers but refers to
    texts, so that all deliveries run the code that the first have compiled.
    """

    KEYS = {"classes": "key", "titles": "text_id", "postings": "tok", "similar": "title_id"}
    SCHEMA = {
        "classes": "key BIGINT, year INT, open BOOLEAN, first_id BIGINT, delivery STRING",
        "titles": "text_id BIGINT, title_id BIGINT, words STRING, open BOOLEAN, delivery STRING",
        "postings": "tok BIGINT, text_id BIGINT, length INT, sig BIGINT, open BOOLEAN, delivery STRING",
        "similar": "title_id BIGINT, other BIGINT, delivery STRING",
    }

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark)}/accepted-{uuid.uuid4().hex[:12]}").rstrip("/")
        self.buckets = buckets or max(8, spark.sparkContext.defaultParallelism)
        self.delivery, self.version, self.sketch = 0, 0, None
        #: Folders from before deliveries were told in letters keep their numbers.
        self.kind = "STRING"
        self._known: set[str] = set()
        self._prefix = f"accepted_{uuid.uuid4().hex[:12]}"

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> AcceptedIndex:
        """The index that an earlier session left in ``folder``."""
        note = json.loads(read_text(spark, f"{folder.rstrip('/')}/note.json"))
        index = cls(spark, folder, note["buckets"])
        index.delivery, index.version, index.sketch = note["delivery"], note["version"], json.loads(read_text(spark, f"{index.folder}/sketch.json"))
        index.kind = note.get("kind", "INT")
        for name in note["tables"]:
            spark.sql(f"CREATE TABLE {index._table(name)} ({index._schema(name)}) USING parquet CLUSTERED BY ({cls.KEYS[name]}) INTO {index.buckets} BUCKETS LOCATION '{index._path(name)}'")
            index._known.add(name)
        return index

    def _table(self, name: str) -> str:
        return f"{self._prefix}_{name}_{self.version}"

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}-{self.version}"

    def _append(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows of this delivery to a table; they come back as the table holds them."""
        columns = [c.split()[0] for c in self.SCHEMA[name].split(", ")]
        made = rows.withColumn("delivery", self._now()).select(*columns).repartition(self.buckets, self.KEYS[name])
        made.write.mode("append").format("parquet").bucketBy(self.buckets, self.KEYS[name]).option("path", self._path(name)).saveAsTable(self._table(name))
        self._known.add(name)
        return self.read(name).where(F.col("delivery") == self._now())

    def _now(self) -> Column:
        """The delivery at hand, as the tables have it."""
        return F.lit(str(self.delivery) if self.kind == "STRING" else self.delivery)

    def _schema(self, name: str) -> str:
        return self.SCHEMA[name].replace("delivery STRING", f"delivery {self.kind}")

    def read(self, name: str) -> DataFrame:
        """A table of the index; an empty one before its first rows."""
        if name not in self._known:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.table(self._table(name))

    def _note(self) -> None:
        """What ``open`` needs to know; a delivery counts from here on."""
        note = {"delivery": self.delivery, "version": self.version, "buckets": self.buckets, "kind": self.kind, "tables": sorted(self._known)}
        write_text(self.spark, f"{self.folder}/note.json", json.dumps(note))

    def compact(self) -> None:
        """Rewrite every table with one file a bucket, as many small deliveries leave many files."""
        frames = {name: self.read(name) for name in sorted(self._known)}
        old = {name: self._table(name) for name in frames}
        self.version += 1
        for name, frame in frames.items():
            made = frame.repartition(self.buckets, self.KEYS[name])
            made.write.format("parquet").bucketBy(self.buckets, self.KEYS[name]).sortBy(self.KEYS[name]).option("path", self._path(name)).saveAsTable(self._table(name))
        self._note()
        for frame, name in zip(frames.values(), old.values()):
            drop(frame)
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        """Forget the tables' names; the files stay for ``open``."""
        for name in self._known:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")

    def ingest(self, papers: DataFrame, link: bool = True) -> DataFrame | None:
        """Probe the index with a delivery (raw_id, title, year, doi), append it, and return the links found."""
        landed = materialize(normalised(papers), "normal")
        links = self.ingest_normalised(landed, link)
        drop(landed)
        return links

    def ingest_normalised(self, normal: DataFrame, link: bool = True) -> DataFrame | None:
        """The same for a delivery that ``normalised`` has prepared.

        (src, dst) are raw ids, directly linked or by way of the first row of a class.
        Rows also meet the rows delivered with them. With ``link`` false (a history known
        to hold no work twice) rows are only accepted, and nothing is returned.
        """
        if self.sketch is None:
            self.sketch = word_sketch(normal)
            write_text(self.spark, f"{self.folder}/sketch.json", json.dumps(self.sketch))
        self.delivery += 1
        of_title = F.struct(F.col("title_id").alias("key"), "year", "open")
        of_doi = F.struct(F.col("dk").alias("key"), F.lit(-1).alias("year"), F.lit(True).alias("open"))
        grouped = normal.groupBy("dk", "open", "title_id", "year").agg(F.min("raw_id").alias("first_id"))
        keyed = grouped.select(F.explode(F.array(of_title, of_doi)).alias("k"), "first_id").where("k.key is not null")
        classes = self._append("classes", keyed.select("k.*", "first_id"))
        texts = normal.where("words is not null").groupBy(F.xxhash64("words").alias("text_id"), "title_id", "words").agg(F.bool_or("open").alias("open"))
        if self.delivery > 1:
            # A title is posted when it is new, and once more when its first row without a DOI of its own comes.
            held = self.read("titles").select("text_id", F.col("open").alias("was_open"))
            met = texts.join(held, "text_id", "left").groupBy("text_id", "title_id", "words", "open").agg(F.bool_or("was_open").alias("was_open"))
            texts = met.where("was_open is null or open and not was_open").drop("was_open")
        new_titles = self._append("titles", texts)
        posted = self._append("postings", postings(new_titles, self.sketch))
        links = None
        if link:
            self._append("similar", self._similar(posted))
            links = self._links(normal, classes)
        self._note()
        return links

    def _similar(self, posted: DataFrame) -> DataFrame:
        """(title_id, other), in both directions: titles of which one was posted now that differ by slips only; one of the two is open."""
        now = posted.select("tok", F.col("text_id").alias("a"), F.col("length").alias("la"), F.col("sig").alias("sa"), F.col("open").alias("oa"))
        ever = self.read("postings").select("tok", F.col("text_id").alias("b"), F.col("length").alias("lb"), F.col("sig").alias("sb"), F.col("open").alias("ob"), (F.col("delivery") == self._now()).alias("fb"))
        # Two titles posted now meet twice, once from either side; one is enough.
        near = (F.col("oa") | F.col("ob")) & (F.abs(F.col("la") - F.col("lb")) <= LENGTH_GAP) & F.when(F.col("fb"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
        # A bucket of the delivery's postings is held; the history's go by it unsorted.
        pairs = ever.join(now.hint("shuffle_hash"), "tok").where(near & (_groups_apart("sa", "sb") <= MOST_DAMAGED)).select("a", "b").distinct()
        words = self.read("titles")
        both = pairs.join(words.select(F.col("text_id").alias("a"), F.col("title_id").alias("ta"), F.col("words").alias("wa")), "a")
        both = both.join(words.select(F.col("text_id").alias("b"), F.col("title_id").alias("tb"), F.col("words").alias("wb")), "b").where("ta <> tb")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = pa.array([same_but_slips(x.split(), y.split()) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
                a, b = batch.column(0).filter(keep), batch.column(1).filter(keep)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([b, a])], names=["title_id", "other"])

        return both.select("ta", "tb", "wa", "wb").mapInArrow(verify, "title_id bigint, other bigint").distinct()

    def _links(self, normal: DataFrame, classes: DataFrame) -> DataFrame:
        """Rows with the first of their class, and classes with the first of each place they meet at.

        A DOI is a place that all its rows visit. A title and year is one where a row
        without a DOI of its own has them; rows of the same or a similar title and a
        matching year go there. A class is a place of its rows, too (``same``). All of a
        place are linked to its first.
        """
        held, similar = self.read("classes").drop("delivery"), self.read("similar").select(F.col("title_id").alias("key"), F.col("other").alias("met"))
        own_and_met = F.explode(F.array("key", "met")).alias("found")
        touched = classes.select("key").distinct().join(similar, "key", "left").select(own_and_met).where("found is not null").distinct()
        touched = touched.withColumnRenamed("found", "key").join(similar, "key", "left")
        meets = touched.select(F.col("key").alias("place"), own_and_met).where("found is not null").distinct().withColumnRenamed("found", "key")
        # Read four times below; written, it is planned once.
        guests = materialize(meets.join(held, "key"), "guests")
        places = guests.where("open and place = key").select("place", F.col("year").alias("at")).distinct()
        in_year = (F.col("year") == -1) | (F.col("at") == -1) | (F.abs(F.col("year") - F.col("at")) <= YEAR_GAP)
        visits = guests.join(places, "place").where(in_year).select("place", "at", F.col("first_id").alias("src"), F.lit(False).alias("same"))
        cid = F.xxhash64("dk", "open", F.coalesce("title_id", F.lit(0)), "year")
        visits = visits.unionByName(normal.select(cid.alias("place"), "year", F.col("raw_id").alias("src"), F.lit(True).alias("same")).withColumnRenamed("year", "at"))
        heads = visits.groupBy("place", "at", "same").agg(F.min("src").alias("dst"), F.max("src").alias("last")).where("dst <> last").drop("last")
        met = visits.join(heads, ["place", "at", "same"]).select("src", "dst")
        links = materialize(met.where("src <> dst").distinct(), "links")
        drop(guests)
        return links


def duplicates_against_history(papers: DataFrame) -> DataFrame:
    """(first_id, raw_id) for rows of batch 1 and later that describe a work seen before.

    Batch 0 is accepted as it is; the later batches are delivered to the index one by one
    in their order, each probing what came before it. Rows without own DOI and title
    match nothing, as do rows without a batch; null years match any; repeated raw_ids
    count once; extra columns are ignored; empty tables give empty results.
    """
    with brief_plans(papers.sparkSession):
        return _delivered(papers)


def _delivered(papers: DataFrame) -> DataFrame:
    spark = papers.sparkSession
    landed = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex[:12]}"
    made = normalised(papers.where("batch_no is not null"), "batch_no")
    made.write.partitionBy("batch_no").parquet(landed)
    normal = spark.read.schema(made.schema).parquet(landed)
    index, found = AcceptedIndex(spark), None
    for number in sorted(r[0] for r in normal.select("batch_no").distinct().collect()):
        part = index.ingest_normalised(normal.where(F.col("batch_no") == number).drop("batch_no"), link=number > 0)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    index.close()
    if found is None:
        return normal.select(F.col("raw_id").alias("first_id"), "raw_id").limit(0)
    groups = connected_components(found)
    late = normal.where("batch_no >= 1").select("raw_id").distinct()
    return groups.where("node <> component").join(late, F.col("node") == F.col("raw_id"), "left_semi").select(F.col("component").alias("first_id"), F.col("node").alias("raw_id"))
