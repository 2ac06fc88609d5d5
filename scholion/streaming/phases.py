"""A live delta brought into a corpus: fields filled, gaps injected, outside citers listed, in this order per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scholion.operators import relational as R
from scholion.streaming.live import VersionedTable, phases_stream

CORPUS = "raw_id BIGINT, openalex_id STRING, abstract STRING, doi STRING, filled STRING, injected BOOLEAN"
CITERS = "raw_id BIGINT, citer STRING, year INT, citations INT"
#: Citers that are kept of a record, the latest and most cited first: the operator's feature.
CITERS_KEPT = 300


class Phases:
    """The corpus and its outside citers as versioned tables in a folder; a version is a micro-batch.

    Versions are numbered by the stream's batches, so a batch that is replayed after a
    failure finds its version and changes nothing. Every phase reads what those before it
    wrote for the same batch.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.corpus = VersionedTable(spark, f"{folder}/corpus", CORPUS)
        self.citers = VersionedTable(spark, f"{folder}/citers", CITERS)
        self.folder = folder.rstrip("/")

    def start(self, corpus: DataFrame) -> None:
        """The corpus (raw_id, openalex_id, abstract, doi) as it is before the first batch."""
        self.corpus.commit(corpus.select("raw_id", "openalex_id", "abstract", "doi", F.lit("").alias("filled"), F.lit(False).alias("injected")), 0)

    def fill(self, works: DataFrame, version: int) -> None:
        """What records lack, from the first work of the same id; what is there stays, what was filled is noted."""
        fresh = R.first_wins(works.where("openalex_id is not null").select("openalex_id", "abstract", "doi", "raw_id"), ["openalex_id"], [F.col("raw_id")]).drop("raw_id")
        before = self.corpus.read().withColumnRenamed("filled", "was")
        merged = R.fill_missing(before, fresh, "openalex_id", {"abstract": "string", "doi": "string"})
        noted = F.array_join(F.array_union(F.filter(F.split("was", ","), lambda x: x != ""), "filled"), ",")
        self.corpus.commit(merged.select("raw_id", "openalex_id", "abstract", "doi", noted.alias("filled"), "injected"), 2 * version - 1)

    def inject(self, works: DataFrame, version: int) -> None:
        """Works that the corpus does not have, each once."""
        new = works.select("raw_id", "openalex_id", "abstract", "doi", F.lit("").alias("filled"), F.lit(True).alias("injected"))
        self.corpus.commit(R.insert_new(self.corpus.read(), new, "openalex_id", "raw_id"), 2 * version)

    def cite(self, works: DataFrame, version: int) -> None:
        """Works that cite records, united with the citers known (which win) and cut to the most notable."""
        refs = works.where("openalex_id is not null").select(F.col("openalex_id").alias("citer"), "year", F.col("citation_count").alias("citations"), F.explode("referenced_works").alias("openalex_id"))
        found = refs.join(self.corpus.read().select("raw_id", "openalex_id"), "openalex_id").groupBy("raw_id", "citer").agg(F.max("year").alias("year"), F.max("citations").alias("citations"))
        order = [F.coalesce("year", F.lit(0)).desc(), F.coalesce("citations", F.lit(0)).desc(), F.col("citer")]
        self.citers.commit(R.union_capped(self.citers.read(), found, "raw_id", "citer", order, CITERS_KEPT).drop("place"), version)

    def run(self, works: DataFrame, checkpoint: str | None = None) -> None:
        """All that is waiting in a stream of works (raw_id, openalex_id, abstract, doi, year, citation_count, referenced_works)."""
        phases_stream(works, [self.fill, self.inject, self.cite], checkpoint or f"{self.folder}/checkpoint").awaitTermination()
