"""Joins, deduplication and merges of keyed records."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, LongType

from scholion.functions.text import has_value
from scholion.runtime import drop, materialize


def prioritized_match(left: DataFrame, right: DataFrame, keys: list[tuple[str, Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, matched_by): the right row by the first of several keys that finds one.

    ``keys`` are (name, left key, right key) in order of priority. Keys are exploded so
    that one join serves them all; among rows of one key the least right id wins, found
    by aggregation before the join. Null and blank keys match nothing.
    """
    pack = lambda side: F.filter(F.array(*[F.struct(F.lit(i).alias("p"), (k[1] if side else k[2]).cast("string").alias("k")) for i, k in enumerate(keys)]), lambda x: has_value(x["k"]))
    probes = left.select(F.col(left_id), F.explode(pack(True)).alias("x")).select(left_id, "x.p", "x.k")
    known = right.select(F.col(right_id), F.explode(pack(False)).alias("x")).select(right_id, "x.p", "x.k").groupBy("p", "k").agg(F.min(right_id).alias(right_id))
    best = probes.join(known, ["p", "k"]).groupBy(left_id).agg(F.min(F.struct("p", right_id)).alias("b"))
    names = F.array(*[F.lit(k[0]) for k in keys])
    return best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.element_at(names, F.col("b.p") + 1).alias("matched_by"))


def first_wins(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; the order must end in something unique."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_place", place).where("_place = 1").drop("_place")


def richest_wins(frame: DataFrame, key: str, ident: str, score: Column) -> DataFrame:
    """(key, ident, score): of each key the row with the greatest score, ties to the least id, by one aggregation."""
    return frame.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(score.alias("s"), (-F.col(ident)).alias("i"))).alias("b")).select(key, (-F.col("b.i")).alias(ident), F.col("b.s").alias("score"))


def fill_missing(target: DataFrame, updates: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """``target`` with the fields it lacks taken from ``updates`` (unique by key), and which were filled.

    ``fields`` gives each field's kind (string, array or other). What is there stays.
    """
    fresh = updates.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = target.join(fresh, key, "left")
    gains = {f: ~has_value(F.col(f), kind) & has_value(F.col(f"_{f}"), kind) for f, kind in fields.items()}
    filled = F.array_compact(F.array(*[F.when(g, F.lit(f)) for f, g in gains.items()]))
    out = {f: F.when(g, F.col(f"_{f}")).otherwise(F.col(f)) for f, g in gains.items()}
    return joined.withColumn("_filled", filled).withColumns(out).drop(*[f"_{f}" for f in fields]).withColumnRenamed("_filled", "filled")


def union_capped(existing: DataFrame, incoming: DataFrame, group: str, item: str, order: list[Column], cap: int) -> DataFrame:
    """Rows of both, one per (group, item) with the existing one preferred, the first ``cap`` of each group.

    The cap is the operator's feature: a list of bounded length per record.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    one = first_wins(both, [group, item], [F.col("_new"), *order])
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return one.withColumn("place", place).where(F.col("place") <= cap).drop("_new")


def set_union_lists(frames: list[DataFrame], key: str, items: str) -> DataFrame:
    """(key, items): the sorted set of all items that the frames list for a key."""
    exploded = reduce(DataFrame.unionByName, [f.select(key, F.explode(items).alias("_i")) for f in frames])
    return exploded.where("_i is not null").groupBy(key).agg(F.array_sort(F.collect_set("_i")).alias(items))


def demote(frame: DataFrame, condition: Column, heavy: list[str], reason: str) -> DataFrame:
    """Rows meeting ``condition`` become stubs: their heavy columns are cleared and the reason noted."""
    hit = F.coalesce(condition, F.lit(False))
    out = {c: F.when(hit, F.lit(None)).otherwise(F.col(c)) for c in heavy}
    return frame.withColumns(out).withColumn("is_stub", hit | F.coalesce(F.col("is_stub"), F.lit(False))).withColumn("demoted_for", F.when(hit, reason))


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The new state of a table: the latest change per key over what was there (copy on write)."""
    latest = first_wins(changes, [key], [F.col(order).desc()])
    return latest.unionByName(target.join(latest.select(key), key, "left_anti"))


def similar_sets(left: DataFrame, ident: str, tokens: str, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of rows whose token sets have a Jaccard similarity of at least ``threshold``.

    Exact set-similarity join over distinct sets: rows with the same set stand behind
    their least id (``set_members`` has who stands behind whom), tokens are ordered by
    rarity, and only the prefix that two similar sets must share is joined.
    """
    sets = left.select(ident, F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") > 0)
    reps = sets.groupBy("t").agg(F.min(ident).alias("id")).select("id", "t")
    df = reps.select(F.explode("t").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    ranked = reps.select("id", F.explode("t").alias("tok")).join(df, "tok").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("r"))
    n = F.size("r")
    kept = (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    prefix = ranked.select("id", n.alias("n"), F.explode(F.slice("r", F.lit(1), kept)).alias("x")).select("id", "n", F.col("x.tok").alias("tok"))
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "tok"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "tok")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - F.lit(1e-9))
    pairs = a.join(b, "tok").where(near).select("a", "b").distinct()
    text = reps.select("id", "t")
    both = pairs.join(text.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(text.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", (common / (F.size("ta") + F.size("tb") - common)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def set_members(left: DataFrame, ident: str, tokens: str) -> DataFrame:
    """(ident, representative): for every row with tokens the least id of the rows with the same token set."""
    sets = left.select(ident, F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") > 0).distinct()
    return sets.join(sets.groupBy("t").agg(F.min(ident).alias("representative")), "t").select(ident, "representative")


#: Letters of a run that is looked up, and neighbouring runs of which the least by hash stands for all.
RUN, NEIGHBOURS = 12, 8


@F.pandas_udf(ArrayType(LongType()))
def least_runs(texts: pd.Series) -> pd.Series:
    """Of each NEIGHBOURS neighbouring runs of RUN letters the least by hash; what a text holds has no others than the text."""

    def one(text: str) -> list[int]:
        runs = [xxhash.xxh3_64_intdigest(text[i : i + RUN]) - (1 << 63) for i in range(len(text) - RUN + 1)]
        return sorted({min(runs[i : i + NEIGHBOURS]) for i in range(len(runs) - NEIGHBOURS + 1)})

    return texts.map(one)


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(s, l): ids of the texts of ``short`` that stand anywhere in a longer text of ``long``; both are (id, t) of distinct texts.

    A text with enough letters is looked up by the rarest of its least runs, all of
    which the longer text must have; a shorter one among all substrings of its length.
    Empty texts stand in nothing.
    """
    enough = RUN + NEIGHBOURS - 1
    whole = F.length("t") >= enough
    index = long.where(whole).select(F.col("id").alias("l"), F.explode(least_runs("t")).alias("run"))
    probes = short.where(whole).select(F.col("id").alias("s"), F.explode(least_runs("t")).alias("run"))
    counted = probes.join(index.groupBy("run").agg(F.count(F.lit(1)).alias("df")), "run", "left")
    rarest = counted.groupBy("s").agg(F.count_if(F.col("df").isNull()).alias("lost"), F.min_by("run", F.struct("df", "run")).alias("run")).where("lost = 0")
    pairs = rarest.join(index, "run").select("s", "l")
    sides = pairs.join(short.select(F.col("id").alias("s"), F.col("t").alias("ts")), "s").join(long.select(F.col("id").alias("l"), F.col("t").alias("tl")), "l")
    found = sides.where((F.length("ts") < F.length("tl")) & F.contains("tl", "ts")).select("s", "l")
    brief = short.where(~whole & (F.col("t") != ""))
    lengths = sorted(r[0] for r in brief.select(F.length("t")).distinct().collect())
    for n in lengths:
        parts = long.where(F.length("t") > n).select(F.col("id").alias("l"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.substring("t", i, F.lit(n))))).alias("t"))
        found = found.unionByName(brief.where(F.length("t") == n).select(F.col("id").alias("s"), "t").join(parts, "t").select("s", "l"))
    return found


#: Buckets of letter runs, letters a length band spans, and texts of one side that are compared at a time.
BUCKETS, BAND, CELL = 2048, 8, 2000


def _run_buckets(texts: list[str], n: int) -> np.ndarray:
    """For each text the buckets that its runs of n letters fall in, as 0 and 1."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for row, text in enumerate(texts):
        out[row, [hash(text[i : i + n]) % BUCKETS for i in range(len(text) - n + 1)]] = 1
    return out


def _common_letters(places: dict[str, int], size: int, text: str) -> int:
    """The longest common subsequence of a text and one of ``size`` letters, given as bits of the places of each letter."""
    whole = open_ = (1 << size) - 1
    for char in text:
        hit = open_ & places.get(char, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & whole
    return size - open_.bit_count()


def sequence_ratios(xs: list[str], ys: list[str], least: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio): the pairs of texts whose SequenceMatcher ratio is at least ``least``.

    With the ratio come at most (1 - least) of all letters left over; each takes n runs
    of n letters from its own text and n - 1 from the other, so pairs with fewer buckets
    in common are out, as are lengths too far apart. What SequenceMatcher matches is a
    common subsequence, so the longest one bounds the ratio; the rest are compared.
    """
    lx, ly = np.array([[len(x)] for x in xs], dtype=np.float64), np.array([[len(y) for y in ys]], dtype=np.float64)
    kept = least / 2 * (lx + ly)
    over_x, over_y = lx - kept, ly - kept
    fits = (over_x >= -1e-6) & (over_y >= -1e-6)
    for n in (2, 3):
        p, q = _run_buckets(xs, n), _run_buckets(ys, n)
        both = p @ q.T
        fits &= both >= p.sum(axis=1)[:, None] - n * over_x - (n - 1) * over_y - 1e-6
        fits &= both >= q.sum(axis=1)[None, :] - n * over_y - (n - 1) * over_x - 1e-6
    matcher, last = difflib.SequenceMatcher(None), -1
    for j, i in np.argwhere(fits.T).tolist():
        x, y = xs[i], ys[j]
        if j != last:
            matcher.set_seq2(y)
            places: dict[str, int] = {}
            for at, char in enumerate(y):
                places[char] = places.get(char, 0) | 1 << at
            last = j
        if 2 * _common_letters(places, len(y), x) >= least * (len(x) + len(y)) - 1e-9:
            matcher.set_seq1(x)
            if (ratio := matcher.ratio()) >= least:
                yield i, j, ratio


def similar_sequences(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(x, y, ratio): ids of texts of the two sides whose SequenceMatcher ratio is at least ``least``; both are (id, t) of distinct texts.

    All texts of lengths that may reach the ratio are compared, in cells of bounded
    size, by a bound that loses nothing. The work grows with the product of the sides.
    """

    def celled(frame: DataFrame) -> tuple[DataFrame, int]:
        banded = frame.where("t <> ''").withColumn("band", F.floor(F.length("t") / BAND).cast("int"))
        most = banded.groupBy("band").count().agg(F.max("count")).first()[0] or 0
        return banded, max(1, math.ceil(most / CELL))

    def compare(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        found = list(sequence_ratios(xs["t"].tolist(), ys["t"].tolist(), least)) if len(xs) and len(ys) else []
        return pd.DataFrame({"x": [xs["id"].iat[i] for i, _, _ in found], "y": [ys["id"].iat[j] for _, j, _ in found], "ratio": [r for *_, r in found]}).astype({"x": "int64", "y": "int64", "ratio": "float64"})

    (a, na), (b, nb) = celled(left), celled(right)
    # Of lengths m < n the ratio is at most 2m / (m + n); a text goes to all cells of the bands it may match.
    wide = (2 - least) / least
    low = lambda: F.floor(F.length("t") / F.lit(wide * BAND) - F.lit(1e-6)).cast("int")
    high = lambda: F.floor(F.length("t") * F.lit(wide / BAND) + F.lit(1e-6)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("t"), F.lit(n)).cast("int")
    spread = lambda f, n, c: f.withColumn(c, F.explode(F.sequence(F.greatest(low(), F.lit(0)), high()))).withColumn(f"s{c}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ga = spread(a.select("id", "t", F.col("band").alias("ba"), own(na).alias("sba")), nb, "bb")
    gb = spread(b.select("id", "t", F.col("band").alias("bb"), own(nb).alias("sbb")), na, "ba")
    keys = ["ba", "sba", "bb", "sbb"]
    return ga.groupBy(*keys).cogroup(gb.groupBy(*keys)).applyInPandas(lambda x, y: compare(x, y), "x bigint, y bigint, ratio double")


def sequential_dedup(frame: DataFrame, keys: list[tuple[str, Column]], order: str) -> DataFrame:
    """Rows kept in order of arrival: a row goes if any of its keys was held by a row that arrived before it.

    A key is held by its first bearer, kept or not, which makes the test one join per
    key instead of an ordered pass over all rows; where only kept rows held keys, chains
    of partial matches would keep more. Null and blank keys are held by nobody.
    """
    pack = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), k.cast("string").alias("k")) for n, k in keys]), lambda x: has_value(x["k"]))
    held = frame.select(order, F.explode(pack).alias("x")).select(order, "x.n", "x.k")
    late = held.join(held.groupBy("n", "k").agg(F.min(order).alias("first")), ["n", "k"]).where(F.col(order) > F.col("first"))
    return frame.join(late.select(order).distinct(), order, "left_anti")


def set_fields(target: DataFrame, updates: DataFrame, key: str, fields: dict[str, str], order: str | None = None, keep: bool = False) -> DataFrame:
    """``target`` with fields overwritten from ``updates`` where a row's key has an update; other rows stay as they are.

    ``fields`` maps a column of the target to one of the updates. Of several updates of a
    key the last by ``order`` counts; keys that the target lacks are ignored, as are
    null keys. With ``keep`` a null in the update leaves the old value.
    """
    columns = list(dict.fromkeys(fields.values()))
    fresh = updates.where(F.col(key).isNotNull())
    if order:
        fresh = fresh.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_u"))
    else:
        fresh = fresh.select(key, F.struct(*columns).alias("_u"))
    hit = F.col("_u").isNotNull()
    value = lambda f, c: F.when(hit & (F.col(f"_u.{c}").isNotNull() if keep else F.lit(True)), F.col(f"_u.{c}"))
    return target.join(fresh, key, "left").withColumns({f: (value(f, c).otherwise(F.col(f)) if f in target.columns else value(f, c)) for f, c in fields.items()}).drop("_u")


def delete_keys(target: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``target`` without the rows of the given keys."""
    return target.join(gone.select(key), key, "left_anti")


def insert_new(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``target`` and the incoming rows whose key it lacks, the first of each key by ``order``; null keys are not inserted."""
    fresh = first_wins(incoming.where(F.col(key).isNotNull()), [key], [F.col(order)])
    return target.unionByName(fresh.join(target.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti"))


def merge_groups(frame: DataFrame, group: str, ident: str, sets: list[str], firsts: list[str], maps: list[str]) -> DataFrame:
    """One row per group under its least id: list columns as the sorted set of all items, scalars the first value there is by id, maps with the least id's entries first.

    Lists are exploded and distinct before they meet, so a group's rows are never gathered beyond their distinct items.
    """
    base = frame.groupBy(group).agg(F.min(ident).alias(ident), F.count(F.lit(1)).alias("members"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ident))).alias(c) for c in firsts])
    for c in sets:
        items = frame.select(group, F.explode(c).alias("_i")).where("_i is not null").distinct().groupBy(group).agg(F.array_sort(F.collect_list("_i")).alias(c))
        base = base.join(items, group, "left").withColumn(c, F.coalesce(c, F.array().cast(dict(frame.dtypes)[c])))
    for c in maps:
        entries = frame.select(group, ident, F.explode(c).alias("_k", "_v")).groupBy(group, "_k").agg(F.min_by("_v", ident).alias("_v"))
        base = base.join(entries.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(c)), group, "left")
    return base


def arrival_dedup(frame: DataFrame, keys: list[tuple[str, Column]], order: str, max_rounds: int = 100) -> DataFrame:
    """Rows kept in order of arrival: a row goes if any of its keys is held by a *kept* row that arrived before it.

    Decided in rounds instead of one ordered pass: a row that is the first undecided one of
    all its keys stays, which rules out the others of those keys. Rows that share no key
    with an undecided one are decided at once, so rounds follow the longest chain of
    partial matches. Null and blank keys are held by nobody; ``order`` must be unique.
    """
    pack = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), k.cast("string").alias("k")) for n, k in keys]), lambda x: has_value(x["k"]))
    held = materialize(frame.select(F.col(order).alias("o"), F.explode(pack).alias("x")).select("o", "x.n", "x.k"), "held")
    gone: list[DataFrame] = []
    for _ in range(max_rounds):
        firsts = held.groupBy("n", "k").agg(F.min("o").alias("first"))
        judged = held.join(firsts, ["n", "k"])
        kept = materialize(judged.groupBy("o").agg(F.bool_and(F.col("o") == F.col("first")).alias("all")).where("all").select("o"), "kept")
        taken = held.join(kept, "o", "left_semi").select("n", "k").distinct()
        out = materialize(held.join(taken, ["n", "k"], "left_semi").join(kept, "o", "left_anti").select("o").distinct(), "gone")
        gone.append(out)
        rest = materialize(held.join(kept, "o", "left_anti").join(out, "o", "left_anti"), "held")
        drop(held)
        held = rest
        if not held.limit(1).count():
            return frame.join(reduce(DataFrame.unionByName, gone).select(F.col("o").alias(order)), order, "left_anti")
    raise RuntimeError("deduplication did not settle")
