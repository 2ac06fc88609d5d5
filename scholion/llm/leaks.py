"""Problem 9: evaluation texts leaking into training text.

Every window of item size in a document and in an item gets a SimHash of its words.
Multi-index Hamming search finds all item windows within the radius: cut into one block
more than the radius, two such fingerprints agree in a block. Exact similarity of the
windows' weighted shingles then verifies the candidates, and what is asked beyond that
(equal words in order) is checked on those. Items whose windows fit a stated bound are
searched in memory, in one pass over the documents; more are joined by Hamming block.
"""

from __future__ import annotations

import html
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

WINDOW = 12
SHINGLE = 5
RADIUS = 3
BITS = 64
#: Similarity of weighted shingles from which a window is a near copy.
SIMILAR = 0.8
#: Letters of items up to which their windows are held in memory.
LETTERS_HELD = 20_000_000

WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")
MARKUP = regex.compile(r"</?[a-zA-Z][^<>]*>|\\[a-zA-Z]+\s*(?=\{)|[{}]|[\p{Cf}]|[*_]{1,3}(?=\w)|(?<=\w)[*_]{1,3}")


def words_of(text: str | None) -> list[str]:
    """Words (runs of letters or digits) without case, markup, width and invisible characters."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    text = unicodedata.normalize("NFKC", text) if not text.isascii() else text
    return WORD.findall(MARKUP.sub("", text).casefold())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def fingerprints(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """SimHash of every window of consecutive words, as uint64."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = 1 << 15
    for at in range(0, n, step):
        part = hashes[at : min(at + step, n) + window - 1]
        signs = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8)
        sums = np.zeros((len(part) + 1, BITS), np.int32)
        np.cumsum(signs, axis=0, dtype=np.int32, out=sums[1:])
        ones = sums[window:] - sums[:-window]
        out[at : at + len(ones)] = np.packbits(ones * 2 > window, axis=1).view("<u8").ravel()
    return out


def weighted_similarity(a: list[str], b: list[str], size: int = SHINGLE) -> float:
    """Jaccard similarity of two windows' word shingles, each weighing as many letters as it has."""
    bags = [Counter(tuple(x[i : i + size]) for i in range(max(1, len(x) - size + 1))) for x in (a, b)]
    weight = lambda bag: sum(n * sum(map(len, s)) for s, n in bag.items())
    whole = weight(bags[0] | bags[1])
    return weight(bags[0] & bags[1]) / whole if whole else 0.0


class ItemIndex:
    """Fingerprints of all windows of a bounded set of items, by Hamming block."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, radius: int = RADIUS) -> None:
        self.window, self.radius = window, radius
        hashes = _Hashes()
        prints, self.owner, self.words = [], [], []
        for key, text in items:
            words = words_of(text)
            found = fingerprints(np.array([hashes[w] for w in words], np.uint64), window)
            prints.append(found)
            self.owner += [key] * len(found)
            self.words += [words[i : i + window] for i in range(len(found))]
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.blocks = radius + 1
        self.width = BITS // self.blocks
        self.order, self.sorted, self.hit = [], [], []
        for block in range(self.blocks):
            values = self._block(self.prints, block)
            order = np.argsort(values, kind="stable")
            table = np.zeros(1 << self.width, bool)
            table[values] = True
            self.order.append(order)
            self.sorted.append(values[order])
            self.hit.append(table)

    def _block(self, prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(block * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position, item window) whose fingerprints differ in at most ``radius`` bits."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block in range(self.blocks):
            values = self._block(prints, block)
            at = np.flatnonzero(self.hit[block][values])
            for start in range(0, len(at), 1 << 17):
                part = at[start : start + (1 << 17)]
                low = np.searchsorted(self.sorted[block], values[part], "left")
                count = np.searchsorted(self.sorted[block], values[part], "right") - low
                who = np.repeat(part, count)
                inner = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                item = self.order[block][np.repeat(low, count) + inner]
                near = np.bitwise_count(prints[who] ^ self.prints[item]) <= self.radius
                left.append(who[near])
                right.append(item[near])
        return np.concatenate(left), np.concatenate(right)


def _judged(here: list[str], there: list[str], similarity: float) -> tuple[bool, bool]:
    """Whether two windows are near copies, and whether they are equal."""
    equal = here == there
    return equal or weighted_similarity(here, there) >= similarity, equal


def _texts(keys: list, texts: list, window: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Blocks of documents as (words, place of each word's document); those too short for a window are left out."""
    at = 0
    while at < len(texts):
        words: list[str] = []
        owner: list[int] = []
        while at < len(texts) and (not words or len(words) < 100_000):
            own = words_of(texts[at]) if keys[at] is not None else []
            if len(own) >= window:
                words += own
                owner += [at] * len(own)
            at += 1
        if words:
            yield words, np.array(owner)


def near_copies(documents: DataFrame, items: DataFrame, similarity: float = SIMILAR, window: int = WINDOW, held: int = LETTERS_HELD) -> DataFrame:
    """(doc_id, item_id, equal): documents with a window that is a near copy of one of an item, each pair once.

    Candidates are all windows whose fingerprints are within the radius; weighted
    shingles of at least ``similarity`` make them near copies, and ``equal`` tells
    whether some window has the item's very words in order. Items and texts that are
    null, blank or shorter than the window leak nothing; repeated rows count once.
    Windows of a document are compared within their task, whatever a source's share of
    all rows, unless the items have more than ``held`` letters and are joined instead.
    """
    keys = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    if (keys.agg(F.sum(F.length("text"))).first()[0] or 0) > held:
        return _joined_copies(documents, keys, similarity, window)
    kind = documents.schema["doc_id"].dataType.simpleString()
    index = documents.sparkSession.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in keys.collect()], window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = index.value, _Hashes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found: dict[tuple, bool] = {}
            for words, docs in _texts(ids, batch.column(1).to_pylist(), window):
                if not len(known.prints):
                    continue
                prints = fingerprints(np.array([hashes[w] for w in words], np.uint64), window)
                whole = docs[: len(prints)] == docs[window - 1 :]
                place, item = known.within_radius(prints)
                keep = whole[place]
                for p, i in zip(place[keep].tolist(), item[keep].tolist()):
                    pair = (ids[docs[p]], known.owner[i])
                    if not found.get(pair):
                        near, equal = _judged(words[p : p + window], known.words[i], similarity)
                        if near:
                            found[pair] = equal
            rows = list(found)
            arrays = [pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([found[r] for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "equal"])

    hits = documents.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, item_id bigint, equal boolean")
    return hits.groupBy("doc_id", "item_id").agg(F.bool_or("equal").alias("equal"))


def _windows(frame: DataFrame, key: str, window: int) -> DataFrame:
    """(key, block, part, print, words): every window under each of the Hamming blocks of its fingerprint."""
    kind = frame.schema[key].dataType.simpleString()
    width = BITS // (RADIUS + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for words, docs in _texts(ids, batch.column(1).to_pylist(), window):
                prints = fingerprints(np.array([hashes[w] for w in words], np.uint64), window)
                at = np.flatnonzero(docs[: len(prints)] == docs[window - 1 :])
                texts = [" ".join(words[p : p + window]) for p in at.tolist()]
                arrays = [pa.array([ids[i] for i in docs[at].tolist()], batch.column(0).type), pa.array(prints[at].view(np.int64)), pa.array(texts)]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "print", "words"])

    made = frame.select(key, "text").mapInArrow(cut, f"`{key}` {kind}, print bigint, words string").distinct()
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("print", b * width).bitwiseAND((1 << width) - 1).alias("part")) for b in range(RADIUS + 1)])
    return made.select(key, "print", "words", F.explode(blocks).alias("x")).select(key, "x.block", "x.part", "print", "words")


def _joined_copies(documents: DataFrame, items: DataFrame, similarity: float, window: int) -> DataFrame:
    """The same by a join of the windows' Hamming blocks, for items that no task can hold."""
    a, b = _windows(documents, "doc_id", window), _windows(items, "item_id", window)
    b = b.select("item_id", "block", "part", F.col("print").alias("other"), F.col("words").alias("their"))
    close = a.join(b, ["block", "part"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= RADIUS)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [_judged(x.split(), y.split(), similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            near = pa.array([j[0] for j in judged], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near), pa.array([j[1] for j in judged], pa.bool_()).filter(near)], names=["doc_id", "item_id", "equal"])

    pairs = close.select("doc_id", "item_id", "words", "their").distinct()
    return pairs.mapInArrow(verify, f"doc_id {kind}, item_id bigint, equal boolean").groupBy("doc_id", "item_id").agg(F.bool_or("equal").alias("equal"))


def leaked_items(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id): of the near copies those with ``window`` consecutive words of the item."""
    return near_copies(documents, items, SIMILAR, window).where("equal").select("doc_id", "item_id")
