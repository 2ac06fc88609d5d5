"""Problem 3: visually identical text with different characters.

Every text is first brought to its canonical decomposition, marks in canonical order, so
that only letters and marks are left to compare. Look-alike classes are the transitive
closure, by union-find, of equalities between strings and code points: compatibility
decompositions (by Unicode's own rules), kinds of space, hyphen look-alikes, and letters
of other scripts with the same glyph. A class is represented by its member most frequent
in the corpus; text is rewritten greedily (leftmost, longest) by an Aho-Corasick automaton
over all members, until nothing changes.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Letters of Greek, Cyrillic and others, each with the Latin letter of the same glyph.
SAME_GLYPH = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ɡ": "g", "ɑ": "a",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Օ": "O", "Տ": "S", "Ս": "U", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j",
}
# Hyphens of one look (dashes of other lengths stay apart).
HYPHENS = "-‐‑﹣－"


# Unicode's decomposition tags that keep a character's look but for width, style or the place in a word.
LIKE_TAGS = ("", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")


def plain(char: str) -> str:
    """The compatibility form of a character, unless it would look different (raised, circled and so on)."""
    tag = unicodedata.decomposition(char).partition(">")[0]
    tag = f"{tag}>" if tag.startswith("<") else ""
    return unicodedata.normalize("NFKC", char) if tag in LIKE_TAGS else char


def invisible(char: str) -> bool:
    """Format characters, variation selectors and fillers, which leave no mark."""
    return unicodedata.category(char) == "Cf" or "︀" <= char <= "️" or char in "͏ᅟᅠ឴឵ㅤﾠ"


class Classes:
    """Union-find over strings; every class has one representative."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, item: str) -> str:
        self.parent.setdefault(item, item)
        while self.parent[item] != item:
            self.parent[item] = self.parent[self.parent[item]]
            item = self.parent[item]
        return item

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for item in list(self.parent):
            out.setdefault(self.find(item), []).append(item)
        return out


def build_rewrites(counts: dict[str, int]) -> dict[str, str]:
    """member -> representative for the code points of a corpus, counted in ``counts``; both canonically decomposed."""
    classes = Classes()
    seen: Counter[str] = Counter()
    for char, n in counts.items():
        for part in unicodedata.normalize("NFD", char):
            seen[part] += n
    for char in sorted(set(seen) | set(counts) | set(SAME_GLYPH) | set(SAME_GLYPH.values())):
        own, wide = unicodedata.normalize("NFD", char), unicodedata.normalize("NFD", plain(char))
        if char.isspace() or wide.isspace():
            classes.union(own, " ")
        elif invisible(char):
            classes.union(own, "")
        elif char in HYPHENS:
            classes.union(own, "-")
        elif wide != own and wide:
            classes.union(own, wide)
        if char in SAME_GLYPH:
            classes.union(char, SAME_GLYPH[char])
    rewrites = {}
    for items in classes.members().values():
        # The empty string and the space stand for their own classes; else the most frequent member, ties by code points.
        best = next((x for x in ("", " ") if x in items), None)
        if best is None:
            best = min(items, key=lambda x: (-min((seen.get(c, 0) for c in x), default=0), len(x), x))
        rewrites |= {x: best for x in items if x and x != best}
    return rewrites


class Rewriter:
    """Greedy leftmost-longest rewriting of text to its representatives."""

    def __init__(self, rewrites: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for member, best in rewrites.items():
            self.automaton.add_word(member, (len(member), best))
        self.ascii = any(m.isascii() for m in rewrites)
        if rewrites:
            self.automaton.make_automaton()
        self.empty = not rewrites

    def once(self, text: str) -> str:
        out, at = [], 0
        if not self.empty:
            for end, (length, best) in self.automaton.iter_long(text):
                out += text[at : end - length + 1], best
                at = end + 1
        return unicodedata.normalize("NFD", "".join(out) + text[at:] if at else text)

    def __call__(self, text: str) -> str:
        """Passes follow one another until the text is stable (removing a mark may join others)."""
        if text.isascii() and not self.ascii:
            return text
        text = unicodedata.normalize("NFD", text)
        passed: list[str] = []
        while (new := self.once(text)) != text:
            if new in passed:
                # Should representatives rewrite one another, the least of the circle stands for it.
                return min(passed[passed.index(new) :])
            passed.append(new)
            text = new
        return text


def char_counts(texts: Iterable[DataFrame]) -> dict[str, int]:
    """Occurrences of every code point over all rows of one-column frames.

    One small row per task and code point reaches the shuffle; what the driver gets
    is bounded by the number of code points there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                joined = "".join(x for x in batch.column(0).slice(start, 2000).to_pylist() if x)
                points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                if len(points):
                    got = np.bincount(points)
                    total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["point", "n"])

    found: Counter[str] = Counter()
    for frame in texts:
        for row in frame.mapInArrow(count, "point int, n bigint").groupBy("point").agg(F.sum("n").alias("n")).collect():
            found[chr(row["point"])] += row["n"]
    return dict(found)


def look_keys(frames: list[DataFrame], rewrites: dict[str, str]) -> DataFrame:
    """(field, key, look, exact): hashes of the look and of the very text of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(rewrites)
        for batch in batches:
            texts = batch.column(2)
            looks = pa.array([x if x is None or x.isascii() and not rewriter.ascii else rewriter(x) for x in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), looks, texts], names=["field", "key", "look", "text"])

    both = frames[0]
    for frame in frames[1:]:
        both = both.unionByName(frame)
    # A blank text shows nothing that could look like anything.
    return (
        both.where("key is not null and text is not null")
        .mapInArrow(hashed, "field string, key bigint, look string, text string")
        .where(F.trim("look") != "")
        .select("field", "key", F.xxhash64("look").alias("look"), F.xxhash64("text").alias("exact"))
    )


def same_looking(frames: list[DataFrame]) -> DataFrame:
    """(field, first_id, other_id) for rows whose text looks like an earlier row's but differs in code points.

    ``frames`` have (field, key, text). Within a field, first_id is the least key of
    the look. Null and blank texts match nothing; rows repeated with their key come
    once; a class is reduced to one row per distinct text before any shuffle, so a
    look shared by a third of all rows stays small. Looks are compared by 64-bit hash.
    """
    rewrites = build_rewrites(char_counts([f.select("text") for f in frames]))
    keyed = look_keys(frames, rewrites)
    texts = keyed.groupBy("field", "look", "exact").agg(F.min("key").alias("key"))
    firsts = (
        texts.groupBy("field", "look")
        .agg(F.min("key").alias("first_id"), F.min_by("exact", "key").alias("first_exact"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return (
        keyed.join(firsts, ["field", "look"])
        .where("exact <> first_exact")
        .select("field", "first_id", F.col("key").alias("other_id"))
        .distinct()
    )
