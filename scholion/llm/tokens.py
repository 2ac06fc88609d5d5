"""Problem 8: encoding the corpus with a public byte-level BPE tokenizer.

Encoding is a monoid tree reduction. A text is cut into halves until a part is short,
parts are encoded, and neighbours joined: from the last piece boundary of the left part
that cannot change, a window over the seam is encoded again and grows until one of its
piece boundaries meets one of the right part. Pieces are found left to right and a
piece depends only on the text from its start, so past such a meeting point the right
part's tokens stand. Decoding is concatenation.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern by which byte-level BPE of this family cuts text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points up to which a part is encoded at once.
LEAF = 1 << 10
WINDOW = 64
# A piece depends on at most two characters behind it (the letters of a contraction); one more for the place itself.
LOOK_AHEAD = 3


class Tokenizer:
    """A public vocabulary of ranks; ``folder`` holds its file."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF) -> None:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN)
        self.leaf = max(2, leaf)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none."""
        return self._tree(text, 0, len(text)) if text else []

    def decode(self, ids: list[int]) -> str:
        return self.bpe.decode(ids)

    def _tree(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.bpe.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._tree(text, start, middle), self._tree(text, middle, end))

    def _last_boundary(self, text: str, start: int, end: int) -> int:
        """A piece boundary of the left part that the text behind it can't move.

        Between a letter and what is no letter there is always a boundary; from one
        of these the pieces are found forward, up to the last that starts far enough
        from the end for its predecessor to have seen all it depends on.
        """
        at = max(start, end - WINDOW)
        while at > start and not (text[at - 1].isalpha() and not text[at].isalpha()):
            at -= 1
        last = at
        for piece in self.pieces.finditer(text, at, end):
            if piece.start() > end - LOOK_AHEAD:
                break
            last = piece.start()
        return last

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] out of those of its two parts."""
        seam = self._last_boundary(text, start, middle)
        reach = WINDOW
        while True:
            stop = min(end, middle + reach)
            window = [p.end() for p in self.pieces.finditer(text, seam, stop)]
            alone = {p.end() for p in self.pieces.finditer(text, middle, stop)}
            # A piece near the window's end may still change, unless the part ends there; and cut
            # behind white space, a window would be encoded otherwise than within the text.
            sure = end if stop == end else stop - LOOK_AHEAD
            meet = next((x for x in window if middle < x <= sure and x in alone and not text[x - 1].isspace()), None)
            if meet is None and stop == end:
                meet = end
            if meet is not None:
                break
            reach *= 2
        tail = len(self.bpe.encode_ordinary(text[seam:middle]))
        head = len(self.bpe.encode_ordinary(text[middle:meet]))
        return left[: len(left) - tail] + self.bpe.encode_ordinary(text[seam:meet]) + right[head:]


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) for every row; null and empty texts both give an empty list.

    Repeated rows stay repeated, whole texts are read, and other columns are not
    carried along. ``folder`` must be readable by every executor.
    """
    kind = documents.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(name, folder, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = pa.array([tokenizer.encode(x) for x in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
