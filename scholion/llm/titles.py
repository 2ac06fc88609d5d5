"""Titles as words that can be compared: case, markup, width, accents and look-alikes put aside."""

from __future__ import annotations

import html
import re
import unicodedata

from scholion.llm.lookalike import SAME_GLYPH, invisible

MARKUP = re.compile(r"<[^<>]*>|\\[a-zA-Z]+\s*(?=\{)|[{}$]")
#: Letters from which a word is a text without spaces.
LONG = 64
#: Words that slips may damage in a long title.
MOST_DAMAGED = 3
SERIES = re.compile(r"^(?:[ivx]+|.*\d.*)$")


class _Fold(dict):
    """Code point -> its folded text, worked out once for each."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        text = "".join(SAME_GLYPH.get(c, c) for c in unicodedata.normalize("NFKC", char))
        text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
        if char == "&" or text == "&":
            text = " and "
        elif invisible(char) or unicodedata.combining(char) or text in "-‐‑'’ʼ`":
            text = ""
        else:
            text = "".join(c if c.isalnum() else " " for c in text) or " "
        self[point] = text
        return text


FOLD = _Fold()


def fold_words(title: str | None) -> list[str]:
    """The folded words of a title; none for null, empty or mark-only titles."""
    if not title:
        return []
    if "&" in title or "＆" in title:
        title = html.unescape(title.replace("＆", "&"))
    if "<" in title or "\\" in title or "{" in title or "$" in title:
        title = MARKUP.sub("", title)
    return title.translate(FOLD).split()


def series_mark(words: list[str]) -> str:
    """Numerals of a title, which tell the parts and years of a series apart."""
    return " ".join(w for w in words if SERIES.match(w))


def slips(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two words, or most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        rows.append(row)
    return min(rows[-1][-1], most + 1)


def slips_allowed(word: str, last: bool) -> int:
    """Edits that a word may have: one if it is short, the last (where a series names its language) or no word but a text without spaces, else two."""
    return 1 if last or not 5 <= len(word) <= LONG else 2


def damaged_words(n: int) -> int:
    """Words of a title of n that slips may have damaged: three, of short titles fewer."""
    return MOST_DAMAGED if n > 5 else 2 if n > 3 else 1


def shortened_forms(word: str, most: int) -> set[str]:
    """A word and its forms with up to ``most`` letters left out; two words within as many edits share one.

    A single left-out letter of a very long word is told by what is before and behind it,
    so that the forms stay as long together as the word is, not its square.
    """
    forms, last = {word}, {word}
    if len(word) <= LONG:
        for _ in range(most):
            last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
            forms = forms | last
        if len(word) < LONG:
            return forms
    base, modulus = 1_000_003, (1 << 61) - 1
    before, behind, power = [0], [0], [1]
    for c in word:
        before.append((before[-1] * base + ord(c)) % modulus)
        power.append(power[-1] * base % modulus)
    for k, c in enumerate(reversed(word)):
        behind.append((ord(c) * power[k] + behind[-1]) % modulus)
    # A word of just LONG letters meets those of its own kind and those one longer.
    whole = {f"~{len(word)}~{before[-1]}"}
    if len(word) == LONG:
        return forms | whole
    n = len(word)
    return whole | {f"~{n - 1}~{(before[i] * power[n - i - 1] + behind[n - i - 1]) % modulus}" for i in range(n)}


def same_but_slips(a: list[str], b: list[str]) -> bool:
    """Whether two titles differ by slips of typing only.

    Word by word, at most three words differ (``damaged_words``), each by two edits or
    fewer (``slips_allowed``), and numerals agree.
    """
    if len(a) != len(b) or series_mark(a) != series_mark(b):
        return False
    damaged, allowed = 0, damaged_words(len(a))
    for at, (x, y) in enumerate(zip(a, b)):
        if x != y:
            damaged += 1
            most = min(slips_allowed(w, at == len(a) - 1) for w in (x, y))
            if damaged > allowed or slips(x, y, most) > most:
                return False
    return True
