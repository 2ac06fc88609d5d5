"""Problem 10: sentence boundaries across languages and scripts.

Unicode's sentence-break properties name the terminators (STerm, ATerm) and the closing
marks of all scripts; abbreviations, initials, ordinals and decimals suppress a full
stop; quotations and brackets are closed before a sentence ends. Layout comes first:
blank lines part blocks, list items are units, single line breaks are white space.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Abbreviations that never end a sentence before a further word (titles, citations, connectives).
NEVER = {
    "dr", "mr", "mrs", "ms", "prof", "st", "jr", "sr", "univ", "dept", "e.g", "i.e", "eg", "ie", "cf", "vs", "approx", "incl", "pers", "viz", "resp", "eds", "ed", "gen", "gov", "rev", "hon", "ca",
    "bzgl", "bzw", "vgl", "abb", "tab", "nr", "z", "d", "u", "s", "evtl", "ggf", "inkl", "sog", "usf", "zzgl", "hrsg", "abs", "mme", "mlle", "env", "chap", "p.ex", "ex", "éd",
    "sra", "srta", "dra", "ej", "pág", "págs", "aprox", "núm", "ud", "uds", "д", "т", "проф", "напр", "см", "рис", "акад", "им", "ул", "стр", "гл", "табл", "доц", "डॉ", "श्री", "प्रो", "कु", "د", "أ", "م", "ص",
}
# Abbreviations that point to a number and else are words.
BEFORE_NUMBER = {"no", "fig", "figs", "eq", "eqs", "sec", "secs", "app", "vol", "art", "ch", "pp", "p", "ver", "v", "n", "op", "ref", "refs", "def", "thm", "lem", "prop", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"}
# Abbreviations after which a sentence ends if the next word is capitalised.
EITHER = {"etc", "inc", "ltd", "corp", "co", "al", "comm", "a.m", "p.m", "u.s", "u.k", "u.s.a", "e.u", "ph.d", "usw", "др", "пр", "г", "гг", "в", "вв", "т.е", "т.д", "т.п"}
# Months that follow an ordinal day.
MONTHS = {"januar", "jänner", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember", "jan", "feb", "apr", "jun", "jul", "aug", "sep", "sept", "okt", "nov", "dez"}
# Particles that carry a Japanese quotation on, and verbs that attribute a Chinese one.
CARRY_ON = ("と", "って", "との", "の", "など", "は", "を", "に", "が", "、", "，", "；", "：")
SAYING = regex.compile(r"[^。！？!?\n“「]*(道|说|說|写|寫|问|問|答|表示|认为|認為|指出|称|稱)[。！？!?]")
# Opening and closing quotation marks and brackets.
PAIRED = r"“[^“”„\n]*+”|„[^„“”\n]*+[“”]|«[^«»]*+»|‹[^‹›]*+›|「[^「」]*+」|『[^『』]*+』|《[^《》]*+》|\([^()]*+\)|（[^（）]*+）|\[[^\[\]\n]*+\]|(?<![\w\"])\"[^\"\n]++\"(?!\w)"

BLOCK = regex.compile(r"(?:[^\S\n]*\n){2,}| +|[\f\v]+")
LINE = regex.compile(r"[^\n \x85]+")
MARKER = regex.compile(r"\s*(?:[-*+•–‣▪●◦·]|(\d{1,3})[.)]|\(\d{1,3}\)|[a-zA-Z]\)|\#{1,6})[ \t 　]+(?=\S)")
PAIRS = regex.compile(PAIRED)
# STerm and ATerm of all scripts; runs count as one.
TERM = regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…‥]+")
HARD = regex.compile(r"[\p{Sentence_Break=STerm}]")
CLOSE = regex.compile(r"[\p{Pe}\p{Pf}\"'”’»›」』）\])]*(?:[   ][»›])?")
WORD_BEFORE = regex.compile(r"(?r)(?:[\p{L}\p{M}]++\.)*[\p{L}\p{M}]++")
NEXT = regex.compile(r"[\s]*")
NEXT_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
UNUSUAL = regex.compile(r"\p{Ll}(?:-\p{L}|\p{Lu})")
NUMBERED = regex.compile(r"[(\[]?\p{N}")
THAI_SPACE = regex.compile(r"(?<=[\p{Thai}\p{N}%\p{Pe}\p{Pf}ๆฯ.])\s+(?=[\p{L}\p{Ps}\p{Pi}])")
LAST_LETTER = regex.compile(r"(?r)\p{L}")


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in LINE.finditer(text, start, end) if m.group().strip()]


def _ends(text: str, start: int, end: int) -> bool:
    tail = text[start:end].rstrip()
    tail = tail.rstrip("\"'”“’»›」』）)]").rstrip()
    return bool(tail) and bool(TERM.fullmatch(tail[-1]))


def _segments(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, body): list items and running prose of a block; body is behind an item's marker."""
    lines = _lines(text, start, end)
    at, body, item, before = None, None, False, None
    for a, b in lines:
        marker = MARKER.match(text, a, b)
        if marker and marker.group(1):
            follows = NEXT_WORD.match(text, marker.end(), b)
            if follows and follows.group().lower() in MONTHS and before is not None and not item:
                marker = None
            elif before is not None and not item and not _ends(text, *before) and before[1] - before[0] > 45:
                marker = None
        elif marker and before is not None and not item and not _ends(text, *before) and marker.group().strip() in "–·+*" and before[1] - before[0] > 45:
            marker = None
        fresh = marker is not None or (item and not text[a:b].lstrip()[:1].islower())
        if at is not None and fresh:
            yield at, before[1], body
            at = None
        if at is None:
            at, body, item = a, marker.end() if marker else a, marker is not None
        before = (a, b)
    if at is not None:
        yield at, before[1], body


def _stop_ends(text: str, start: int, dot: int, end: int, after: int, follow: int) -> bool:
    """Whether a full stop at ``dot`` ends a sentence, by the word before and what follows at ``follow``."""
    spaced = follow > after
    char = text[follow]
    before = WORD_BEFORE.match(text, start, dot)
    word = before.group() if before else ""
    low = word.lower()
    nxt = NEXT_WORD.match(text, follow, end)
    upper = char.isupper() or char in "¿¡" or (not char.isalnum() and char not in ",;:)]}»”%-–—/&=+<>*|")
    strange = bool(UNUSUAL.match(text, follow))
    lower = char.islower() and not strange
    if not spaced:
        # Touching sentences: a real word before, and a capital word, an opening mark or a counted noun after.
        if dot == start or not (text[dot - 1].isalnum() or text[dot - 1] in "%)”»"):
            return False
        if char in "“„«「『(¿¡":
            return len(word) > 1 or text[dot - 1].isdigit() or text[dot - 1] in "%)"
        if char.isdigit():
            return len(word) > 3 and word.islower() and low not in BEFORE_NUMBER and nxt is not None and text[nxt.end() : nxt.end() + 1] == " "
        if not char.isalpha() or "." in word or low in NEVER:
            return False
        if char.isupper():
            return (len(word) > 1 or text[dot - 1].isdigit() or text[dot - 1] in "%)") and nxt is not None and (len(nxt.group()) > 1 or text[nxt.end() : nxt.end() + 1] in " \n") and not (word.isupper() and len(word) > 1 and nxt.group().isupper())
        if char.islower():
            return strange and len(word) > 2
        return len(word) > 1 and not word.isascii() and not char.isascii()
    if word and dot > start:
        plain = low.rsplit(".", 1)[-1]
        if len(word) == 1:
            # Initials and single-letter abbreviations go on; other letters are words ("of x. The").
            if word.isupper() or low in NEVER:
                return word.islower() and low in EITHER and upper
            if word.islower():
                return upper or strange
        if low in EITHER or (plain in EITHER and "." in low):
            return upper or strange or (char.isdigit() and low in ("etc", "usw"))
        if low in NEVER or (plain in NEVER and "." in low):
            return False
        if low in BEFORE_NUMBER:
            return not NUMBERED.match(text, follow) and (upper or strange)
        if "." in word and all(len(x) == 1 for x in word.split(".")):
            return upper or strange
    elif dot > start and text[dot - 1].isdigit() and nxt is not None and nxt.group().lower() in MONTHS:
        digits = regex.search(r"(?<![\d.,])\d{1,2}$", text[max(start, dot - 4) : dot])
        if digits and int(digits.group()) <= 31:
            return False
    elif dot > start and text[dot - 1].isspace():
        # A stop that stands alone belongs to what follows (".csv") unless it closes a line of its own.
        return upper and text[dot - 1] == "\n"
    return not lower


def _split(text: str, start: int, end: int, body: int) -> Iterator[tuple[int, int]]:
    """Raw sentence spans of a segment."""
    pairs = [m.span() for m in PAIRS.finditer(text, start, end)]
    opens = [p[0] for p in pairs]
    at = start
    for run in TERM.finditer(text, body, end):
        a, b = run.span()
        if a < at:
            continue
        k = bisect.bisect_right(opens, a) - 1
        inside = k >= 0 and pairs[k][1] > a
        # An inner pair's neighbours may lie in an outer one; the outermost that covers the place counts.
        close = pairs[k][1] if inside else b
        after = CLOSE.match(text, b, end).end() if not inside else close
        if inside:
            if text[b : close - 1].strip():
                continue
            after = CLOSE.match(text, close, end).end()
        if TERM.match(text, after, end):
            continue
        follow = NEXT.match(text, after, end).end()
        if follow >= end:
            continue
        hard = bool(HARD.search(run.group()))
        char = text[follow]
        if inside or after > b:
            # Quoted speech or a bracket has closed; the sentence may go on.
            if char in ",;:，、；：،؛—–-" or char.islower() and not UNUSUAL.match(text, follow):
                continue
            if text.startswith(CARRY_ON, follow) and text[close - 1] in "」』":
                continue
            opened = pairs[k][0] if inside else None
            if opened is not None and text[at:opened].strip() == "" and SAYING.match(text, follow, end):
                continue
            if not hard and run.group()[-1] == "." and not inside and not _stop_ends(text, at, a, end, after, follow):
                continue
            if inside and not hard and len(run.group()) == 1 and run.group() == "." and text[close - 1] in ")]" and not (char.isupper() or char in "“„«「(¿¡" or UNUSUAL.match(text, follow) or char.isdigit() or not char.isascii()):
                continue
        elif hard:
            if follow == after and run.group() in "!?" and not (char.isupper() or char in "“„«「『(¿¡" or not char.isascii() or char.isdigit() or UNUSUAL.match(text, follow)):
                continue
            if char in ",;:，、；：،؛":
                continue
        elif len(run.group()) > 1 or run.group() in "…‥":
            # Dots that trail off end a sentence only before a new start.
            if not (char.isupper() or UNUSUAL.match(text, follow) or (char in "“„«「『(¿¡" and follow > after) or (char.isalpha() and not char.islower() and not char.isupper())):
                continue
        elif not _stop_ends(text, at, a, end, after, follow):
            continue
        yield at, after
        at = follow
    if at < end:
        yield at, end


def _thai(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    at = start
    for gap in THAI_SPACE.finditer(text, start, end):
        last = LAST_LETTER.search(text, at, gap.start())
        if last and "฀" <= last.group() <= "๿":
            yield at, gap.start()
            at = gap.end()
    yield at, end


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Every sentence of a text as (start, end) in code points, without outer white space.

    Null, empty and blank texts have none.
    """
    if not text or text.isspace():
        return []
    spans, at = [], 0
    blocks = []
    plain = text.replace("\r", "\n") if "\r" in text and "\n" not in text else text.replace("\r", " ")
    for gap in BLOCK.finditer(plain):
        blocks.append((at, gap.start()))
        at = gap.end()
    blocks.append((at, len(plain)))
    thai = regex.search(r"\p{Thai}", plain) is not None
    for a, b in blocks:
        for start, end, body in _segments(plain, a, b):
            for x, y in _split(plain, start, end, body):
                for s, e in _thai(plain, x, y) if thai else ((x, y),):
                    while s < e and plain[s].isspace():
                        s += 1
                    while e > s and plain[e - 1].isspace():
                        e -= 1
                    if s < e:
                        spans.append((s, e))
    return spans


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence of every document.

    Language labels are not trusted: scripts and marks in the text decide. Repeated
    rows give their sentences each time; other columns are not carried along.
    """
    kind = documents.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, starts, ends = [], [], []
                for row, value in enumerate(part.column(1).to_pylist()):
                    for start, end in sentence_spans(value):
                        rows.append(row)
                        starts.append(start)
                        ends.append(end)
                keys = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "start_pos", "end_pos"])

    return documents.select(key, text).mapInArrow(cut, f"`{key}` {kind}, start_pos int, end_pos int")
