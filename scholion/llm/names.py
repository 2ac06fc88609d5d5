"""Problem 4: variant spellings of personal names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from scholion.llm.lookalike import SAME_GLYPH, invisible
from scholion.llm.titles import FOLD

# Titles before and additions behind a name.
TITLES = {"prof", "dr", "mr", "mrs", "ms", "sir", "dame", "professor", "doctor", "phd", "ph.d"}
ADDITIONS = {"jr", "sr", "ii", "iii", "iv", "phd", "md", "esq"}
# Particles that belong to the surname.
PARTICLES = {"van", "von", "de", "la", "der", "den", "del", "di", "da", "el", "bin", "du", "le", "dos", "das", "ter", "ten", "zu", "af", "av"}
# Short and pet forms with the names they stand for.
NICKNAMES = {
    "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert", "bill": "william", "will": "william", "billy": "william", "liam": "william", "willy": "william",
    "dick": "richard", "rick": "richard", "rich": "richard", "ricky": "richard", "mike": "michael", "mick": "michael", "mikey": "michael", "misha": "mikhail", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kitty": "katherine",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "greta",
    "tom": "thomas", "tommy": "thomas", "tony": "anthony", "toni": "anthony", "ant": "anthony", "jim": "james", "jimmy": "james", "jamie": "james", "jack": "john", "johnny": "john", "jon": "john", "joe": "joseph", "joey": "joseph",
    "chris": "christopher", "kit": "christopher", "topher": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "davy": "david", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "al": "albert",
    "nick": "nicholas", "nicky": "nicholas", "nico": "nicholas", "sue": "susan", "susie": "susan", "suzy": "susan", "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vic": "victoria",
    "steve": "stephen", "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward", "andy": "andrew", "drew": "andrew", "matt": "matthew", "matty": "matthew", "greg": "gregory", "sam": "samuel", "sammy": "samuel", "charlie": "charles", "chuck": "charles", "chas": "charles", "fred": "frederick", "harry": "henry", "hank": "henry", "larry": "lawrence", "ray": "raymond", "ron": "ronald", "don": "donald",
    "becky": "rebecca", "becca": "rebecca", "debbie": "deborah", "deb": "deborah", "barb": "barbara", "cathy": "catherine", "cindy": "cynthia", "judy": "judith", "mandy": "amanda", "molly": "mary", "polly": "mary", "mamie": "mary", "nan": "ann", "annie": "ann", "nancy": "ann", "sally": "sarah", "sadie": "sarah", "terry": "theresa", "tina": "christina",
    "dima": "dmitri", "mitya": "dmitri", "katya": "ekaterina", "kolya": "nikolai", "tanya": "tatiana", "olya": "olga", "vanya": "ivan", "zhenya": "evgeny", "seb": "sebastian", "max": "maximilian", "hans": "johannes", "jo": "johannes", "hannes": "johannes", "pepe": "jose", "paco": "francisco", "pancho": "francisco", "lola": "dolores", "bea": "beatriz", "gigi": "luigi", "beppe": "giuseppe", "peppe": "giuseppe", "uli": "ulrich", "ulla": "ursula", "uschi": "ursula",
}
# Short forms that stand for several names; which one is told by who is there.
SHARED_NICKNAMES = {
    "alex": ("alexander", "alexandra"), "sasha": ("alexander", "alexandra"), "sandy": ("alexander", "sandra"), "chris": ("christopher", "christine", "christina"), "kit": ("christopher", "katherine"),
    "sam": ("samuel", "samantha"), "pat": ("patricia", "patrick"), "terry": ("theresa", "terence"), "bert": ("robert", "albert"), "al": ("albert", "alan"), "ed": ("edward", "edwin"), "ted": ("edward", "theodore"),
    "nicky": ("nicholas", "nicole"), "nico": ("nicholas", "nicole"), "jo": ("johannes", "joanna", "josephine"), "max": ("maximilian", "maxine"), "ray": ("raymond", "rachel"), "andy": ("andrew", "andreas"), "toni": ("anthony", "antonia"), "vic": ("victoria", "victor"),
}
# Legal forms that end an organisation's name.
LEGAL_FORMS = {"inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "gmbh", "plc", "company"}


@lru_cache(maxsize=200_000)
def fold(token: str) -> str:
    """Lower case without accents, marks and look-alikes; hyphens and points go."""
    return token.translate(FOLD).replace(" ", "")


def look(name: str) -> str:
    """Width, look-alikes and invisible characters put aside; case and accents kept."""
    wide = unicodedata.normalize("NFKC", "".join(c for c in name if not invisible(c)))
    return " ".join(unicodedata.normalize("NFC", "".join(SAME_GLYPH.get(c, c) for c in wide)).split())


class Parsed:
    """given and surname tokens, folded; ``sure`` tells whether their order is."""

    __slots__ = ("given", "surname", "sure")

    def __init__(self, given: list[str], surname: list[str], sure: bool) -> None:
        self.given, self.surname, self.sure = given, surname, sure

    def __repr__(self) -> str:
        return f"{self.given}|{self.surname}|{self.sure}"


def _initials(token: str) -> bool:
    bare = token.replace(".", "").replace("-", "")
    return 1 <= len(bare) <= 2 and (token.endswith(".") or bare.isupper())


def _givens(tokens: list[str]) -> list[str]:
    out: list[str] = []
    for token in tokens:
        if _initials(token):
            out += [c for c in fold(token)]
        else:
            out.append(fold(token))
    return [t for t in out if t]


def parse(name: str | None) -> Parsed | None:
    """Token-order, title, addition and initial rules; None if no surname can be told."""
    if not name:
        return None
    text = re.sub(r"\s*\b\d{1,4}$", "", look(name).strip())
    left, comma, right = text.partition(",")
    clean = lambda part: [t for t in part.split() if fold(t) and fold(t) not in TITLES]
    sides = [clean(left), clean(right)]
    sides = [[t for t in s if t.rstrip(".").casefold() not in ADDITIONS or _initials(t)] for s in sides]
    sides = [[t for t in s if t.rstrip(".").casefold() not in {"jr", "sr"}] for s in sides]
    if comma and sides[0] and sides[1]:
        return Parsed(_givens(sides[1]), [fold(t) for t in sides[0]], True)
    tokens = sides[0] or sides[1]
    if not tokens:
        return None
    if len(tokens) == 1:
        return Parsed([], [fold(tokens[0])], False)
    shout = [t.isupper() and len(fold(t)) > 2 for t in tokens]
    if any(shout) and not all(shout):
        first, last = shout.index(True), len(shout) - 1 - shout[::-1].index(True)
        while first and tokens[first - 1].casefold() in PARTICLES:
            first -= 1
        rest = tokens[:first] + tokens[last + 1 :]
        # Capitals that are only particles do not name anyone.
        return Parsed(_givens(rest), [fold(t) for t in tokens[first : last + 1]], True)
    if _initials(tokens[-1]) and not _initials(tokens[0]):
        cut = len(tokens)
        while cut > 1 and _initials(tokens[cut - 1]):
            cut -= 1
        return Parsed(_givens(tokens[cut:]), [fold(t) for t in tokens[:cut]], True)
    start = len(tokens) - 1
    while start > 1 and tokens[start - 1].casefold() in PARTICLES:
        start -= 1
    sure = _initials(tokens[0]) or len(tokens) - (len(tokens) - start) > 1 and any(_initials(t) for t in tokens[1:start]) or start < len(tokens) - 1
    if tokens[0].casefold() in PARTICLES and not sure:
        # "van Rosufurand Matthew": particles lead a surname that comes first.
        end = 0
        while end < len(tokens) - 2 and tokens[end].casefold() in PARTICLES:
            end += 1
        return Parsed(_givens(tokens[end + 1 :]), [fold(t) for t in tokens[: end + 1]], True)
    return Parsed(_givens(tokens[:start]), [fold(t) for t in tokens[start:]], sure)


# Letters that Unicode does not decompose, and digraphs written for umlauts.
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "ı": "i", "œ": "oe", "ð": "d", "þ": "th"})
DIGRAPHS = (("oe", "o"), ("ue", "u"), ("ae", "a"))
# Words of an affiliation that do not tell it from others (legal forms and kinds of institution).
GENERIC = {
    "university", "univ", "universitat", "universite", "universidad", "universita", "institute", "inst", "of", "the", "for", "de", "di", "der", "technology", "tech", "research", "labs", "lab", "laboratory", "laboratories",
    "dept", "department", "computer", "science", "sciences", "school", "college", "faculty", "center", "centre", "inc", "ltd", "gmbh", "corp", "corporation", "llc", "co", "and", "und", "et",
}


def plain(token: str) -> str:
    """A folded name token with letters and digraphs reduced."""
    token = token.translate(LETTERS)
    for pair, one in DIGRAPHS:
        token = token.replace(pair, one)
    return token


def canonical(token: str) -> str:
    """A given name in its full form."""
    return plain(NICKNAMES.get(token, token))


def forms(name: str | None) -> tuple[str | None, list[str], bool, list[str]]:
    """(full key, initial keys, only initials, middle initials) of a name.

    The full key is the unordered pair of canonical first name and surname, so token
    order does not matter where it is unknown; an initial key is initial and surname.
    """
    body = organisation(name)
    if body:
        return f"organisation|{body}", [], False, []
    parsed = parse(name)
    if parsed is None or not parsed.given:
        return None, [], False, []
    surname = plain("".join(parsed.surname))
    first = parsed.given[0]
    middle = [g[0] for g in parsed.given[1:]]
    if len(first) == 1:
        return None, [f"{first}|{surname}"], True, middle
    given = canonical(first)
    keys = {f"{given[0]}|{surname}", f"{first[0]}|{surname}"}
    if not parsed.sure and len(parsed.given) == 1:
        keys.add(f"{surname[0]}|{given}")
    return "|".join(sorted((given, surname))), sorted(keys), False, middle


def organisation(name: str | None) -> str | None:
    """The words of an organisation's name without the legal form that it ends in; None for other names."""
    words = [w for w in (fold(t) for t in (look(name) if name else "").replace(",", " ").split()) if w]
    end = len(words)
    while end and words[end - 1] in LEGAL_FORMS:
        end -= 1
    return plain("".join(words[:end])) if 0 < end < len(words) else None


def shared_keys(name: str | None) -> list[str]:
    """Full keys of all the names that a shared short form may stand for, the usual one first; none for other names."""
    parsed = parse(name)
    if parsed is None or not parsed.given or organisation(name):
        return []
    surname = plain("".join(parsed.surname))
    return ["|".join(sorted((plain(given), surname))) for given in SHARED_NICKNAMES.get(parsed.given[0], ())]


def shortened(name: str | None) -> list[str]:
    """Full keys of the ways a name is cut or taken apart: particles or the second half of a double
    surname left out, a double surname without its hyphen (its first half then looks like a middle name)."""
    parsed = parse(name)
    if parsed is None or not parsed.given or len(parsed.given[0]) == 1:
        return []
    given, surname = canonical(parsed.given[0]), parsed.surname
    bare = [t for t in surname if t not in PARTICLES]
    forms_ = {plain("".join(bare))} if bare else set()
    halves = [h for t in look(name).replace(",", " ").split() if "-" in t and fold(t) in surname for h in [fold(t.split("-")[0])]]
    forms_ |= {plain(h) for h in halves if len(h) > 3}
    if len(parsed.given) > 1 and len(parsed.given[-1]) > 3 and len(surname) == 1:
        forms_.add(plain(parsed.given[-1] + surname[0]))
    forms_.discard(plain("".join(surname)))
    return sorted("|".join(sorted((given, f))) for f in forms_ if f)


def dropped(word: str) -> set[str]:
    """A word and all its forms with one letter left out (the shortest words keep theirs)."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 2 else set())


def affiliation_stem(affiliation: str | None) -> str | None:
    """The word of an affiliation that names it: legal forms and kinds left out."""
    words = [w for w in (affiliation or "").translate(FOLD).split() if w not in GENERIC]
    return plain(words[-1]) if words else None
