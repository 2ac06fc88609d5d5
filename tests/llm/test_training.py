"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from scholion.llm import components, crosslink, history, identifiers, leaks, links, lookalike, names, people, sentences, survivors, titles, tokens
from scholion.runtime import read_text, write_text


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# 2 ------------------------------------------------------------------------------------------------


def groups_by_search(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 40)] + [(5, 5), (None, 3), (7, None), (101, 100)]
    got = rows(components.connected_components(spark.createDataFrame(pairs, "src int, dst int")))
    assert got == sorted(groups_by_search(pairs), key=str)


def test_long_ids_are_grouped_as_text(spark):
    data = [("W9", True, "doi", "W" + "1" * 30), ("W" + "1" * 30, True, "doi", "W12"), ("W120", True, "doi", "W12")]
    df = spark.createDataFrame(data, "checked_id string, is_duplicate boolean, match_type string, matched_id string")
    assert {r[1] for r in rows(links.consolidate(df))} == {"W" + "1" * 30}
    assert rows(links.consolidate(df.where("checked_id = 'W120'"))) == [("W12", "W12"), ("W120", "W12")]


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_links_in_all_writings(spark):
    data = [
        ("W0000000001", True, " DOI", "https://works.example.org/w0000000002"), ("W0000000002", True, "title-year", "openalex:W0000000003 "), ("W0000000004", False, "doi", "W0000000001"),
        ("W0000000005", True, "none", "W0000000001"), ("W0000000006", True, None, "W0000000001"), ("W0000000007", True, "doi", " "), ("W0000000008", True, "doi", "W0000000008"), ("W0000000009", None, "doi", "W0000000001"),
    ]
    df = spark.createDataFrame(data, "checked_id string, is_duplicate boolean, match_type string, matched_id string").withColumn("src", F.lit("clash"))
    assert rows(links.consolidate(df)) == [(f"W000000000{i}", "W0000000001") for i in (1, 2, 3)]


# 3 ------------------------------------------------------------------------------------------------


def frame(spark, data):
    return spark.createDataFrame(data, "field string, key long, text string")


def test_same_looking(spark):
    data = [
        ("t", 1, "Café on ice"), ("t", 2, "Cafe\u0301 on ice"), ("t", 3, "Ｃａｆé\u2003on\u200b ice"), ("t", 4, "Саfé on iсe"), ("t", 5, "Cafe on ice"), ("t", 6, "café on ice"), ("t", 7, "Café on ice"),
        ("t", 8, None), ("t", 9, ""), ("t", 10, " \u200b"), ("t", 3, "Ｃａｆé\u2003on\u200b ice"), ("t", 11, "x²"), ("t", 12, "x2"), ("t", 13, "eﬃcient"), ("t", 14, "efficient"), ("t", 15, "a-b"), ("t", 16, "a\u2011b"),
    ]
    got = rows(lookalike.same_looking([frame(spark, data)]).select("first_id", "other_id"))
    assert got == sorted([(1, 2), (1, 3), (1, 4), (13, 14), (15, 16)], key=str)
    other = frame(spark, [("n", 20, "Café on ice")])
    assert lookalike.same_looking([frame(spark, data[:1]), other]).count() == 0
    assert lookalike.same_looking([frame(spark, [])]).count() == 0


def test_rewriting_is_stable_and_representatives_are_frequent():
    counts = {"о": 5, "o": 50, "ο": 1, "e": 9, "é": 4, "\u0301": 2}
    rewriter = lookalike.Rewriter(lookalike.build_rewrites(counts))
    assert rewriter("оοo") == "ooo" and rewriter("e\u0301") == rewriter("é")
    turned = lookalike.Rewriter(lookalike.build_rewrites({"о": 50, "o": 5}))
    assert turned("o") == "о"
    for text in ("", "plain", "оe\u0301\u200b\u3000ο", "\u0301\u0301"):
        assert rewriter(rewriter(text)) == rewriter(text)


ALIKE = [
    ("\ud55c\uae00", "\u1112\u1161\u11ab\u1100\u1173\u11af"), ("\u0995\u09cb", "\u0995\u09c7\u09be"), ("\u0b95\u0bca", "\u0b95\u0bc6\u0bbe"), ("a\u0323\u0302", "a\u0302\u0323"), ("c\u0327\u0301", "\u1e09"), ("q\u0323\u0307", "q\u0307\u0323"),
    ("\ufee3\ufea4\ufee4\ufeaa", "\u0645\u062d\u0645\u062f"), ("\u13aaB", "AB"), ("\u2c80B", "AB"), ("\ua4d0O", "BO"), ("\ufb03", "ffi"), ("\u0421\u0430f\u0435\u0301", "Caf\u00e9"),
]


@pytest.mark.parametrize("a,b", ALIKE)
def test_canonical_and_confusable_writings_look_the_same(a, b):
    counts = {}
    for char in a + b + "abcdefghijklmnop" * 3:
        counts[char] = counts.get(char, 0) + 1
    rewriter = lookalike.Rewriter(lookalike.build_rewrites(counts))
    assert rewriter(a) == rewriter(b)


# 1 ------------------------------------------------------------------------------------------------

PAPER = "raw_id long, batch_no int, title string, year int, doi string, extra string"
T = "Introducing Zarumo, causal beam search with robust decoders for speech recognition over court records"


def test_history_cases(spark):
    data = [
        (1, 0, T, 2010, "10.90001/abc.2010.1", "x"), (2, 0, "Editorial", 2010, "10.90001/abc.2010.2", "x"), (3, 0, T + ", Part I", 2010, "10.90001/abc.2010.3", "x"), (4, 0, "Other " + T, None, "10.90011/abc.2010", "x"),
        (10, 1, "whatever", None, "https://doi.example.org/10.90001%2FABC.2010.1.", "x"),  # own DOI in another writing
        (11, 1, T.replace("beam", "baem"), 2011, None, "x"),  # a slip, a year apart
        (12, 1, T.upper(), None, "10.99480/preprint.1.2", "x"),  # a preprint's DOI and no year
        (13, 1, T, 2012, None, "x"),  # two years apart, but row 12 and row 11 link it
        (14, 2, T + ", Part II", 2010, None, "x"),  # another part
        (15, 2, T + " for Welsh", 2010, None, "x"),  # another language
        (16, 2, "Correction to: " + T, 2010, None, "x"),
        (17, 2, "Editorial", 2010, "10.90001/abc.2010.9", "x"),  # equal title, other DOI
        (18, 2, "Quite a different text about nothing at all", 2001, "10.90011/abc.2010", "x"),  # a volume's DOI
        (19, 2, None, None, "n/a", "x"), (20, 2, "", 2010, None, "x"), (21, 2, None, 2010, "10.90001/abc.2010.3", "x"), (22, 3, None, 2010, "10.90001/abc.2010.3", "x"),
    ]
    df = spark.createDataFrame(data, PAPER)
    want = sorted([(1, i) for i in (10, 11, 12, 13)] + [(3, 21), (3, 22)], key=str)
    assert rows(history.duplicates_against_history(df)) == want
    # Delivered at once, or in two sessions of the index with its files compacted between, the links are the same.
    index = history.AcceptedIndex(spark)
    index.ingest(df.where("batch_no = 0"), link=False)
    at_once = index.ingest(df.where("batch_no > 0"))
    index.close()
    first = history.AcceptedIndex(spark)
    first.ingest(df.where("batch_no = 0"), link=False)
    found = first.ingest(df.where("batch_no = 1"))
    first.compact()
    first.close()
    again = history.AcceptedIndex.open(spark, first.folder)
    for b in (2, 3):
        found = found.unionByName(again.ingest(df.where(f"batch_no = {b}")))
    for links_ in (at_once, found):
        linked = components.connected_components(links_).where("node <> component and node >= 10")
        assert rows(linked.select("component", "node")) == want
    assert history.duplicates_against_history(df.limit(0)).count() == 0
    assert history.duplicates_against_history(df.where("batch_no = 0")).count() == 0


def test_a_delivery_is_never_paired_history_with_history(spark):
    data = [(i, 0, f"Sparse parsing of letter records with model{chr(97 + i)} under noise", 2010, f"10.90001/abc.2010.{i}", "x") for i in range(20)]
    data += [(100, 1, "Sparse parsing of letter recrods with modela under noise", 2010, None, "x")]
    df = spark.createDataFrame(data, PAPER)
    index = history.AcceptedIndex(spark)
    index.ingest(df.where("batch_no = 0"), link=False)
    index.ingest(df.where("batch_no = 1"))
    # One title is new: it alone is posted by the second delivery, and all similar pairs have it on one side.
    assert index.read("postings").where("delivery = 2").select("text_id").distinct().count() == 1
    own = index.read("titles").where("delivery = 2").first().title_id
    assert {own} == {x for r in index.read("similar").collect() for x in (r.title_id, r.other) if x in (own,)} and index.read("similar").where(f"title_id <> {own} and other <> {own}").count() == 0


def test_later_deliveries_run_the_code_of_earlier_ones(spark):
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()
    titles_ = lambda b: [(100 * b + i, b, f"Sparse parsing of letter records with model{chr(97 + i)} under noise", 2010, None if b else f"10.90001/abc.2010.{i}", "x") for i in range(10)]
    index, took = history.AcceptedIndex(spark), []
    for b in range(6):
        before = compiled.getCount()
        index.ingest(spark.createDataFrame(titles_(b), PAPER), link=b > 0)
        took.append(compiled.getCount() - before)
    index.close()
    assert took[-1] < 70, took


def test_an_index_with_numbered_deliveries_is_still_opened(spark):
    data = [(1, 0, T, 2010, "10.90001/abc.2010.1", "x"), (10, 1, T.replace("beam", "baem"), 2011, None, "x"), (11, 2, T.upper(), 2010, None, "x")]
    df = spark.createDataFrame(data, PAPER)
    index = history.AcceptedIndex(spark)
    index.kind = "INT"
    index.ingest(df.where("batch_no = 0"), link=False)
    found = index.ingest(df.where("batch_no = 1"))
    index.close()
    note = json.loads(read_text(spark, f"{index.folder}/note.json"))
    del note["kind"]
    write_text(spark, f"{index.folder}/note.json", json.dumps(note))
    again = history.AcceptedIndex.open(spark, index.folder)
    found = found.unionByName(again.ingest(df.where("batch_no = 2")))
    again.compact()
    assert dict(again.read("titles").dtypes)["delivery"] == "int" and again.read("titles").where("delivery = 3").count() == 1
    assert rows(components.connected_components(found).where("node <> component").select("component", "node")) == [(1, 10), (1, 11)]


def damaged(rng, word, edits):
    letters = list(word)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        letters[at : at + 1] = rng.choice([[], [letters[at], rng.choice("abxyz")], [rng.choice("abxyz")]]) or (["q"] if len(letters) == 1 else [])
    return "".join(letters)


def test_tokens_meet_whatever_the_verifier_accepts():
    rng, met = random.Random(5), 0
    rank = lambda w: (len(w), w)
    for _ in range(3000):
        n = rng.choice([1, 1, 2, 2, 3, 4, 5, 6, 7, 9, 14])
        a = ["".join(rng.choices("abcdefghij学习", k=rng.choice([3, 5, 7, 9] if n > 1 else [3, 8, 30, 63, 64, 65, 66, 80]))) for _ in range(n)]
        b = list(a)
        for i in rng.sample(range(n), min(n, rng.randint(1, 3))):
            b[i] = damaged(rng, b[i], rng.randint(1, 2))
        if titles.same_but_slips(a, b):
            met += 1
            assert set(history.prefix_tokens(a, rank)) & set(history.prefix_tokens(b, rank)), (a, b)
            x, y = history.signature(a), history.signature(b)
            assert sum((x ^ y) >> 4 * k & 15 > 0 for k in range(16)) <= titles.MOST_DAMAGED
    assert met > 1000
    assert len(titles.shortened_forms("ab" * 5000, 1)) == 10001


def test_slips():
    assert titles.slips("baselines", "baselones", 2) == 1 and titles.slips("ab", "ba", 2) == 1 and titles.slips("abc", "xyz", 2) == 3
    words = titles.fold_words
    assert words("The <i>Fi</i>ne \\emph{R\u00e9sum\u00e9} &amp; ﬁx: self-made") == ["the", "fine", "resume", "and", "fix", "selfmade"]
    assert words(None) == words("") == words("—!") == []
    assert titles.same_but_slips(words(T), words(T.replace("causal", "cuasal")))
    assert not titles.same_but_slips(words(T + " for Greek"), words(T + " for Dutch"))


def test_identifiers(spark):
    data = ["DOI: 10.90001/A.B ", "10.90001%2Fa.b.", "https://x.org/10.90001/a.b", "10.", "10.90001/", "n/a", "10.0000/0000", "10.90011/abc.2003", None]
    got = spark.createDataFrame([(d,) for d in data], "d string").select(identifiers.own_doi(F.col("d")))
    assert [r[0] for r in got.collect()] == ["10.90001/a.b"] * 3 + [None] * 6


# 4 ------------------------------------------------------------------------------------------------


def test_name_forms():
    full = lambda n: names.forms(n)[0]
    assert full("Prof. Katherine van Rosufurand") == full("van ROSUFURAND Jr., Kathy") == full("Rosufurand 0002, Kate".replace("Rosufurand 0002", "van Rosufurand"))
    assert full("Beatriz Depajalind") == full("Depajalind Beatriz") == full("DEPAJALIND, Beatríz")
    assert full("Søren Kövari") == full("Soeren Koevari")
    assert names.forms("D. Gafotiseck")[1:3] == (["d|gafotiseck"], True) and names.forms("Gafotiseck DM")[2]
    assert full("Pilar Nutihogex") in names.shortened("Nutihogex-Nugitenix, Pilar") and full("Robert Ziloju-Zizove") in names.shortened("Robert Ziloju Zizove")
    assert full("Jarek Gekiso") in names.shortened("Jarek van Gekiso") and full("Ben Foninigind") == full("Foninigind, Benjamin") and names.shortened(None) == []
    assert names.forms(None) == names.forms("") == (None, [], False, [])
    assert full("IBM Corporation") == full("IBM Corp.") and full("Acme Ltd") == full("Acme, Limited") != full("IBM Inc") and names.organisation("Gafotiseck AG") is None
    assert names.affiliation_stem("Univ. of Dulim") == names.affiliation_stem("Dulim Research Labs") == "dulim" and names.affiliation_stem(None) is None


def test_people(spark):
    data = [
        ("Dmitri Gafotiseck", "Univ. of Dulim", None, None), ("Gafotiseck, Dima", None, None, None), ("Dmtiri Gafotiseck", None, None, None), ("D. Gafotiseck", "Dulim Research Labs", None, None), ("Ｄ. Gafotiseck", None, None, None),
        ("Quentin Gafotisecken", None, None, None), ("Anna Berovik", "Lab Xum", None, None), ("Arne Berovik", "Lab Yum", None, None), ("A. Berovik", "University of Yum", None, None), ("Berovik A", None, None, None),
        ("Mei Lin", None, "0-1", None), ("Completely Else", None, "0-1", None), (None, None, None, None), ("", None, None, None), ("Dmitri Gafotiseck", "Univ. of Dulim", None, None),
    ]
    mentions = spark.createDataFrame(data, "name string, affiliation string, orcid string, openalex_id string")
    seeds = spark.createDataFrame([("GAFOTISECK Dmitri",), (None,)], "name string")
    got = {tuple(r) for r in people.same_person_pairs(people.people(mentions, seeds)).collect()}
    same = ["Dmitri Gafotiseck", "Gafotiseck, Dima", "Dmtiri Gafotiseck", "D. Gafotiseck", "Ｄ. Gafotiseck", "GAFOTISECK Dmitri"]
    want = {tuple(sorted(p)) for p in itertools.combinations(same, 2)} - {("D. Gafotiseck", "Ｄ. Gafotiseck")}
    want |= {("A. Berovik", "Arne Berovik"), ("Completely Else", "Mei Lin")}
    assert got == want
    # A short form that stands for several names means the one that is borne, and nobody if several are.
    shared = [("Alexandra Kimoro",), ("Alex Kimoro",), ("Alexander Pitugo",), ("Sasha Pitugo",), ("Christine Wemado",), ("Christopher Wemado",), ("Chris Wemado",)]
    told = {tuple(r) for r in people.same_person_pairs(people.people(mentions.limit(0), spark.createDataFrame(shared, "name string"))).collect()}
    assert told == {("Alex Kimoro", "Alexandra Kimoro"), ("Alexander Pitugo", "Sasha Pitugo")}
    assert people.same_person_pairs(people.people(mentions.limit(0), seeds.limit(0))).count() == 0


# 6 ------------------------------------------------------------------------------------------------


def test_survivors(spark):
    stub = "point_id string, payload struct<abstract: string, doi: string, cited_by: array<string>>"
    boiler = "Please sign in to read this."
    data = [
        ("a", ("A real text that was cut …", "10.", ["x", "x", None, ""])), ("b", ("A real text that was cut off nowhere.", "DOI: 10.90001/a.1", ["x", "y"])), ("c", ("N/A", None, None)), ("d", (boiler, "", [])),
        ("e", (boiler, None, None)), ("f", (boiler, None, None)), ("g", (boiler, "10.90001/a.2", ["Q", "q"])), ("h", ("<p>Loading …</p>", None, ["z"])), ("i", (None, None, ["z"])),
    ]
    stubs = spark.createDataFrame(data, stub)
    papers = spark.createDataFrame([(1, "W-1"), (2, "https://w.org/W5000000001"), (3, "A5000000001"), (4, None), (5, "W5000000002")], "raw_id long, openalex_id string")
    member = [(1, "seed_stubs", k) for k in "abc"] + [(2, "seed_stubs", "d"), (3, "seed_stubs", "e"), (4, "seed_stubs", "f"), (5, "seed_stubs", "g"), (6, "seed_stubs", "h"), (6, "seed_stubs", "i")]
    member += [(1, "raw_papers", "1"), (1, "raw_papers", "2"), (2, "raw_papers", "3"), (2, "raw_papers", "x"), (1, "seed_stubs", "a"), (3, "seed_stubs", "nobody"), (None, "seed_stubs", "a"), (6, "raw_papers", "5")]
    members = spark.createDataFrame(member, "group_id long, member_table string, member_key string")
    got = rows(survivors.survivors(members, stubs, papers), "group_id", "field", "member_key")
    assert got == sorted([(1, "abstract", "b"), (1, "doi", "b"), (1, "cited_by", "b"), (1, "openalex_id", "2"), (5, "doi", "g"), (5, "cited_by", "g"), (6, "cited_by", "h"), (6, "openalex_id", "5")], key=str)
    assert survivors.survivors(members.limit(0), stubs, papers).count() == 0


# 7 ------------------------------------------------------------------------------------------------


def test_crosslink(spark):
    schema = "rec_id long, title string, authors array<struct<name: string>>, year int, venue string"
    noise = [(i, f"Topic{i} model{i * 7} about theme{i * 3} under regime{i * 5} with tool{i}", [(f"Some Person{chr(97 + i)}",)], 2000 + i, "V") for i in range(20)]
    left = [(1, T, [("Anna Berovik",), ("Bo Zirak",)], 2010, "Journal of Things"), (2, T + ", Part I", [("Anna Berovik",)], 2010, None), (3, None, None, None, None), (4, "", [], None, "")] + [(100 + i, *r[1:]) for i, r in enumerate(noise)]
    right = [
        (11, T.replace("beam", "baem"), [("A. Berovik",)], 2011, "JT"), (12, T, [("Some Other",)], 2010, None), (13, T, [("Berovik, Anna",)], 2016, None), (14, T + ", Part II", [("Anna Berovik",)], 2010, None),
        (15, T.split(",")[1].strip().capitalize(), [("Zirak, Bo",)], None, ""), (16, T.replace("causal ", ""), None, 2010, "Vol. 3"), (17, None, None, None, None),
    ]
    right += [(200 + i, *r[1:]) for i, r in enumerate(noise[:10])]
    got = crosslink.matched(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    pairs = {(r.left_id, r.right_id) for r in got.collect()}
    assert {p for p in pairs if p[0] < 100} == {(1, 11), (1, 15), (1, 16)}
    assert {p for p in pairs if p[0] >= 100} == {(100 + i, 200 + i) for i in range(10)}
    # The confidence tells how far a pair leads its rivals: clear for equal rows, low where a part of the series is nearer.
    sure = {(r.left_id, r.right_id): r.confidence for r in got.collect()}
    assert all(0 < c <= 1 for c in sure.values()) and min(sure[100 + i, 200 + i] for i in range(10)) > 0.5 > sure[1, 15]
    nothing = spark.createDataFrame([], schema)
    assert crosslink.matched(nothing, nothing).count() == 0


# 8 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("leaf", [2, 3, 7, 40])
def test_tree_encoding_is_plain_encoding(leaf):
    tokenizer = tokens.Tokenizer(leaf=leaf)
    rng = random.Random(leaf)
    alphabet = ["'", "s", "ll", " ", "  ", "\n", "a", "é", "5", "中", "。", "-", "'ve", "\u0301", "😀", "<|endoftext|>", "\t"]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 50)))
        assert tokenizer.encode(text) == tokenizer.bpe.encode_ordinary(text)
        assert tokenizer.decode(tokenizer.encode(text)) == text
    long = "word, 123 " * 3000 + "中" * 3000 + " " * 500
    assert tokenizer.decode(tokens.Tokenizer(leaf=500).encode(long)) == long
    assert tokens.Tokenizer(leaf=500).encode(long) == tokenizer.bpe.encode_ordinary(long)


def test_encoded_table(spark):
    docs = spark.createDataFrame([(1, "ab", 0), (2, None, 0), (3, "", 0), (1, "ab", 0)], "doc_id long, text string, ids int")
    got = rows(tokens.encoded(docs))
    assert [r[0] for r in got] == [1, 1, 2, 3] and got[2][1] == got[3][1] == [] and got[0] == got[1]
    assert tokens.encoded(docs.limit(0)).count() == 0


# 9 ------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 13, 25])))) for i in range(30)] + [(98, None), (99, "")]
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        source = items[rng.randrange(30)][1].split()
        cut = rng.randint(9, 14)
        at = rng.randint(0, max(0, len(source) - cut))
        words[3:3] = source[at : at + cut]
        text = " ".join(words)
        docs.append((d, text.upper() if d % 3 == 0 else text.replace(" ", ", ") if d % 3 == 1 else text.replace("w1", "ｗ1").replace(" w2", "\n<b>w2</b>")))
    docs += [(500, None), (501, " "), (3, docs[3][1])]
    windows = {}
    for i, t in items:
        w = leaks.words_of(t)
        for k in range(len(w) - 11):
            windows.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [leaks.words_of(t)] for k in range(len(w) - 11) for i in windows.get(tuple(w[k : k + 12]), ())}
    d, i = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7)), spark.createDataFrame(items, "item_id long, text string")
    assert want and {tuple(r) for r in leaks.leaked_items(d, i).collect()} == want
    assert leaks.leaked_items(d, i.limit(0)).count() == 0 and leaks.leaked_items(d.limit(0), i).count() == 0
    near = leaks.near_copies(d, i, similarity=0.2)
    found = {tuple(r) for r in near.collect()}
    assert {r[:2] for r in found if r[2]} == want and any(not r[2] for r in found)
    joined = leaks.near_copies(d, i, similarity=0.2, held=0)
    assert {tuple(r) for r in joined.collect()} == found
    tag = spark.createDataFrame([(1, "a b c d e f <a " + "x" * 200 + "> g h i j k l")], "doc_id long, text string")
    assert leaks.leaked_items(tag, spark.createDataFrame([(4, "a b c d e f g h i j k l")], "item_id long, text string")).count() == 1


def test_hamming_search_is_complete():
    import numpy as np

    rng = np.random.default_rng(1)
    index = leaks.ItemIndex([])
    index.prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    index.order, index.sorted, index.hit = [], [], []
    for block in range(index.blocks):
        values = index._block(index.prints, block)
        order = np.argsort(values, kind="stable")
        table = np.zeros(1 << index.width, bool)
        table[values] = True
        index.order.append(order), index.sorted.append(values[order]), index.hit.append(table)
    probe = index.prints.copy()
    for k in range(3):
        probe ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    place, item = index.within_radius(probe)
    assert set(range(200)) <= {int(p) for p, i in zip(place, item) if p == i}


# 10 -----------------------------------------------------------------------------------------------

CASES = [
    ("It fails. As Dr. Ab noted, e.g. by 3.5 points (cf. Fig. 2), it works! Wait ... does it?! Yes.", ["It fails.", "As Dr. Ab noted, e.g. by 3.5 points (cf. Fig. 2), it works!", "Wait ... does it?!", "Yes."]),
    ("“Does it scale?” asked one. He said “No, not here.” No. 7 is best.", ["“Does it scale?” asked one.", "He said “No, not here.”", "No. 7 is best."]),
    ("See Sec. 7.2 and Eq. (7) for x. It holds, see Eq. Then stop.", ["See Sec. 7.2 and Eq. (7) for x.", "It holds, see Eq.", "Then stop."]),
    ("Vgl. Abb. 8 zu z. B. Netzen. Am 3. März kam er. „Gut“, schrieb sie.", ["Vgl. Abb. 8 zu z. B. Netzen.", "Am 3. März kam er.", "„Gut“, schrieb sie."]),
    ("Pourquoi ? « Non », dit-il. Quel écart !", ["Pourquoi ?", "« Non », dit-il.", "Quel écart !"]),
    ("¿Por qué? El Dr. Uno vio la fig. 2.Además, sí.", ["¿Por qué?", "El Dr. Uno vio la fig. 2.", "Además, sí."]),
    ("他问：“能用吗？”很慢；却很少！“这还不够。”审稿人写道。", ["他问：“能用吗？”", "很慢；却很少！", "“这还不够。”审稿人写道。"]),
    ("彼は「使えますか？」と尋ねた。Ver.5.7を使った！", ["彼は「使えますか？」と尋ねた。", "Ver.5.7を使った！"]),
    ("डॉ. मोहिल ने देखा। क्या यह है?", ["डॉ. मोहिल ने देखा।", "क्या यह है?"]),
    ("قال د. تورفين إن 3.5% قليلة. لماذا؟", ["قال د. تورفين إن 3.5% قليلة.", "لماذا؟"]),
    ("ผลดีขึ้นมาก รูปที่8แสดงผล 31.7", ["ผลดีขึ้นมาก", "รูปที่8แสดงผล 31.7"]),
    ("1 Intro\n\nOne long line that is\nbroken here. Two.\n- item one\n- item two\n\ndef f(x)", ["1 Intro", "One long line that is\nbroken here.", "Two.", "- item one", "- item two", "def f(x)"]),
    ("«Этого мало», — пишет А. В. Торвин. Точность, см. рис. 3.", ["«Этого мало», — пишет А. В. Торвин.", "Точность, см. рис. 3."]),
]


CASES += [
    ("He said “" + " ".join(["Alpha beta gamma delta."] * 40) + "” Then he left. Next one.", ["He said “" + " ".join(["Alpha beta gamma delta."] * 40) + "”", "Then he left.", "Next one."]),
    ("It (see " + "x, " * 400 + "y. Z.) works. Good.", ["It (see " + "x, " * 400 + "y. Z.) works.", "Good."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == want


def test_sentence_spans_are_sound(spark):
    rng = random.Random(4)
    alphabet = ["A", "b", ".", " ", "\n", "!", "?", "“", "”", "(", ")", "中", "。", "\t", "1", "-", "\r\n", "ก"]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        spans = sentences.sentence_spans(text)
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join(text[a:b] for a, b in spans).translate({ord(c): None for c in " \n\t\r"}) == "".join(text.split())
    docs = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, " \n"), (4, "")], "doc_id long, text string").withColumn("start_pos", F.lit(1))
    assert rows(sentences.sentences(docs)) == [(1, 0, 4), (1, 5, 9)]


def test_every_training_query_runs(spark, sf_dir):
    from scholion.llm.queries import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, sf_dir).columns, name


def test_queries_agree_with_their_sql(spark, sf_dir):
    import oracle

    from scholion.llm.queries import QUERIES, SQL

    con = oracle.connection(sf_dir)
    for name, sql in SQL.items():
        assert oracle.compare(con, QUERIES[name](spark, sf_dir), sql) is None, name
