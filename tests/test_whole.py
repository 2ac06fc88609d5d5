"""Queries over small tables of their own: every row that belongs in the result is there."""

from __future__ import annotations

import difflib
import random
import re

from pyspark.sql import functions as F

from scholion.plans import entities, streams
from scholion.sources import records


def written(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_sentence_gets_a_role(spark, tmp_path):
    long = " ".join(f"Sentence {chr(97 + i)}." for i in range(24)) + " Why so?  It took 3 days.\n" + " ".join("More text." for _ in range(30))
    at = written(spark, tmp_path, "documents", [(1, long), (2, "One."), (3, " "), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.p): r.label for r in entities.sentence_roles(spark, at).collect()}
    assert sorted(got) == [(1, p) for p in range(1, 57)] + [(2, 1)]
    assert got[1, 25] == "question" and got[1, 26] == "result" and got[1, 56] == "background"


def test_titles_of_all_writings_pass_through_xml(spark, tmp_path):
    titles = ["Plain", "Q&A: a < b > c", "R&amp;D in &lt;i&gt;", "{B}ERT & <b>bold</b>", "Ünïcode 学习  of\tспам", "<i>x</i> y", "", None, "a &#233; b", "&"]
    at = written(spark, tmp_path, "raw_papers", list(enumerate(titles)), "raw_id long, title string")
    want = {i: t if t is None else re.sub(r"\s+", " ", t).strip() for i, t in enumerate(titles)}
    assert {r.raw_id: r.title for r in streams.xml_titles(spark, at).collect()} == want
    xml = spark.createDataFrame([("<paper><title>Caf&eacute; &#233;&#x5B66; &amp;lt; <i>x</i><sub>2</sub></title></paper>",), ("<titles>no</titles>",)], "x string")
    assert [r[0] for r in xml.select(records.xml_title(F.col("x"))).collect()] == ["Café é学 &lt; x2", ""]


def keywords_by_hand(words):
    out = []
    for word in words:
        for w in [word, word[:-1]] if word and re.fullmatch(r"[A-Z0-9-]{2,}s", word) else [word]:
            if w is not None and w.lower() not in [o.lower() for o in out]:
                out.append(w)
    return out


def test_keywords_with_nulls_and_plural_acronyms(spark, tmp_path):
    lists = [["LLMs", "llm", "parsing"], ["GNN", "GNNs", None], [None], ["a", "A", "b"], [], None, ["T5s", "t5S", "Xs"]]
    at = written(spark, tmp_path, "raw_papers", list(enumerate(lists)), "raw_id long, keywords array<string>")
    want = {i: keywords_by_hand(x) for i, x in enumerate(lists) if x}
    assert {r.raw_id: r.keywords for r in entities.keyword_lists(spark, at).collect()} == want
    assert {r.raw_id: r.n for r in entities.keyword_dedup(spark, at).collect()} == {i: len(x) for i, x in want.items()}


def feeds(spark, folder, left, right):
    written(spark, folder, "feed_openreview", left, "rec_id long, title string")
    return written(spark, folder, "feed_dblp", right, "rec_id long, title string")


def test_every_pair_of_like_titles_follows_from_pairs_and_members(spark, tmp_path):
    words = "a b c d e f g h i j k".split()
    left = [(1, " ".join(words)), (2, " ".join(words[::-1])), (3, " ".join(words[:10])), (4, "x y"), (5, None)]
    right = [(11, " ".join(words).upper()), (12, " ".join(words[:10] + ["z"])), (13, "X, y"), (14, " ".join(words[:10])), (15, ""), (16, "x")]
    at = feeds(spark, tmp_path, left, right)
    near = {(r.a, r.b) for r in entities.fuzzy_title_jaccard(spark, at).collect()}
    head = {r.rec_id: r.representative for r in entities.title_set_members(spark, at).collect()}
    sets = {i: frozenset(re.sub(r"[^a-z ]", "", t.lower()).split()) for i, t in left + right if t}
    assert sorted(head) == sorted(sets)
    want = {(x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) >= 0.9 * len(sets[x] | sets[y])}
    got = {(x, y) for x in head for y in head if x < y and (head[x] == head[y] or tuple(sorted((head[x], head[y]))) in near)}
    assert got == want and (1, 11) in want and (3, 11) in want


def test_contained_titles_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["parsing", "of", "the", "deep", "court", "records", "nets", "x", "satellite", "imagery", "a", "für"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) for _ in range(40)]
    parts = [t[i : i + rng.randint(1, 40)].strip() for t in texts for i in (0, rng.randint(0, 20))]
    left, right = list(enumerate(texts + parts[::2] + ["", None])), [(1000 + i, t) for i, t in enumerate(parts[1::2] + texts[::3] + ["Subnets " + texts[0], None])]
    fold = lambda t: " ".join((t or "").lower().replace("ü", "u").split())
    want = {(a, b) for a, x in left for b, y in right for s, t in [(fold(x), fold(y))] if s == t or s and len(t) > 20 and (s in t or t in s)}
    got = [(r.a, r.b) for r in entities.containment_title_match(spark, feeds(spark, tmp_path, left, right)).collect()]
    assert sorted(got) == sorted(want)
    assert any(0 < len(fold(left[a][1])) < 19 and fold(right[b - 1000][1]).find(fold(left[a][1])) > 0 for a, b in want)


def test_near_sequences_against_brute_force(spark, tmp_path):
    rng = random.Random(5)

    def damaged(text):
        letters = list(text)
        for _ in range(rng.randint(0, len(text) // 8 + 1)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "q", "an "])
        return "".join(letters)

    texts = ["Introducing Motaz, a toolkit", "of one", "ab", "a", *("".join(rng.choices("abcde ", k=rng.randint(3, 90))) for _ in range(60))]
    left, right = list(enumerate([*texts, texts[0], None, ""])), [(1000 + i, t) for i, t in enumerate(["Introdcing Motaz, a toolkit", *(damaged(t) for t in texts * 2), "", None])]
    fold = lambda t: " ".join(re.sub("[^a-z ]", "", (t or "").lower()).split())
    ratios = {(a, b): round(difflib.SequenceMatcher(None, fold(x), fold(y)).ratio(), 4) for a, x in left for b, y in right if fold(x) and fold(y)}
    want = sorted((*pair, r) for pair, r in ratios.items() if r >= 0.9)
    got = sorted((r.a, r.b, r.ratio) for r in entities.sequence_title_match(spark, feeds(spark, tmp_path, left, right)).collect())
    assert got == want and any(fold(left[a][1])[:12] != fold(right[b - 1000][1])[:12] for a, b, _ in got)


def test_repositories_are_those_the_text_names(spark, tmp_path):
    texts = ["Code: https://GitHub.com/acl/r1. See also https://github.com/acl/r1.git", "At http://www.gitlab.com/x/y-z.git.\nand https://github.com/q/w.js, too", "none", None]
    at = written(spark, tmp_path, "documents", [(i, "acl", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = sorted((r.doc_id, r.url) for r in entities.repository_links(spark, at).collect())
    assert got == [(0, "https://github.com/acl/r1"), (1, "http://www.gitlab.com/x/y-z"), (1, "https://github.com/q/w.js")]
