"""Operators on small fixtures: nulls, blanks, ties, repeats, empty tables and clashing extra columns."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from scholion.functions import text as T
from scholion.operators import graph as G, orphans as O, relational as R, search as S
from scholion.sources import records, sinks
from scholion.streaming import live


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


REF = "src_table string, field string, space string, owner_id string, ref_id string, owner_updated timestamp_ntz, owner_fetched timestamp_ntz"
PARENT = "space string, ref_id string, first_seen timestamp_ntz, deleted_at timestamp_ntz"


def moment(spark, frame, *columns):
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def refs(spark, data):
    return moment(spark, spark.createDataFrame(data, REF.replace("timestamp_ntz", "string")), "owner_updated", "owner_fetched")


def known(spark, data):
    return moment(spark, spark.createDataFrame(data, PARENT.replace("timestamp_ntz", "string")), "first_seen", "deleted_at")


def test_orphans_are_the_same_in_one_step_or_many(spark):
    r = [("t", "f", "record", f"o{i}", k, "2024-01-01", "2023-05-01") for i, k in enumerate(["a", "b", "c", "d", "a"])]
    p = [("record", "a", "2023-01-01", None), ("record", "b", "2024-06-01", None), ("record", "c", "2023-01-01", None), ("record", "c", "2023-01-01", "2023-12-01")]
    whole = O.found(O.OrphanState().advance(refs(spark, r), known(spark, p)))
    assert rows(whole, "owner_id", "ref_id", "kind") == [("o1", "b", "late"), ("o2", "c", "deleted"), ("o3", "d", "missing")]
    state = O.OrphanState()
    first = state.advance(refs(spark, r), known(spark, []))
    assert {x.kind for x in first.collect()} == {"missing"} and first.count() == 5
    state.advance(refs(spark, []), known(spark, p[:3]))
    assert state.open.count() == 2
    last = state.advance(refs(spark, []), known(spark, p[3:]))  # a deletion reopens a settled reference
    assert rows(O.found(last), "owner_id", "ref_id", "kind") == rows(whole, "owner_id", "ref_id", "kind")
    months = O.report(last).collect()
    assert sum(m.orphans for m in months) == 3 and {m.month for m in months} == {"2023-05"}


def test_orphan_keys_in_all_writings(spark):
    key = "0910c10d-1dba-7260-42cc-46c9f16d70ec"
    data = [(key.upper(),), ("urn:uuid:" + key,), ("{" + key + "}",), (key.replace("-", ""),), (" ",), (None,)]
    df = spark.createDataFrame(data, "x string").select(O.record_key(F.col("x")).alias("k"))
    assert [r.k for r in df.collect()] == [key] * 4 + [None, None]
    works = spark.createDataFrame([("w12",), ("https://x.org/W12",), ("openalex:W12 ",), ("",)], "x string").select(O.work_key(F.col("x")).alias("k"))
    assert [r.k for r in works.collect()] == ["W12"] * 3 + [None]


def test_orphans_of_empty_tables(spark):
    state = O.OrphanState().advance(refs(spark, []), known(spark, []))
    assert O.found(state).count() == 0 and O.report(state).count() == 0


def test_prioritized_match_prefers_earlier_keys_and_least_ids(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, " ", None)], "id int, d string, t string")
    right = spark.createDataFrame([(9, "a", "q"), (8, "a", "x"), (7, "z", "x")], "rid int, rd string, rt string")
    out = R.prioritized_match(left, right, [("doi", F.col("d"), F.col("rd")), ("title", F.col("t"), F.col("rt"))], "id", "rid")
    assert rows(out, "id", "rid", "matched_by") == [(1, 8, "doi"), (2, 7, "title")]


def test_fill_missing_keeps_what_is_there(spark):
    target = spark.createDataFrame([(1, "a", None), (2, " ", ["x"]), (3, None, [])], "k int, s string, l array<string>")
    updates = spark.createDataFrame([(1, "b", ["n"]), (2, "c", ["n"])], "k int, s string, l array<string>")
    out = R.fill_missing(target, updates, "k", {"s": "string", "l": "array"})
    assert rows(out, "k", "s", "l", "filled") == [(1, "a", ["n"], ["l"]), (2, "c", ["x"], ["s"]), (3, None, [], [])]


def test_similar_sets_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    data = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 7))]) for i in range(60)]
    got = {(r.a, r.b) for r in R.similar_sets(spark.createDataFrame(data, "id int, t array<string>"), "id", "t", 0.6).collect()}
    reps = {}
    for i, t in data:
        if t:
            reps.setdefault(frozenset(t), i)
    want = {tuple(sorted((reps[a], reps[b]))) for a, b in itertools.combinations(reps, 2) if len(a & b) / len(a | b) >= 0.6}
    assert got == want


def test_graph_operators(spark):
    e = G.simple_edges(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("a", "b"), ("x", "y"), (None, "a")], "src string, dst string"))
    assert e.count() == 4
    assert dict(rows(G.triangles(e), "node", "triangles")) == {"a": 1, "b": 1, "c": 1}
    assert dict(rows(G.weak_components(e), "node", "component")) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    ranks = dict(rows(G.pagerank(e, rounds=30), "node", "pagerank"))
    assert sum(ranks.values()) == pytest.approx(1) and ranks["y"] > ranks["x"]
    h = G.hits(e, rounds=5)
    assert h.agg(F.sum("hub")).first()[0] == pytest.approx(1)
    assert G.communities(e).count() == 5
    empty = e.limit(0)
    assert G.pagerank(empty).count() == 0 and G.weak_components(empty).count() == 0


def test_neighbourhood_takes_the_least_hop(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    out = G.neighbourhood(e, spark.createDataFrame([("a",)], "node string"), 2)
    assert rows(out, "node", "hop") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_search_operators(spark):
    docs = spark.createDataFrame([(1, "beam search works"), (2, "Beam BEAM search"), (3, ""), (4, None), (5, "other words")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "beam search"), (2, "absent")], "qid int, query string")
    found = S.top(S.bm25(docs, asked), ["qid"], "score", "doc_id", 5)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [2, 1]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    near = S.cosine_blocks(vectors, vectors.where("vec_id = 1").withColumnRenamed("vec_id", "qid"), 2, same=True)
    assert [r.vec_id for r in near.orderBy("rank").collect()] == [2, 3]
    pool = spark.createDataFrame([(1, 1, 1.0, ["a"]), (1, 2, 0.9, ["a"]), (1, 3, 0.8, ["b"]), (1, 4, None, None)], "qid int, id int, score double, kw array<string>")
    picked = S.diversified(pool, "qid", "id", "score", "kw", limit=2, weight=0.5)
    assert [r.id for r in picked.orderBy("place").collect()] == [1, 3]


def test_text_functions(spark):
    df = spark.createDataFrame([("Éa  b-c!",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalize_title(F.col("t"))).collect()] == ["ea bc", ""]
    assert [r[0] for r in df.select(T.normalize_title_nfkd("t")).collect()] == ["ea bc", ""]
    one = spark.range(1)
    name = "openalex:W2741809807"
    assert one.select(T.uuid5_url(F.lit(name))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    refs_ = ["DOI:10.1000/ABC", "https://doi.org/10.1000/x", "arXiv:arXiv:2101.00001v2", "openalex:W12", "TITLE: Some", "what"]
    got = spark.createDataFrame([(r,) for r in refs_], "r string").select(T.normalize_identifier(F.col("r"))).collect()
    assert [g[0] for g in got] == ["doi:10.1000/abc", "doi:10.1000/x", "arxiv:2101.00001", "openalex:W12", "title:some", None]
    index = one.select(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))).alias("i"))
    assert index.select(T.text_of_inverted_index(F.col("i"))).first()[0] == "a b a"
    acr = spark.createDataFrame([("BERT: the GPT (LLaMA) of IT",)], "t string").select(T.acronyms(F.col("t"))).first()[0]
    assert acr == ["BERT", "LLaMA", "GPT"]


def test_snapshot_source_and_quarantine(spark, tmp_path):
    import gzip

    part = tmp_path / "updated_date=2024-01-01"
    part.mkdir()
    with gzip.open(part / "a.gz", "wt") as f:
        f.write('{"id": "W1", "title": "x"}\n\n{this is not json}\n')
    works = records.snapshot_works(spark, str(tmp_path))
    assert [r.id for r in works.collect()] == ["W1"]
    done = works.first().file
    with gzip.open(part / "xa.gz", "wt") as f:
        f.write('{"id": "W2", "title": "y"}\n')
    assert [r.id for r in records.snapshot_works(spark, str(tmp_path), done=[done]).collect()] == ["W2"]
    assert records.quarantined(spark, str(tmp_path)).count() == 1
    (tmp_path / "live").mkdir()
    (tmp_path / "live" / "a.json").write_text('{"id": "W1", "updated_date": "2024-01-01T00:00:00"}\n{"id": "W2", "updated_date": "2023-12-31"}\n{"id": "W3"}\n{"title": "no id"}\n')
    taken = []
    query = records.works_stream(spark, str(tmp_path / "live"), "2024-01-01").writeStream.foreachBatch(lambda b, _: taken.extend(r.id for r in b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(taken) == ["W1", "W3"]


def test_record_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<volume><paper id="1"><title>T</title><author><first>A</first><last>B</last></author><year>2020</year><month>June-July</month></paper></volume>')
    paper = records.anthology(spark, str(tmp_path / "a.xml")).first()
    assert (paper.title, paper.authors, paper.month) == ("T", ["A B"], 6)
    note = spark.createDataFrame([('{"content": {"title": {"value": "v2"}}}',), ('{"content": {"title": "v1"}}',), ("{",)], "n string")
    assert [r[0] for r in note.select(records.note_field(F.col("n"), "title")).collect()] == ["v2", "v1", None]
    venue = spark.createDataFrame([("ICLR 2024 poster",), ("Submitted to ICLR",), (None,), ("Rejected poster",)], "v string")
    assert [r[0] for r in venue.select(records.accepted(F.col("v"))).collect()] == [True, False, False, False]
    page = spark.createDataFrame([("<html><TITLE>A &amp;\n b</TITLE>",), ("<p>",)], "h string")
    assert [r[0] for r in page.select(records.html_title(F.col("h"))).collect()] == ["A & b", None]
    years = spark.createDataFrame([("07",), ("98",), ("2011",), ("x",)], "y string")
    assert [r[0] for r in years.select(records.two_digit_year(F.col("y"))).collect()] == [2007, 1998, 2011, None]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'say "x" & <y>', ["p", "q"]), ("b", None, None)], "id string, title string, tags array<string>")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    for kind in ("csv", "json", "graphml"):
        sinks.export(edges, nodes, str(tmp_path / kind), kind)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv_nodes"))
    assert rows(back, "id", "title", "tags")[0] == ("a", 'say "x" & <y>', "p|q")
    import xml.etree.ElementTree as ET

    parts = sorted((tmp_path / "graphml").glob("part-*"))
    tree = ET.fromstring("".join(p.read_text() for p in parts))
    assert len([x for x in tree.iter() if x.tag.endswith("node")]) == 2
    with pytest.raises(ValueError):
        sinks.export(edges, nodes, str(tmp_path / "z"), "zip")


def test_streams(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(1, i * 10), (i, i)], "k int, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target = live.VersionedTable(spark, str(tmp_path / "state"), "k int, v int")
    assert target.read().count() == 0
    live.merge_stream(stream, target, "k", "v", str(tmp_path / "check")).awaitTermination()
    assert rows(target.read(), "k", "v") == [(0, 0), (1, 20), (2, 2)]
    before = target.versions()
    live.merge_stream(stream, target, "k", "v", str(tmp_path / "check")).awaitTermination()
    assert target.versions() == before
    log = spark.createDataFrame([("a", 2, False, "s2"), ("a", 1, False, "s1"), ("b", 3, False, "s"), ("b", 4, True, "s")], "k string, seq int, gone boolean, src string")
    assert rows(live.folded_queue(log, "k", "seq", "gone", "src"), "k", "seq", "source") == [("a", 1, "s1")]
    seen = []
    live.phases_stream(stream, [lambda b, _: seen.append(("first", b.count())), lambda b, _: seen.append(("then", b.count()))], str(tmp_path / "check2")).awaitTermination()
    assert seen[0][0] == "first" and seen[1][0] == "then" and sum(n for w, n in seen if w == "first") == 6


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, None), (None, "n", None)], "k int, s string, extra string")
    new = spark.createDataFrame([(1, "late", 2), (1, "early", 1), (3, None, 1), (9, "z", 1), (None, "no", 1)], "k int, s string, n int")
    out = R.set_fields(old, new, "k", {"s": "s"}, "n")
    assert rows(out, "k", "s", "extra") == sorted([(1, "late", "x"), (2, "b", None), (3, None, None), (None, "n", None)], key=str)
    kept = R.set_fields(old, new, "k", {"s": "s"}, "n", keep=True)
    assert (3, None) in rows(kept, "k", "s") and (1, "late") in rows(kept, "k", "s")
    assert rows(R.insert_new(old.select("k", "s"), new.select("k", "s"), "k", "s"), "k", "s") == sorted([(1, "a"), (2, "b"), (3, None), (None, "n"), (9, "z")], key=str)
    assert rows(R.delete_keys(old, new, "k"), "k") == [(2,), (None,)]
    stubs = spark.createDataFrame([("b", 2, ["x", "y"], {"p": "2", "q": "3"}, None), ("b", 1, ["y", None], {"p": "1"}, None), ("c", 3, None, None, "t")], "g string, i int, l array<string>, m map<string, string>, t string")
    merged = {r.g: r for r in R.merge_groups(stubs, "g", "i", ["l"], ["t"], ["m"]).collect()}
    assert (merged["b"].i, merged["b"].l, merged["b"].m, merged["b"].members) == (1, ["x", "y"], {"p": "1", "q": "3"}, 2) and merged["c"].l == [] and merged["c"].t == "t"


def test_subgraphs_and_communities(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x")], "src string, dst string")
    center = spark.createDataFrame([("a",)], "node string")
    nodes, inner = G.subgraph(e, center, 1, "cited")
    assert rows(nodes, "node", "hop", "is_center") == [("a", 0, True), ("b", 1, False)] and rows(inner, "src", "dst") == [("a", "b")]
    nodes, inner = G.subgraph(e, center, 1, "citing")
    assert rows(nodes, "node") == [("a",), ("c",)] and rows(inner, "src", "dst") == [("c", "a")]
    found = dict(rows(G.communities(e), "node", "community"))
    assert len(set(found.values())) == 2 and found["a"] == found["b"] == found["c"] and found["x"] == found["y"] == found["z"]
    clustering = dict(rows(G.local_clustering(e), "node", "clustering"))
    assert clustering["a"] == 1 and clustering["c"] == pytest.approx(1 / 3)
    with pytest.raises(RuntimeError):
        G.weak_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int"), max_rounds=1)


def test_phases_are_the_same_in_one_batch_or_many_and_after_a_replay(spark, tmp_path):
    from scholion.streaming import phases

    kind = "raw_id long, openalex_id string, abstract string, doi string, year int, citation_count int, referenced_works array<string>"
    works = [(10, "W1", "text", None, 2020, 3, ["W2", "W9"]), (11, "W3", "new", "10.1/x", 2021, None, ["W1"]), (12, "W1", "later", "10.1/y", 2022, 1, []), (13, None, "x", None, None, None, None), (14, "W3", "again", None, None, None, ["W1", None])]
    corpus = spark.createDataFrame([(1, "W1", " ", None), (2, "W2", "own", "10.1/z")], "raw_id long, openalex_id string, abstract string, doi string")
    states = []
    for name, cuts in (("one", [works]), ("many", [works[:2], works[2:]])):
        for part in cuts:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        made = phases.Phases(spark, str(tmp_path / name))
        made.start(corpus)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in"))
        made.run(stream)
        before = made.corpus.versions(), made.citers.versions()
        made.run(stream, str(tmp_path / name / "second"))  # the same batches once more, as after a lost checkpoint
        assert (made.corpus.versions(), made.citers.versions()) == before
        states.append((rows(made.corpus.read(), "raw_id", "openalex_id", "injected"), rows(made.citers.read(), "raw_id", "citer")))
    assert states[0] == states[1] == ([(1, "W1", False), (11, "W3", True), (2, "W2", False)], [(1, "W3"), (2, "W1")])
    assert rows(made.corpus.read().where("raw_id = 1"), "abstract", "doi", "filled") == [("text", "10.1/y", "abstract,doi")]


def test_a_replay_by_period_ends_where_one_step_does(spark):
    r = [("t", "f", "record", f"o{i}", k, u, "2023-05-01") for i, (k, u) in enumerate([("a", "2024-01-01"), ("b", "2024-05-01"), ("c", "2024-01-01"), ("d", None), ("a", "2023-01-01")])]
    p = [("record", "a", "2023-02-01", None), ("record", "b", "2024-06-01", None), ("record", "c", "2023-01-01", "2024-08-01"), ("record", "e", None, None)]
    once = O.OrphanState().advance(refs(spark, r), known(spark, p))
    state, taken = O.replay(refs(spark, r), known(spark, p), snapshots=True)
    assert rows(O.found(state.open), "owner_id", "ref_id", "kind") == rows(O.found(once), "owner_id", "ref_id", "kind") == [("o1", "b", "late"), ("o2", "c", "deleted"), ("o3", "d", "missing"), ("o4", "a", "late")]
    counts = {(str(x.period), x.kind): x.orphans for x in taken.collect()}
    assert counts["2024-04-01", "late"] == 2 and counts["2024-07-01", "deleted"] == 1 and ("2024-04-01", "deleted") not in counts
    empty = O.replay(refs(spark, []), known(spark, []), snapshots=True)
    assert empty[0].open.count() == 0 and empty[1].count() == 0


def test_rows_that_went_hold_no_keys(spark):
    import random

    rng = random.Random(2)
    data = [(i, rng.choice(["a", "b", "c", "d", "", None]), rng.choice(["x", "y", "z", "u", "v", None])) for i in range(40)] + [(100 + i, f"p{i // 2}", f"q{(i + 1) // 2}") for i in range(12)]
    kept, seen = [], set()
    for i, a, b in data:
        keys = {(n, k) for n, k in (("a", a), ("b", b)) if k}
        if not keys & seen:
            kept.append(i)
            seen |= keys
    frame = spark.createDataFrame(data, "i int, a string, b string")
    assert [r[0] for r in rows(R.arrival_dedup(frame, [("a", F.col("a")), ("b", F.col("b"))], "i").orderBy("i"), "i")] == sorted(kept, key=str)
    assert R.arrival_dedup(frame.limit(0), [("a", F.col("a"))], "i").count() == 0
