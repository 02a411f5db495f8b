"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions import text as T
from tessera.operators import asof, intervals, relations, retrieval
from tessera.operators import mentions as M
from tessera.operators import sequences as S
from tessera.operators import validate as V
from tessera.sources import html, store


def claims(spark, rows):
    return spark.createDataFrame(rows, "subject int, predicate string, value string, vol int, claim_id int, confidence double")


def test_supersession_merges_only_neighbours(spark):
    rows = claims(spark, [(1, "P", v, t, t, 0.5) for t, v in ((1, "A"), (2, "a"), (4, "B"), (6, "A"))])
    out = intervals.single_valued_intervals(rows).orderBy("vol_start").collect()
    assert [(r.value, r.vol_start, r.vol_end) for r in out] == [("A", 1, 3), ("B", 4, 5), ("A", 6, None)]
    assert out[0].claim_ids == [1, 2]
    assert [r.superseded_by for r in out] == [out[1].interval_id, out[2].interval_id, None]
    iv = intervals.single_valued_intervals(rows)
    assert [r.value for r in asof.state_at(iv, 4).collect()] == ["B"]
    assert [(r.value, r.vol_end) for r in asof.history_at(iv, 4).collect()] == [("A", 3)]
    assert [r.value for r in asof.state_at(iv, 3).collect()] == ["A"] and asof.history_at(iv, 3).count() == 0


def test_nothing_after_the_cutoff_is_visible(spark):
    iv = intervals.single_valued_intervals(claims(spark, [(s, "P", str(t % 3), t, 10 * s + t, 0.1 * t) for s in range(5) for t in range(1, 8)]))
    for t in range(1, 8):
        assert asof.state_at(iv, t).where(F.col("vol_start") > t).count() == 0
        assert asof.state_at(iv, t).where("vol_end is not null").count() == 0


def test_a_verdict_hits_only_its_own_interval_under_a_common_id(spark):
    rows = "interval_id string, subject int, predicate string, value string, vol_start int, vol_end int"
    iv = spark.createDataFrame([("i_1", 1, "P", "x", 1, None), ("i_1", 2, "P", "x", 1, None), ("i_1", 2, "P", "y", 3, None), ("i_2", 3, "P", "x", 1, None)], rows)
    verdicts = spark.createDataFrame([("i_1", 2, "P", 1, "unsupported"), ("i_1", 1, "P", 1, "supported"), ("i_2", 3, "P", 1, "unsupported")], "interval_id string, subject int, predicate string, vol_start int, verdict string")
    assert sorted((r.subject, r.value) for r in asof.judged(iv, verdicts).collect()) == [(1, "x"), (2, "y")]
    assert [r.interval_id for r in asof.judged(iv, verdicts.select("interval_id", "verdict")).collect()] == []
    edges = iv.select("interval_id", F.lit("a").alias("subject"), F.col("subject").cast("string").alias("object"), "predicate", "vol_start").where("value = 'x'")
    states = spark.createDataFrame([("2", "closed", 1, None), ("1", "open", 1, None)], "subject string, value string, vol_start int, vol_end int")
    assert sorted(r.object for r in relations.drop_contradicted(edges, states, {"P": "open"}).collect()) == ["1", "3"]


def test_fact_set_keeps_different_intervals_of_a_common_id(spark):
    from tessera.operators import pages

    rows = [("i_1", 1, "P", "x", 1, None, [1, 2, 3]), ("i_1", 2, "P", "x", 1, None, [4]), ("i_1", 2, "P", "x", 1, None, [4]), ("i_2", 3, "P", "x", 5, None, [5])]
    iv = spark.createDataFrame(rows, "interval_id string, subject int, predicate string, value string, vol_start int, vol_end int, claim_ids array<long>")
    assert sorted((r.subject, r.quotes) for r in pages.fact_set(iv, 4, 2).collect()) == [(1, [1, 2]), (2, [4])]


def test_nearest_of_label_equals_force_in_many_tiles(spark, monkeypatch):
    import random

    draw = random.Random(3)
    rows = [(i, i % 3 if i % 50 else None, [float(draw.randint(-2, 2)) for _ in range(3)]) for i in range(200)] + [(200, 1, None), (201, 1, [0.0, 0.0, 0.0]), (203, 1, [1.0, None, 1.0]), (204, 1, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "doc_id long, label int, vector array<float>")
    pairs = v.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "label", F.col("vector").alias("q")).join(v, "label").where("query_id <> doc_id")
    want = retrieval.ranked(pairs.select("query_id", "doc_id", retrieval.cosine(F.col("q"), F.col("vector")).alias("score")), 7).collect()
    monkeypatch.setattr(retrieval, "TILE", (5, 9))
    found = retrieval.nearest_of_label(v.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "query_id"), v, 7)
    assert found.count() < pairs.count()  # a tile leaves out what can't be among the nearest
    got = retrieval.ranked(found, 7).collect()
    assert sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in got) == sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in want)


def test_best_overlap_keeps_one_row_an_item_and_task(spark, monkeypatch):
    import random

    draw = random.Random(4)
    docs = [(i % 40, i // 40, [w for w in "abcdefg" if draw.random() < 0.4] if i % 13 else None) for i in range(200)]
    asked = [(i, w, float("bcdefgh".index(w))) for i in range(9) for w in "bcdefgh" if draw.random() < 0.5 or w == "b"]
    want = {}
    for i in {r[0] for r in asked}:
        of = {w: x for j, w, x in asked if j == i}
        want[i] = min((-sum(of.get(w, 0) for w in ws), a, b) for a, b, ws in docs if ws and set(ws) & set(of))
    d = spark.createDataFrame(docs, "a long, b long, words array<string>").repartition(3)
    for most in (1000, 2):
        monkeypatch.setattr(retrieval, "ITEMS", most)
        rows = retrieval.best_overlap(d, spark.createDataFrame(asked, "item_id long, w string, idf double")).collect()
        assert len(rows) <= 3 * len(want)
        assert {i: min((-r.score, r.a, r.b) for r in rows if r.item_id == i) for i in want} == want


def test_bm25_keeps_the_best_rows_of_a_query_and_task(spark, monkeypatch):
    import math
    import random
    import re
    from collections import Counter

    draw = random.Random(5)
    text = lambda n: draw.choice([" ", "\n", "-", ""]).join(draw.choice(["a", "the", "Cat", "über", "x1y", "q", "\0b", "zz"]) for _ in range(n))
    docs = [(i, text(draw.choice([0, 1, 5, 30])) if i % 17 else None) for i in range(600)] + [(600 + i, "the cat") for i in range(300)]
    asked = [(i, text(4)) for i in range(12)] + [(20, None), (21, "unheard of")]
    words = lambda x: re.findall("[a-z]+", (x or "").lower())

    def scores(docs):
        """By hand; rows of one id are one document, whose terms count for the length of each."""
        lens = [(d, len(words(x))) for d, x in docs if x is not None]
        tf = Counter((w, d) for d, x in docs for w in words(x))
        df, mean = Counter(w for w, _ in tf), sum(n for _, n in lens) / len(lens)
        of = {}
        for q, x in asked:
            for w in set(words(x)):
                for d, n in lens:
                    if (w, d) in tf and d is not None:
                        idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                        of[q, d] = of.get((q, d), 0) + idf * tf[w, d] * 2.5 / (tf[w, d] + 1.5 * (0.25 + 0.75 * n / mean))
        return of

    queries = spark.createDataFrame(asked, "query_id long, text string")
    for rows in (docs, [*docs, (None, "the cat"), (None, "q"), (5, "the q the"), (5, None), (600, "the cat")]):
        of = scores(rows)
        best = [(q, d, n + 1) for q in {q for q, _ in of} for n, (_, d) in enumerate(sorted((-round(x, 9), d) for (p, d), x in of.items() if p == q)[:7])]
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        for most in (1000, 5):
            monkeypatch.setattr(retrieval, "ITEMS", most)
            assert {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(d, queries).collect()} == pytest.approx(of)
            found = retrieval.bm25(d, queries, top=7)
            assert found.count() <= 4 * 7 * len(asked) < len(of)  # no pair leaves its task but the best
            assert sorted((r.query_id, r.doc_id, r["rank"]) for r in retrieval.ranked(found, 7).collect()) == sorted(best)


def test_pages_leave_the_scan_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["<h1>a</h1><p>b</p>", None, "<p>c</p>", "<p>d</p>"])], names=["id", "html"])
    monkeypatch.setattr(html, "FEW", 8)
    groups = list(html._few(b))
    assert len(groups) == 4 and [r[:3] + r[4:] for g in groups for r in g] == [(1, 0, "h1", "a"), (1, 1, "p", "b"), (3, 0, "p", "c"), (4, 0, "p", "d")]


def test_conflict_resolution_by_gap(spark):
    rows = claims(spark, [(1, "P", "x", 1, 1, 0.95), (1, "P", "y", 1, 2, 0.80), (2, "P", "x", 1, 3, 0.95), (2, "P", "y", 1, 4, 0.90)])
    out = {r.subject: r.resolution for r in intervals.same_period_conflicts(rows).collect()}
    assert out == {1: "rule:higher_confidence", 2: "rule:higher_confidence_fallback"}


def test_multi_valued_first_seen_wins(spark):
    rows = spark.createDataFrame([(1, "P", "x", 2, 1, "", 0.5), (1, "P", "X", 1, 2, "", 0.5), (1, "P", "x", 3, 3, "late", 0.5)], "subject int, predicate string, value string, vol int, claim_id int, qualifier string, confidence double")
    (r,) = intervals.multi_valued_intervals(rows).collect()
    assert (r.value, r.vol_start, r.qualifier, r.evidence_count) == ("X", 1, None, 3)


@pytest.mark.parametrize(("text", "want"), [("25", "25"), ("twenty-five", "25"), ("twenty-five years old", "25"), ("twenty-five to thirty", "25-30"), ("young", "young"), ("17-19 or 21", "17-19-21"), (" Old  Man ", "old man")])
def test_number_fold(spark, text, want):
    assert spark.range(1).select(T.number_or_range(F.lit(text))).first()[0] == want


def test_ngrams_kept(spark):
    t = "a b c d e f g h i"
    row = spark.range(1).select(T.ngrams_kept(F.lit(t), F.lit(t)), T.ngrams_kept(F.lit("a b c d e f g"), F.lit(t))).first()
    assert tuple(row) == (1.0, 0.0)


def test_symmetric_and_inverse_direction(spark):
    p = relations.catalog(spark, [("FRIEND", True, None, [], False, None, None), ("PARENT_OF", False, "CHILD_OF", [], False, None, None), ("CHILD_OF", False, "PARENT_OF", [], False, None, None)])
    rows = spark.createDataFrame([("b", "a", "FRIEND"), ("x", "y", "PARENT_OF")], "subject string, object string, predicate string")
    got = {tuple(r) for r in relations.canonical_direction(rows, p).select("subject", "predicate", "object").collect()}
    assert got == {("a", "FRIEND", "b"), ("y", "CHILD_OF", "x")}


def test_conflicts_must_be_mutual(spark):
    p = relations.catalog(spark, [("FRIEND", True, None, ["ENEMY"], False, None, None), ("ENEMY", True, None, ["FRIEND"], False, None, None), ("COMRADE", True, None, ["ENEMY"], False, None, None)])
    present = spark.createDataFrame([(1, "FRIEND"), (1, "ENEMY"), (1, "COMRADE")], "k int, predicate string")
    got = {r.predicate: r.clique for r in relations.cliques(present, relations.conflict_groups(p), ["k"]).collect()}
    assert got == {"FRIEND": "ENEMY", "ENEMY": "ENEMY", "COMRADE": "COMRADE"}


def test_weaker_direction_goes(spark):
    rows = spark.createDataFrame([("X", "Y", "P", 0.9, 2, "1"), ("Y", "X", "P", 0.9, 1, "0")], "subject string, object string, predicate string, confidence double, n_evidence int, claim_id string")
    assert [r.subject for r in relations.drop_weaker_direction(rows).collect()] == ["X"]


def test_subsume(spark):
    rows = spark.createDataFrame([(1, v) for v in ("hair", "long brown hair", "brown hair", "scar")], "k int, value string")
    assert {r.value for r in relations.subsume(rows, ["k"]).collect()} == {"long brown hair", "scar"}


@pytest.mark.parametrize("limit", [M.MOST_FORMS, 0])
def test_longest_mention(spark, monkeypatch, limit):
    monkeypatch.setattr(M, "MOST_FORMS", limit)  # 0: the same scan as a join
    forms = spark.createDataFrame([("Orla Brandt", 1), ("Brandt", 2), ("Orl", 3)], "text string, entity int")
    rows = spark.createDataFrame([("p", "Orla Brandt met Orlx")], "para_id string, text string")
    assert [(r.surface, r.start, r.end) for r in M.find_mentions(rows, forms).collect()] == [("Orla Brandt", 0, 11)]


def test_resolve_by_containment(spark):
    forms = spark.createDataFrame([("Mara Lenz", "k"), ("Norman", "n"), ("Old Bob", "b1"), ("Bob Roe", "b2")], "text string, entity string")
    texts = spark.createDataFrame([("Mara",), ("man",), ("Bob",)], "text string")
    assert {r.text: r.entity for r in M.resolve(texts, forms).collect()} == {"Mara": "k", "man": None, "Bob": None}


def test_votes(spark):
    rows = spark.createDataFrame([("a", 1)] * 2 + [("a", 2)] + [("b", 1)] * 3 + [("b", 2)] * 2, "k string, e int")
    assert [tuple(r) for r in M.votes(rows, "k", "e").collect()] == [("a", 1, 2)]


def test_window_caps_and_sessions(spark):
    caps = {r.k: r.cap for r in S.sqrt_caps(spark.createDataFrame([("a", 100), ("b", 1)], "k string, n int"), 40, 3).collect()}
    assert caps == {"a": 73, "b": 7}
    rows = spark.createDataFrame([(1, 0), (1, 5), (1, 20)], "k int, p int")
    assert [r.session for r in S.gap_sessions(rows, ["k"], F.col("p"), 9, "p").orderBy("p").collect()] == [0, 0, 1]


def test_ranges_as_text(spark):
    rows = spark.createDataFrame([(1, v) for v in (1, 2, 3, 5)], "k int, v int")
    assert S.ranges_as_text(rows, ["k"], "v").first().ranges == "1-3, 5"


def test_changes_only(spark):
    rows = spark.createDataFrame([(1, 1, "h1"), (1, 2, "h1"), (1, 3, "h2")], "k int, vol int, state string")
    assert sorted(r.vol for r in asof.changes_only(rows, ["k"], "state").collect()) == [1, 3]
    assert asof.latest_at(asof.changes_only(rows, ["k"], "state"), ["k"], 2, "state").first().vol == 1


def test_statistics(spark):
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 0.0)
    assert spark.range(1).select(stats.zero_event_bound(F.lit(43))).first()[0] == pytest.approx(1 - 0.05 ** (1 / 43))
    reps = stats.bootstrap(spark.createDataFrame([(c, c % 2, 1) for c in range(200)], "c int, num int, den int"), "c", 300)
    mean, sd = reps.agg(F.avg("value"), F.stddev("value")).first()
    assert mean == pytest.approx(0.5, abs=0.01) and sd == pytest.approx((0.25 / 200) ** 0.5, rel=0.2)


def test_fusion(spark):
    one = spark.createDataFrame([(1, 7, 1)], "query_id int, doc_id int, rank int")
    assert retrieval.fuse([one, one]).first().score == pytest.approx(2 / 61)


def test_keyword_match(spark):
    a = F.array(*[F.lit(str(i)) for i in range(7)])
    hits = [spark.range(1).select(V.keywords_match(a, F.array(*[F.lit(str(i)) for i in range(n)]))).first()[0] for n in (3, 4)]
    assert hits == [False, True]


def test_html_paragraphs():
    page = '<html><head><title>T</title></head><body><script>var t="</p>";</script><h1>A &amp; B</h1><p>x<br>y</p><p> </p><!-- p --><p>z'
    assert html.paragraphs_of(page) == [("h1", "A & B", "A & B"), ("p", "A & B", "x y"), ("p", "A & B", "z")]
    assert html.paragraphs_of(None) == []


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    store.rebuild(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, vol int"), path, ["vol"])
    store.replace_partitions(spark.createDataFrame([(3, "c", 2)], "id int, x string, vol int"), path, ["vol"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]
    assert [r.id for r in store.read_volumes(spark, path, 1).collect()] == [1]


def test_streaming_supersession_equals_batch(spark, tmp_path):
    from tessera.streaming import twins

    rows = [(s, "P", t, "AB"[(s * t) % 2]) for s in range(4) for t in range(1, 6)]
    path = str(tmp_path / "claims")
    df = spark.createDataFrame(rows, "subject long, predicate string, vol int, value string")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = {tuple(r) for r in twins.run_to_end(twins.superseded(stream)).collect()}
    batch = intervals.single_valued_intervals(df.withColumn("claim_id", F.col("vol")).withColumn("confidence", F.lit(0.5))).where("vol_end is not null")
    assert got == {tuple(r) for r in batch.select("subject", "predicate", "value", "vol_start", "vol_end").collect()}


def test_late_rows_rebuild_their_partition_only(spark, tmp_path):
    import os

    from tessera.streaming import twins

    schema = "id int, x string, version int, vol int"
    inbox, path, cursor = (str(tmp_path / n) for n in ("inbox", "table", "cursor"))

    def step(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        twins.upserts(spark.readStream.schema(schema).parquet(inbox), path, cursor, "vol", ["id"], "version").start().awaitTermination()
        return sorted((r.id, r.x, r.vol) for r in spark.read.schema(schema).parquet(path).collect())

    assert step([(1, "a", 1, 1), (2, "b", 1, 2), (3, None, 1, 2)]) == [(1, "a", 1), (2, "b", 2), (3, None, 2)]
    before = {f: os.path.getmtime(f"{path}/vol=1/{f}") for f in os.listdir(f"{path}/vol=1")}
    assert step([(3, "c", 2, 2), (4, "d", 1, 2)]) == [(1, "a", 1), (2, "b", 2), (3, "c", 2), (4, "d", 2)]
    assert {f: os.path.getmtime(f"{path}/vol=1/{f}") for f in os.listdir(f"{path}/vol=1")} == before
    assert step([(3, "old", 1, 2)]) == [(1, "a", 1), (2, "b", 2), (3, "c", 2), (4, "d", 2)]


def test_epub_chapters(spark, tmp_path):
    from tessera.sources import epub

    plate, prose = "<img src='a'/><p>A plate.</p>", "<p>Eleven words of prose, or a few more, so no plate.</p>"
    parts = ["<p>Before all.</p>", "<h1>One</h1><p>a</p>", "<p>b</p>", plate, plate + prose, "<h2>Two</h2>" + plate, "", "<h1>Three &amp; last</h1>"]
    book = epub.container("A & B", parts)
    (tmp_path / "a.epub").write_bytes(book)
    (tmp_path / "a.txt").write_text("no book")
    got = [(r.title, r.chapter_idx, r.chapter_title, r.seq, r.text) for r in epub.chapters(epub.read_epubs(spark, str(tmp_path))).orderBy("chapter_idx", "seq").collect()]
    texts = [(0, None, 0, "Before all."), (1, "One", 0, "a"), (1, "One", 1, "b"), (1, "One", 2, "A plate."), (1, "One", 3, "Eleven words of prose, or a few more, so no plate."), (2, "Two", 0, "A plate."), (3, "Three & last", 0, None)]
    assert got == [("A & B", *t) for t in texts]
    assert epub.chapters(spark.createDataFrame([("x", None)], "path string, content binary")).count() == 0
    with pytest.raises(Exception, match="no readable EPUB"):
        epub.chapters(spark.createDataFrame([("x", bytearray(b"zip"))], "path string, content binary")).collect()


def test_mentions_do_not_depend_on_the_number_of_forms(spark, monkeypatch):
    forms = [("Lord High Keeper of the Seal", 1), ("Lord", 2), ("Keeper of", 3), ("St. Ann's, East", 4), ("East", 5), ("Seal", 6), ("Seal", 9), ("Ann", 7)]
    texts = ["The Lord High Keeper of the Seal met Lord East.", "At St. Ann's, East Seal; Keeper of Lords. Ann", "", None, "Seal", "East-Seal (Lord)"]
    f = spark.createDataFrame(forms, "text string, entity int")
    rows = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "para_id string, text string")
    few = sorted(M.find_mentions(rows, f).collect())
    monkeypatch.setattr(M, "MOST_FORMS", 2)
    assert sorted(M.find_mentions(rows, f).collect()) == few and ("p0", 1, "Lord High Keeper of the Seal", 4, 32) in [tuple(r) for r in few]


def test_long_conflict_chains_are_one_clique(spark):
    names = [f"P{i}" for i in (7, 2, 9, 4, 1, 8, 3, 6, 5)]
    rows = [(n, True, None, [x for x in (names[i - 1] if i else None, names[i + 1] if i + 1 < len(names) else None) if x], False, None, None) for i, n in enumerate(names)]
    p = relations.catalog(spark, rows)
    present = spark.createDataFrame([(1, n) for n in names] + [(2, n) for n in names if n != "P1"] + [(1, "Q")], "k int, predicate string")
    got = {(r.k, r.predicate): r.clique for r in relations.cliques(present, relations.conflict_groups(p), ["k"]).collect()}
    assert {got[1, n] for n in names} == {"P1"} and got[1, "Q"] == "Q"
    assert {got[2, n] for n in ("P7", "P2", "P9", "P4")} == {"P2"} and {got[2, n] for n in ("P8", "P3", "P6", "P5")} == {"P3"}


def test_fold_of_many_equal_rows_compares_sets(spark):
    from tessera.operators import spans

    forms = [["a"], ["a", "b"], ["c"], ["a", "b", "b", "c"], [], None, ["d", None], ["d", None, "e"], [None]]
    rows = [(k, 100 * i + k, m) for k in (1, 2) for i, m in enumerate(forms * 4) if k == 1 or m != ["a", "b", "b", "c"]]
    sets = {(k, i): None if m is None else set(m) for k, i, m in rows}
    host = {}
    for (k, i), m in sets.items():
        over = [(len(n), j) for (q, j), n in sets.items() if q == k and m is not None and n is not None and m < n]
        if over:
            host[k, i] = (k, max(over)[1])
    want = {p: list(host.values()).count(p) for p in sets if p not in host}
    got = spans.fold_contained(spark.createDataFrame(rows, "k int, item long, m array<string>"), ["k"], "item", "m")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.k, r.item): r.folded for r in got.collect()} == want
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "array_except" in line.lower()]
    assert joins and all("w#" in line for line in joins)  # rows of a key no longer meet all the others


def test_disclosure_counts_repeated_lines(spark, tmp_path):
    from tessera.plans.registry import QUERIES
    import __spark_entry__  # noqa: F401

    spark.createDataFrame([(1, "alpha beta gamma delta omega")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "alpha\nbeta\ngamma"), (2, "alpha\nother\nalpha\nalpha"), (3, "alpha beta"), (4, "gamma beta alpha"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["probe_disclosure_class"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [2, 4]
