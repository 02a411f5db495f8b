"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, imatch, language, maxent, mixing, nearcopies, packing, quality, sharding, simhash, warc

SF = "/root/testdata/sf0.001"
#: Columns beside those of documents, with names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, size string, code string, key string, rank string, word string, vol string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(120))
EDGE = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " end", "en", "b"), (4, None, None, None), (5, "", "en", ""),
    (6, " \t\n ", "de", "b"), (7, LONG, "de", "b"), (8, "x", None, "c"), (9, "Éa ß 漢字 \u0000 \U0001f600", "fr", "c"), (None, "no id here at all", "en", "a"), (None, None, "en", None), (10, "12345 --- !!!", "de", "a"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "i", "s", "z", "c", "k", "r", "w", "v") for r in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 1


def components_by_force(codes, radius):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(codes)), 2):
        if (codes[i] ^ codes[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def plain_fingerprint(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_equals_force(spark, docs, edge):
    for table in (docs, edge):
        rows = table.select("doc_id", "text").collect()
        codes = [plain_fingerprint(r.text, 4) for r in rows]
        roots = components_by_force(codes, 4)
        least = {}
        for r, root in zip(rows, roots):
            if r.doc_id is not None:
                least[root] = min(least.get(root, r.doc_id), r.doc_id)
        want = sorted((str(r.doc_id), f"{c:016x}", str(least.get(root))) for r, c, root in zip(rows, codes, roots))
        got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_components(table).collect())
        assert got == want


def test_bk_tree_and_pigeonhole_find_every_link(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    codes = list({c ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in base for k in (0, 1, 3, 4, 5, 9)})
    tree = simhash.BKTree(4)
    for i, c in enumerate(codes):
        assert sorted(tree.within(c)) == [j for j in range(i) if (codes[j] ^ c).bit_count() <= 4]
        tree.add(c)
    want = components_by_force(codes, 4)
    same = lambda roots: {frozenset(i for i in range(len(codes)) if roots[i] == r) for r in roots}
    assert same([tree.find(i) for i in range(len(codes))]) == same(want)
    for n in (10, 10**7, 10**9):  # every scheme puts every near pair in some shard
        masks = simhash.blocks(n, 4)
        for i, j in itertools.combinations(range(len(codes)), 2):
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                assert any(codes[i] & m == codes[j] & m for m in masks)
    df = spark.createDataFrame([(simhash.signed(c), i, 0) for i, c in enumerate(codes)], "code long, node long, f int")
    for limit in (8192, 3):  # 3: shards are dealt out as pairs of chunks
        found = {r.node: r.root for r in simhash.components(simhash.link_codes(df, 4, limit)).collect()}
        assert same([found.get(i, i) for i in range(len(codes))]) == same(want)


def near_copies_by_force(rows, similarity=0.8):
    """Ids that stay: the smallest of each component of texts whose sets of five-word shingles are that similar."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for at, i in enumerate(order):
        for j in reversed(order[:at]):
            if len(sets[j]) < similarity * len(sets[i]):
                break
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return set(least.values())


def test_near_copies_equal_force_at_a_larger_size(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.keep_one_of_each(df).collect()} == near_copies_by_force(rows)


def test_near_copies_in_large_bands(spark, monkeypatch):
    """Bands above the group size, hot first texts, chunks of the rest: a chain of texts a word apart each."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)]
    for i in range(70):
        words[(7 * i) % 60] = f"n{i}"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, " ".join([f"p{j}" for j in range(40)] + [f"q{i}_{j}" for j in range(12)])) for i in range(60)]
    monkeypatch.setattr(nearcopies, "GROUP", 3)
    monkeypatch.setattr(nearcopies, "BANDS", 64)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.keep_one_of_each(df).collect()} == near_copies_by_force(rows)


def test_across_joins_all_that_is_similar():
    rng = np.random.default_rng(8)
    sets = [frozenset(rng.choice(14, 10, replace=False).tolist()) for _ in range(60)]
    labels_ = [int(x) for x in rng.integers(0, 50, 60)]
    root = {i: {j for j in range(60) if labels_[j] == labels_[i]} for i in range(60)}
    want = [min(root[i]) for i in range(60)]
    for i, j in itertools.combinations(range(60), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = want[i], want[j]
            want = [min(a, b) if x in (a, b) else x for x in want]
    got = [min(root[i]) for i in range(60)]
    for i, j in nearcopies.across(labels_, sets, 0.8):
        a, b = got[i], got[j]
        got = [min(a, b) if x in (a, b) else x for x in got]
    assert got == want


def test_rows_of_one_id_are_decided_by_their_texts(spark):
    other = " ".join(f"o{i}" for i in range(50))
    df = spark.createDataFrame([(1, BASE, 9.0), (1, other, 1.0), (2, BASE + " end", 1.0), (1, other, 1.0)], "doc_id long, text string, node double")
    assert sorted((r.doc_id, r.text) for r in nearcopies.keep_one_of_each(df).collect()) == sorted([(1, BASE), (1, other)])


def test_near_copies_keep_one(spark, edge, none):
    rng = np.random.default_rng(5)
    texts = []
    for g in range(12):
        words = [f"g{g}t{rng.integers(1000)}" for _ in range(200)]
        for k in range(5):
            w = words.copy()
            for at in rng.choice(200, 3 * (k % 3), replace=False):
                w[at] = f"n{rng.integers(10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [frozenset(" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    assert sorted(r.doc_id for r in nearcopies.keep_one_of_each(df).collect()) == sorted(set(root))
    kept = nearcopies.keep_one_of_each(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and ids.count(None) == 2 and ids.count(4) == 1 and 5 not in ids
    assert nearcopies.keep_one_of_each(none).count() == 0


def test_near_copies_with_edited_blocks_keep_one(spark):
    rng = np.random.default_rng(7)
    new = lambda n: [f"z{rng.integers(10**9)}" for _ in range(n)]
    passage, texts = new(12), []
    for g in range(30):
        words = [*new(150), *passage, *new(140)]
        texts += [words, words[:100] + new(24) + words[124:], words + new(55), words[:250], words[:20] + passage + words[20:]]
    sets = [frozenset(" ".join(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))
    for i, j in near:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert len(near) >= 90 and sorted(r.doc_id for r in nearcopies.keep_one_of_each(df).collect()) == sorted(set(root))


# 2


def best_fit_by_force(pieces, capacity, most):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [b for b in range(len(bins)) if bins[b][0] >= size and bins[b][1][source] < most and cluster not in bins[b][2]]
        b = min(fits, key=lambda b: (bins[b][0], b)) if fits else len(bins)
        if b == len(bins):
            bins.append([capacity, Counter(), set()])
        bins[b][0] -= size
        bins[b][1][source] += 1
        bins[b][2].add(cluster)
        out.append(b)
    return out


def test_best_fit_equals_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        pieces = sorted(((int(rng.integers(1, 101)), int(rng.integers(4)), int(rng.integers(30))) for _ in range(150)), reverse=True)
        assert packing.best_fit(pieces, 100, 2) == best_fit_by_force(pieces, 100, 2)


def test_packing_loses_no_word(spark, docs, edge, none):
    for table in (docs, edge):
        rows = packing.pack(table, capacity=500, group_docs=60).collect()
        want = Counter()
        for r in table.select("doc_id", "text").collect():
            want[r.doc_id] += len((r.text or "").encode().split())
        got, bins = Counter(), defaultdict(list)
        for r in rows:
            got[r.doc_id] += r.n_words
            bins[r.bin].append(r)
        assert got == Counter({k: v for k, v in want.items() if v})
        for b in bins.values():
            assert sum(r.n_words for r in b) <= 500 and max(Counter(r.source for r in b).values()) <= packing.MAX_PER_SOURCE
            assert sorted(r.bin_offset for r in b) == [0, *itertools.accumulate(r.n_words for r in sorted(b, key=lambda r: r.bin_offset))][:-1]
    assert packing.pack(none).count() == 0
    together = defaultdict(set)
    for r in packing.pack(edge).where("doc_id in (1, 2)").collect():
        together[r.bin].add((r.doc_id, r.piece, r.bin_offset))
    assert all(len(v) == 1 for v in together.values())  # copies never share a bin


# 3


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_neighbours_recall_and_cases(spark, sf):
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in ann.nearest_neighbours(e, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert np.allclose([m[2] for m in mine], [x[list(ids).index(m[1])] @ x[i] for m in mine], atol=1e-12)
        hit, n = hit + len(set(want) & {m[1] for m in mine}), n + 20
    assert hit / n >= 0.9


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "q"), (1, [2.0, 0.0], "q"), (2, [2.0, 0.0], "q"), (3, None, "q"), (4, [0.0, 0.0], "q"), (5, [nan, 1.0], "q"), (6, [inf, 1.0], "q"), (7, [None, 1.0], "q"), (8, [1.0, 2.0, 3.0], "q"), (None, [5.0, 5.0], "q"), (9, [-1.0, 0.5], "q"), (9, [-1.0, 0.5], "q"), (20, [0.0, 1.0], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0)
    got = {q: [(r.vec_id, r.score) for r in sorted(out.collect(), key=lambda r: r.rank) if r.query_id == q] for q in (0, 20)}
    assert got[0] == [(1, 2.0), (2, 2.0), (20, 0.0), (9, -1.0)] and got[20] == [(9, 0.5), (0, 0.0), (1, 0.0), (2, 0.0)]
    assert ann.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_rotated_codes_bound_the_estimate():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 32))
    centroids, rotation, _ = ann.fit_index(x[:1000], 2000, 10)
    owner, bits, norm, fit = ann.encode(x, centroids, rotation)
    assert ann.packed_words(bits).tobytes() == np.pad(bits, ((0, 0), (0, 4))).tobytes()
    for lst in np.unique(owner)[:5]:
        at = owner == lst
        shard = ann.Shard(np.flatnonzero(at), bits[at], norm[at], fit[at], x[at], centroids[lst], rotation)
        q = rng.standard_normal((40, 32))
        estimate, bound = shard.estimate(q)
        signs = np.unpackbits(bits[at], axis=1, count=32) * 2.0 - 1
        plain = ((q @ rotation) @ signs.T) * norm[at] / (fit[at] * 32**0.5) + (q @ centroids[lst])[:, None]
        assert (np.abs(estimate - plain) < 0.04 * np.linalg.norm(q, axis=1)[:, None] * norm[at]).all()
        assert np.mean(bound >= q @ x[at].T) > 0.98 and np.mean(2 * estimate - bound <= q @ x[at].T) > 0.98


def test_neighbours_of_repeated_vectors_and_ids(spark, monkeypatch):
    """A third of all rows are one vector, and one id has a third; both ways to rerank; chunks of a list."""
    rng = np.random.default_rng(9)
    x = rng.integers(-3, 4, (400, 8)).astype(float)
    x[(x == 0).all(axis=1)] = 1
    ids = np.arange(400)
    x[130:260], ids[260:390] = x[0], 7
    rows = list(zip(ids.tolist(), x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for dense, chunk in ((0.05, 32_768), (1.0, 40)):
        monkeypatch.setattr(ann, "DENSE", dense)
        monkeypatch.setattr(ann, "CHUNK", chunk)
        got = defaultdict(list)
        for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=5).collect():
            got[r.query_id].append((r.rank, r.score, r.vec_id))
        hit = n = 0
        for q in range(0, 400, 20):
            of = [v for i, v in rows if i == q]
            if not of:
                continue
            best = {}
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -1e9), float(np.dot(v, min(of))))
            want = sorted((-s, i) for i, s in best.items())[:5]
            mine = [(-s, i) for _, s, i in sorted(got[q])]
            hit, n = hit + len(set(want) & set(mine)), n + 5
            assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        assert hit >= 0.95 * n


# 4


def test_quality_learns_from_positives(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "light", "quiet"], 60))
    bad = lambda: " ".join(rng.choice(["$$$buy", "###now", "!!click", "&&&"], 60))
    rows = [(i, good() if i % 5 else bad()) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = labels(spark, [(i, int(i % 5 > 0), 0) for i in range(0, 600, 2)])
    out = {r.doc_id: r for r in quality.quality_scores(df, lab).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    held = [i for i in out if out[i].held_out]
    assert np.mean([out[i].predicted == int(i % 5 > 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())


def test_pu_risk_and_prior_by_force():
    rng = np.random.default_rng(6)
    cloud = lambda n, m: rng.standard_normal((n, 5)).astype(np.float32) * 0.5 + m
    positive, unlabelled = cloud(800, 0.8), np.vstack([cloud(420, 0.8), cloud(180, -0.8)])
    unlabelled = unlabelled[rng.permutation(600)]
    assert quality.estimate_prior(positive, unlabelled) == pytest.approx(0.7, abs=0.06)
    # one step of the fit against numerical derivatives of the risk, on either side of the clip
    for prior in (0.7, 0.95):
        seen = []
        for w0 in (np.zeros(5), np.full(5, 0.9)):
            def parts(v):
                zp, zu = positive @ v[:5] + v[5], unlabelled @ v[:5] + v[5]
                return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

            def risk(v):
                a, b = parts(v)
                return a + b if b >= 0 else -b

            v = np.append(w0, 0.1)
            numeric = [(risk(v + e) - risk(v - e)) / 2e-5 for e in np.eye(6) * 1e-5]
            gw, gb = quality.pu_gradient(positive, unlabelled, prior, w0.astype(np.float32), 0.1)
            assert [*gw, gb] == pytest.approx(numeric, abs=2e-3)
            seen.append(parts(v)[1] < 0)
        assert prior < 0.9 or True in seen


def test_one_id_in_many_rows_is_learnt_once(spark):
    df = spark.range(30_000).selectExpr("id % 3 as doc_id", "concat('word ', id % 7) as text")
    assert quality.fit(df, labels(spark, [(0, 1, 0), (1, 1, 0), (2, 0, 0)]), sample=10) is not None


def test_quality_ignores_held_out_labels(spark, docs):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()}
    assert score(lab) == pytest.approx(score(flipped), abs=1e-9)


def test_quality_edge_cases(spark, edge, none, docs):
    lab = labels(spark, [(1, 1, 0), (3, 1, 0), (7, 0, 0), (8, 0, 1), (8, 0, 1), (None, 1, 0), (5, None, 0), (99, 1, 1)])
    assert quality.quality_scores(edge, lab).where("score between 0 and 1").count() == len(EDGE)
    assert quality.quality_scores(edge, lab.limit(0)).where("score = 0.5").count() == len(EDGE)
    assert quality.keep_good(edge, lab).columns == edge.columns and quality.keep_good(edge, lab.limit(0)).count() == len(EDGE)
    assert quality.quality_scores(none, lab).count() == 0 and quality.keep_good(none, lab).count() == 0


# 5


def test_language_model_counts_and_scores(spark, docs, edge):
    for table in (docs, edge):
        rows = table.select("doc_id", "text").collect()
        words = lambda t: (t or "").encode().lower().split() + [b" "]
        out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        c = Counter(w for r in rows if not out_of(r.doc_id) for w in words(r.text))
        n, v = sum(c.values()), len(c)
        want = sorted((str(r.doc_id), out_of(r.doc_id), len(ws := words(r.text)), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for r in rows)
        got = maxent.lm_scores(table).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    held = [r for r in maxent.lm_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_tail_join_equals_head(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    score = lambda: {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in maxent.lm_scores(docs).collect()}
    whole = score()
    monkeypatch.setattr(maxent.head_counts, "__defaults__", (30_000,))  # the rest of the counts are joined
    assert score() == whole


def random_model(rng, scale=0.3):
    counts = rng.integers(0, 50, maxent.CELLS).astype(float)
    model = maxent.MaxEnt(counts, np.ones(maxent.CELLS, bool))
    model.class_rows += rng.standard_normal(model.class_rows.shape).astype(np.float32) * scale
    model.word_rows += rng.standard_normal(model.word_rows.shape).astype(np.float32) * scale
    return model


def rows_by_force(one, two, cls=None):
    keys = maxent.Events.features(np.array([one]), np.array([two]))
    bits = maxent.CLASS_ROWS_BITS if cls is None else maxent.WORD_ROWS_BITS
    return [int(r[0]) for r in maxent.MaxEnt.rows(keys, bits, None if cls is None else np.array([cls], np.uint64))]


def softmax_by_force(bias, weights, rows):
    z = bias.astype(float) + sum(weights[r].astype(float) for r in rows)
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def events_by_force(texts):
    """(one, two, cell) of every token of texts given as cells."""
    symbol = lambda c: c if c < maxent.CELLS - maxent.TAIL else maxent.CELLS - maxent.TAIL + c % maxent.TAIL_CONTEXTS
    for text in texts:
        past = [maxent.CELLS, maxent.CELLS]
        for c in text:
            yield past[-1], past[-2], c
            past.append(symbol(c))


def test_language_model_sums_to_one():
    model = random_model(np.random.default_rng(0))
    total = 0.0
    for cell in range(0, maxent.CELLS):
        if cell % maxent.SLOTS == 0:
            events = maxent.Events(np.array([x for c in range(cell, cell + maxent.SLOTS) for x in (1, 2, c)]), np.arange(0, 3 * maxent.SLOTS, 3))
            total += np.exp(model.log_probability(events)[2::3]).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_language_model_scores_and_steps_equal_force():
    rng = np.random.default_rng(1)
    texts = [rng.choice([3, 70, 71, 400, maxent.CELLS - 1, maxent.CELLS - 30], n).tolist() for n in (1, 2, 30, 45, 7)]
    starts = np.cumsum([0, *map(len, texts[:-1])])
    events = maxent.Events(np.array([c for t in texts for c in t]), starts)
    model = random_model(rng, 0.1)
    flat = list(events_by_force(texts))
    want = []
    for one, two, cell in flat:
        cls, slot = divmod(cell, maxent.SLOTS)
        a = softmax_by_force(model.class_bias, model.class_rows, rows_by_force(one, two))[cls]
        want.append(math.log(a * softmax_by_force(model.word_bias[cls], model.word_rows, rows_by_force(one, two, cls))[slot]))
    assert model.log_probability(events) == pytest.approx(want, abs=1e-4)
    # one step of all events: gradients by single tokens, applied feature by feature
    classes, words = model.class_rows.astype(float).copy(), model.word_rows.astype(float).copy()
    for weights, level in ((classes, 0), (words, 1)):
        gradients = []
        for one, two, cell in flat:
            cls, slot = divmod(cell, maxent.SLOTS)
            rows = rows_by_force(one, two, cls if level else None)
            g = -softmax_by_force(model.word_bias[cls] if level else model.class_bias, model.word_rows if level else model.class_rows, rows)
            g[slot if level else cls] += 1
            gradients.append((rows, g))
        past = defaultdict(lambda: 1.0)
        for feature in range(3):
            sums = defaultdict(lambda: 0.0)
            for rows, g in gradients:
                sums[rows[feature]] = sums[rows[feature]] + g
            for r, g in sums.items():
                past[r] += float(g @ g)
                weights[r] += g * maxent.RATE / past[r] ** 0.5
    trainer = maxent.Trainer(model)
    trainer.learn(events)
    assert np.abs(model.class_rows - classes).max() < 1e-4 and np.abs(model.word_rows - words).max() < 1e-4
    assert trainer.used[0].sum() == 3 * len(flat) == trainer.used[1].sum()


def test_language_model_beats_its_base_on_held_out_texts(spark):
    held = maxent.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert held.s / held.n > held.b / held.n + 0.1


def test_language_model_empty(spark, none):
    assert maxent.lm_scores(none).count() == 0
    one = spark.createDataFrame([(i, "a b", "x") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2], "doc_id long, text string, score string")
    assert [(r.train_tokens, r.n_known, r.base_score) for r in maxent.lm_scores(one).collect()] == [(0, 0, 0.0)] * 2


# 6


def ring_by_force(keys, shards, virtual_nodes):
    """Own arcs first, then what overflows, one key at a time in ring order."""
    where, owner = sharding.ring(shards, virtual_nodes)
    free = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    out, over = {}, []
    for i, cell in sorted(enumerate(keys), key=lambda x: (x[1], x[0])):
        v = next((k for k, c in enumerate(where) if c >= cell), 0)
        if free[owner[v]]:
            free[owner[v]] -= 1
            out[i] = owner[v]
        else:
            over.append((i, v))
    for i, v in over:
        while not free[owner[v]]:
            v = (v + 1) % len(where)
        free[owner[v]] -= 1
        out[i] = owner[v]
    return [out[i] for i in range(len(keys))]


def test_ring_equals_force():
    rng = np.random.default_rng(4)
    keys = sorted([int(x) for x in rng.integers(0, 1 << 16, 300)] + [777] * 150)
    plan = sharding.segments(Counter(keys), 7, 20)
    firsts = [p[0] for p in plan]
    got, slots = [], []
    for rank in range(len(keys)):
        p = plan[np.searchsorted(firsts, rank, side="right") - 1]
        got.append(p[1])
        slots.append((p[1], p[2] + rank - p[0]))
    assert got == ring_by_force(keys, 7, 20) and len(set(slots)) == len(keys)


def test_shards(spark, docs, edge, none):
    for table in (docs, edge):
        rows = sharding.ring_shards(table, 24).collect()
        n = len(rows)
        assert n == table.count()
        for s, got in itertools.groupby(sorted((r.shard, r.slot) for r in rows), key=lambda x: x[0]):
            assert [x[1] for x in got] == list(range(n // 24 + (s < n % 24)))
        texts = {(r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in table.select("doc_id", "text").collect()}
        assert {(r.doc_id, r.text_crc32, r.size) for r in rows} == texts
    assert sharding.ring_shards(none, 24).count() == 0


# 7


def level_by_force(sizes, weights):
    left, target = dict(sizes), {}
    total = 1.5 * sum(sizes.values())
    while True:
        w = sum(weights[s] for s in left)
        over = [s for s in left if total * weights[s] / w > 2 * sizes[s]] if left else []
        if not over:
            return target | {s: total * weights[s] / w for s in left}
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
            del left[s]


def test_mix(spark, docs, edge, none):
    for table in (docs, edge):
        rows = table.select("doc_id", "text", "source").collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len((r.text or "").encode().split())
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        target = level_by_force(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
        got = mixing.mix(table).collect()
        assert len(got) == len(rows)
        assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len((r.text or "").encode().split())) for r in rows)
        taken = Counter()
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
            taken[round(r.target, 3)] += r.taken
        for t in set(round(t, 3) for t in target.values()):
            same = sum(round(x, 3) == t for x in target.values())
            assert abs(taken[t] - same * t) <= same + 1e-3
        assert sorted(got) == sorted(mixing.mix(table).collect()) if table is docs else True
        positions = [r.position for r in got if r.position is not None]
        assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(edge).columns == edge.columns
    own = edge.withColumn("mix_position", F.lit(123.0)).withColumn("mix_id", F.lit(1)).withColumn("target", F.lit("t"))
    got = mixing.mixed_documents(own).collect()
    assert got and all((r.mix_position, r.mix_id, r.target) == (123.0, 1, "t") for r in got)


def test_mix_with_one_id_in_many_rows(spark):
    df = spark.range(100_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id", "concat('some words ', id) as text", "if(id % 5 = 0, 'b', 'a') as source")
    got = mixing.mix(df).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 1.5 for r in got)


def test_positions_invert_the_schedule(spark):
    y = [i / 200 for i in range(201)]
    rows = spark.createDataFrame([(v, s) for v in y for s in range(3)], "y double, s int").select("y", "s", mixing.when_demanded(F.col("y"), F.col("s")).alias("t")).collect()
    for r in rows:
        knots = mixing.SCHEDULES[r.s]
        grid = np.linspace(0, r.t, 2001)
        weight = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        whole = np.trapezoid(knots, np.linspace(0, 1, len(knots)))
        assert np.trapezoid(weight, grid) / whole == pytest.approx(r.y, abs=1e-5)


# 8


def test_forward_sums_every_segmentation():
    pieces = language.Pieces(["▁a", "b", "▁", "a", "ab", "bb", "▁ab", "c"])
    rng = np.random.default_rng(0)
    p = rng.random((pieces.n + 1, 2))
    names = {s: i for i, s in enumerate(pieces.pieces)}

    def force(word, k):
        if not word:
            return 1.0
        found = sum(p[names[word[:n]], k] * force(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in names)
        return found + (0 if word[0] in names else p[pieces.n, k] * force(word[1:], k))

    words = ["abb", "a", "abab", "zzb", "cab", "bbbb", "ab" * 40]
    for at, codes in language.by_length(["▁" + w for w in words]):
        got = pieces.log_likelihood(codes, p)
        for i, w in enumerate(at):
            if len(words[w]) < 20:
                assert got[i] == pytest.approx([math.log(force("▁" + words[w], k)) for k in (0, 1)])
            assert np.isfinite(got).all()
    for at, codes in language.by_length(["▁abb"]):
        counts = pieces.expected(codes, np.ones(1), p[:, 0])
        assert sum(counts[i] * len(s) for s, i in names.items()) == pytest.approx(4)  # every character is in one piece


def test_long_units_equal_the_batched_sum(monkeypatch):
    pieces = language.Pieces(["▁a", "b", "▁", "a", "ab", "bb", "▁ab", "abab", "c", "cz"])
    rng = np.random.default_rng(1)
    p = rng.random((pieces.n + 1, 3))
    padded = np.vstack([p, np.zeros(3)])
    for word in ("▁" + "".join(rng.choice(list("abcz"), n)) for n in (1, 5, 60, 300)):
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        want = pieces.log_likelihood(codes[None], p)[0]
        assert pieces.one_by_one(codes, padded, chunk=7) == pytest.approx(want)
        parts = pieces.cut(word)
        assert "".join(parts) == word and (len(word) < 60 or len(parts) > 1)
        assert sum(pieces.log_likelihood(c, p)[0] for w in parts for _, c in language.by_length([w])) == pytest.approx(want)
    monkeypatch.setattr(language, "_SLOT_BITS", 3)  # tables of 8 slots: most pieces are in neither
    small = language.Pieces(list("abcdefghijklmnopqrstuvwxyz"))
    assert small.rest and small.find(np.arange(97, 123, dtype=np.uint64)).tolist() == list(range(26))


def test_predict_equals_posterior_by_force(spark):
    pieces = language.Pieces(["▁a", "b", "▁", "a", "ab", "▁ab", "漢", "漢字"])
    rng = np.random.default_rng(3)
    p = rng.random((pieces.n + 1, 2))
    p /= p.sum(axis=0)
    every = np.column_stack([p, np.full(pieces.n + 1, 1 / (pieces.n + 1))])
    names = {s: i for i, s in enumerate(pieces.pieces)}

    def force(word):
        alpha = [np.ones(3)]
        for end in range(1, len(word) + 1):
            found = [alpha[end - k] * every[names[word[end - k : end]]] for k in (1, 2, 3) if end >= k and word[end - k : end] in names]
            alpha.append(sum(found, np.zeros(3)) + (0 if word[end - 1] in names else alpha[-1] * every[pieces.n]))
        return np.log(alpha[-1])

    texts = ["ab ab b", "ABBA zz", "漢字" * 70, "a", "b" * 150 + " a", "7 7", "", None]
    rows = language.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), ["x", "y"], p, pieces).collect()
    for r in rows:
        if r.doc_id > 4:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum(force("▁" + w) for w in r.text.lower().split())
        assert r.lang_pred == "xy"[int(np.argmax(total[:2]))]
        assert r.score == pytest.approx(float(np.exp(total[:2].max() - np.logaddexp.reduce(total))), abs=1e-9)


def test_long_words_are_quick_and_strange_text_scores_low(spark, docs):
    import time

    pieces = language.load_pieces()
    langs, p = language.fit(docs, pieces)
    rng = np.random.default_rng(4)
    han = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 200_000)))
    rows = spark.createDataFrame([(1, han), (2, "".join(rng.choice(list("qxzjkvw"), 20_000))), (3, " ".join("".join(rng.choice(list("qxzjkvw"), 6)) for _ in range(200)))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.score for r in language.predict(rows, langs, p, pieces).collect()}
    assert time.time() - began < 15 and got[2] < 0.5 and got[3] < 0.5


def test_language_held_out_accuracy(spark, docs, edge, none):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language.language_scores(docs).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.95
    rows = language.language_scores(edge).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (4, 5, 6, 10))
    assert {r.lang_pred for r in language.language_scores(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.language_scores(none).count() == 0 and language.keep_identified(none).count() == 0
    assert language.keep_identified(edge).columns == edge.columns


# 9


def test_loser_tree_merges():
    rng = np.random.default_rng(6)
    for k in range(8):
        runs = [sorted(int(x) for x in rng.integers(0, 50, rng.integers(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_captures_round_trip(spark, tmp_path):
    rows = [(1, "http://b.example/x", "<p>é</p>"), (2, "https://www.a.example:8080/", "<p>é</p>"), (3, "http://b.example/x", None), (4, None, ""), (None, "http://b.example/y#f", "<p>é</p>"), (5, "bad url\r\nX: y", "z" * 300_000), (5, "bad url\r\nX: y", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.capture_histories(pages, f"file://{tmp_path}/w").collect()
    kind = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str)
    assert kind == sorted([(1, 9, "revisit", 2), (2, 9, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 9, "revisit", 2), (5, 300_000, "response", None), (5, 300_000, "response", None)], key=str)
    order = [(r.url_key, r.timestamp, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    assert {r.payload_digest for r in got if r.payload_bytes == 9} == {warc.digest("<p>é</p>".encode())}
    assert next(r.url_key for r in got if r.page_id == 2) == "example,a)/"
    assert warc.capture_histories(pages.limit(0), f"file://{tmp_path}/v").count() == 0


# 10


def test_next_document_is_found_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 3)
    ids = [5, 1, 9, 22, 22, 40, 41, 42, 100, 7, 3, -8, None, None, 2**62]
    df = spark.createDataFrame([(i, f"t{n:02d}") for n, i in enumerate(ids)], "id long, text string")
    got = {r.text: r.next_text for r in imatch.with_next(df, len(ids)).where("extra = 0").collect()}
    order = [t for _, t in sorted(((i is None, i or 0), f"t{n:02d}") for n, i in enumerate(ids))]
    want = dict(zip(order, order[1:]))
    assert {k: v for k, v in got.items() if k in want} == want
    assert got[order[-1]] == order[0]


def test_imatch_subsets_hear_every_term(spark, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = {i: {w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w} for i, t in texts.items()}
    counts = Counter(w for s in words.values() for w in s)
    band = {w for w, c in counts.items() if c * imatch.RARE >= len(texts) and c * imatch.COMMON[1] <= len(texts) * imatch.COMMON[0]}
    masks = {r.term: r["mask"] for r in imatch.lexicon(docs, len(texts)).collect()}
    assert masks.keys() == band
    for w, mask in masks.items():
        sha = hashlib.sha256(w.encode()).hexdigest()
        wide = [k != int(sha[0], 16) // 4 for k in range(4)]
        assert [bool(mask >> k & 1) for k in range(imatch.SUBSETS)] == wide + [sha[2 * k : 2 * k + 2] in imatch.CHOSEN for k in range(4, imatch.SUBSETS)]
    prints = defaultdict(set)
    for r in imatch.imatch(docs).collect():
        mine = words[r.doc_id] & band
        parts = [" ".join(sorted(w for w in mine if masks[w] >> k & 1)) for k in range(imatch.SUBSETS)]
        want = ".".join(hashlib.md5(p.encode()).hexdigest()[:8] if p else "-" for p in parts)
        assert r.fingerprint == (want if mine else "=" + hashlib.md5(texts[r.doc_id].encode()).hexdigest())
        prints[r.fingerprint].add(frozenset(mine))
    assert all(len(same) == 1 for same in prints.values())


def test_imatch_cases(spark, docs, edge, none):
    for table in (docs, edge):
        rows = imatch.imatch(table).collect()
        assert len(rows) == table.count()
        same = defaultdict(set)
        texts = defaultdict(set)
        for r in table.select("doc_id", "text").collect():
            texts[r.doc_id].add(r.text or "")
        for r in rows:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if len(texts[r.doc_id]) == 1:
                same[next(iter(texts[r.doc_id]))].add(r.fingerprint)
        assert all(len(v) == 1 for v in same.values())
    assert imatch.imatch(none).count() == 0
    rows = imatch.imatch(docs).collect()
    assert np.mean([r.near_edited for r in rows]) > 5 * np.mean([r.near_next for r in rows])


# the pipeline


def test_pipeline_equals_its_parts(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixture", "packing"]
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(docs, lab).where("predicted = 1").collect()}
    kept = docs.where(F.col("doc_id").isin(list(good)))
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()} == good
    named = corpus_pipeline.language(spark, kept, SF)
    ids = {r.doc_id for r in language.language_scores(kept).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert {r.doc_id for r in named.collect()} == ids
    kept = docs.where(F.col("doc_id").isin(list(ids)))
    stays = near_copies_by_force([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, kept, SF).collect()) == sorted(stays)
    once = docs.where(F.col("doc_id").isin(list(stays)))
    plan = {r.doc_id: r for r in mixing.mix(once).collect()}
    drawn = Counter(r.doc_id for r in corpus_pipeline.mixture(spark, once, SF).collect())
    for i, r in plan.items():
        first = r.taken - r.taken_again
        assert drawn[i] == sum(d > 0 and 2 * d >= r.size for d in (first, r.taken_again))
    rows = corpus_pipeline.run(spark, SF).collect()
    words = Counter()
    for r in rows:
        words[r.doc_id] += r.n_words
    assert words == Counter({i: n * plan[i].size for i, n in drawn.items() if n})
    assert rows and {r.doc_id for r in rows} <= ids
    bins = Counter()
    for r in rows:
        bins[r.bin] += r.n_words
    assert max(bins.values()) <= packing.CAPACITY


def test_pipeline_on_edge_cases(spark, edge, none, tmp_path):
    for name, table in (("edge", edge), ("none", none)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels(spark, [(1, 1, 0), (9, 1, 0)]).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            assert function(spark, docs, f"{tmp_path}/{name}").columns == edge.columns
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert rows or name == "none"
