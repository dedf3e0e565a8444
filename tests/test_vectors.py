"""Vector search, threshold joins, seeding and hybrid search against all pairs."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marlstone.operators import search, vectors
from marlstone.plans import search as plans_search

VEC = "vec_id long, embedding array<float>"


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_top_k_against_all_pairs(spark, block_rows):
    r = np.random.default_rng(1)
    m = r.integers(-2, 3, (60, 4)).astype(np.float64)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], VEC)
    got = vectors.top_k(rows.where("vec_id % 7 = 0"), rows, 5, block_rows).collect()
    s = np.round(unit(m) @ unit(m).T, 6) + 0.0
    want = {(q, int(i), p): s[q, i] for q in range(0, 60, 7) for p, i in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (-s[q, i], i))[:5], 1)}
    assert {(x.query_id, x.vec_id, x.place): x.score for x in got} == pytest.approx(want) and len(got) == len(want)
    assert vectors.top_k(rows.where("vec_id < 0"), rows, 5).count() == vectors.top_k(rows, rows.where("vec_id < 0"), 5).count() == 0


@pytest.mark.parametrize(("least", "pivots", "block_rows"), [(0.92, 8, 4), (0.92, 64, 1000), (0.5, 5, 7), (0.99, 1, 3)])
def test_matches_lose_no_pair(spark, least, pivots, block_rows):
    r = np.random.default_rng(int(least * 100))
    centers = r.normal(size=(12, 6))
    m = np.vstack([c + r.normal(size=(14, 6)) * s for c in centers for s in (0.05, 0.25)] + [np.tile(centers[0], (9, 1)), np.zeros((2, 6))]).astype(np.float32).astype(np.float64)
    rows = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(m)] + [(1, None), (0, m[0].tolist())], VEC)
    pairs, members, work = vectors.matches(rows, least, pivots, block_rows)
    first = {}
    for i, v in [*((k * 3, tuple(x)) for k, x in enumerate(m)), (0, tuple(m[0]))]:
        if any(v):
            first.setdefault(v, []).append(i)
    named = {min(ids): np.array(v) for v, ids in first.items()}
    ids = sorted(named)
    u = unit(np.array([named[i] for i in ids]))
    s = u @ u.T
    want = {(a, b): s[i, j] for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b and s[i, j] >= least}
    got = pairs.collect()
    assert len(want) > 20 and {(x.a, x.b): x.score for x in got} == pytest.approx(want) and len(got) == len(want)
    assert Counter((x["class"], x.vec_id) for x in members.collect()) == Counter((min(v), i) for v in first.values() for i in v)
    compared = work.agg({"compared": "sum"}).first()[0]
    assert len(want) <= compared <= len(ids) * (len(ids) - 1) // 2
    if least > 0.9 and pivots > 1:
        assert compared < len(ids) * (len(ids) - 1) // 2 / 2  # blocks that a bound rules out never meet


def test_matches_write_and_shuffle_no_pairs(spark, monkeypatch):
    """Only classes and their blocks are written, each vector once, and blocks meet without an exchange."""
    wrote = []
    plain = vectors.written
    monkeypatch.setattr(vectors, "written", lambda df, name: wrote.append(plain(df, name)) or wrote[-1])
    rows = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(300)], VEC)
    pairs, _, work = vectors.matches(rows, 0.9, 3, 16)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert pairs.count() == 300 * 299 // 2 == work.agg({"compared": "sum"}).first()[0]
    assert len(wrote) == 2 and all(df.count() <= 300 for df in wrote) and wrote[1].selectExpr("sum(length(ids)) / 8").first()[0] == 300


def test_matches_of_equal_and_no_vectors(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(60, [2.0, 0.0])], VEC)
    pairs, members, _ = vectors.matches(rows)
    assert [(x.a, x.b) for x in pairs.collect()] == [(0, 60)] and members.count() == 51
    assert [df.count() for df in vectors.matches(rows.limit(0))] == [0, 0, 0]


def test_a_cosine_of_exactly_the_threshold_matches(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0, 5.0]), (2, [5.0, 4.0, 3.0]), (3, [1.0, 0.0, 0.0])], VEC)  # 46 / 50, as a product of units 0.9199999999999999
    assert [(x.a, x.b) for x in vectors.matches(rows)[0].collect()] == [(1, 2)]


def test_classes_compare_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "matches", None)
    got = plans_search.signature_classes(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len({x.vec_id for x in got}) > 0 and all(x["class"] <= x.vec_id for x in got)
    rows = spark.createDataFrame([(5, [1.0]), (3, [1.0]), (4, [2.0]), (6, [0.0]), (7, None)], VEC)
    assert {(x["class"], x.vec_id) for x in vectors.equal_classes(rows).collect()} == {(3, 5), (3, 3), (4, 4)}


def test_distances_of_a_step_are_bounded(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"vec_id": list(range(10_000))})
    for centroids in (1, 1000, 100_000):
        parts = list(vectors._steps(batch, centroids))
        assert sum(p.num_rows for p in parts) == 10_000 and all(p.num_rows * centroids * 8 <= vectors.BLOCK_BYTES for p in parts)
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], VEC)
    whole = sorted(vectors.nearest(rows, np.array([[0.0, 1.0], [6.0, 1.0]])).collect())
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 48)
    assert sorted(vectors.nearest(rows, np.array([[0.0, 1.0], [6.0, 1.0]])).collect()) == whole and len(whole) == 50


def test_seeding_in_few_passes(spark, monkeypatch):
    r = np.random.default_rng(5)
    m = np.vstack([c + r.normal(size=(40, 8)) for c in r.normal(size=(25, 8)) * 6])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    passes = []
    plain = vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda *a, **k: passes.append(1) or plain(*a, **k))
    cost = lambda c: ((m[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
    seeds = vectors.seeds(rows, 25)
    assert len(passes) <= 5 and seeds.shape == (25, 8)
    one_a_pass = []
    for s in range(5):  # seeding one centroid a pass, as it was
        g = np.random.default_rng(s)
        c = m[:1]
        while len(c) < 25:
            d = ((m[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack((c, m[g.choice(len(m), p=d / d.sum())]))
        one_a_pass.append(cost(c))
    assert cost(seeds) <= 1.05 * np.median(one_a_pass)
    with pytest.raises(ValueError, match="smaller number"):
        monkeypatch.setattr(vectors, "CENTROID_BYTES", 1000)
        vectors.seeds(rows, 25)


def test_kmeans_rounds_and_edges(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(30)] + [(40, None)], VEC)
    found, centroids = vectors.kmeans(rows, 3)
    assert sorted(centroids[:, 0].tolist()) == [0.0, 1.0, 2.0] and found.count() == 30
    own, centroids = vectors.kmeans(rows.where("vec_id < 4"), 9)
    assert sorted((x.vec_id, x.cluster) for x in own.collect()) == [(i, i) for i in range(4)] and len(centroids) == 4
    assert vectors.kmeans(rows.limit(0))[0].count() == 0
    same, _ = vectors.kmeans(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)], VEC), 3)
    assert {x.cluster for x in same.collect()} == {0}  # ties go to the lowest


def test_means_and_lengths(spark):
    rows = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("a", 2, [5.0, 6.0]), ("b", 1, None)], "t string, c int, embedding array<float>")
    assert {(x.t, x.c): x.centroid for x in vectors.means(rows, ["t", "c"], most=1).collect()} == {("a", 1): [2.0, 3.0], ("a", 2): [5.0, 6.0]}
    assert vectors.checked(rows, 2).count() == 4
    with pytest.raises(Exception, match="another length"):
        vectors.checked(rows, 3).collect()


def plain_hybrid(queries, chunks, k, share):
    read = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t, _ in chunks}
    avg = sum(map(len, read.values())) / len(read)
    df = Counter(w for ws in read.values() for w in set(ws))
    idf = {w: math.log(1 + (len(read) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = []
    for q, text, e in queries:
        words = [w for w in dict.fromkeys(re.findall("[a-z0-9]+", (text or "").lower())) if w in idf]
        whole = sum(idf[w] * (search.K1 + 1) for w in words)
        scored = []
        for i, _, v in chunks:
            cos = 0.0
            if e is not None and v is not None:
                a, b = np.array(e), np.array(v)
                cos = max(0.0, round(float(a @ b / math.sqrt((a @ a) * (b @ b))), 6))
            n = Counter(read[i])
            key = sum(idf[w] * n[w] * (search.K1 + 1) / (n[w] + search.K1 * (1 - search.B + search.B * len(read[i]) / avg)) for w in words if n[w])
            score = round(share * cos + (1 - share) * (key / whole if whole else 0.0), 6)
            if score > 0:
                scored.append((-score, i))
        out += [(q, i, round(-s, 6), p) for p, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize(("seed", "share", "salted"), [(1, 0.5, 100_000), (2, 0.9, 3), (3, 0.0, 5), (4, 0.3, 100_000)])
def test_hybrid_against_all_pairs(spark, monkeypatch, seed, share, salted):
    monkeypatch.setattr(search, "POSTINGS", salted)
    r = np.random.default_rng(seed)
    vocab = ["the"] * 30 + [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(r.choice(vocab, n))
    chunks = [(i, text(int(r.integers(0, 30))) if i % 11 else None, r.normal(size=3).round(2).tolist() if i % 5 else None) for i in range(120)]
    queries = [(i, text(5), r.normal(size=3).tolist()) for i in range(12)] + [(50, "the the", [1.0, 0.0, 0.0]), (51, "unknown", [0.0, 1.0, 0.0]), (52, "w1 w2", None), (53, None, None)]
    schema = "id long, text string, embedding array<double>"
    q = spark.createDataFrame(queries, schema).withColumnRenamed("id", "query_id")
    c = spark.createDataFrame(chunks, schema).withColumnRenamed("id", "vec_id")
    got = sorted((x.query_id, x.vec_id, x.score, x.place) for x in search.hybrid(q, c, 4, share).collect())
    want = sorted(plain_hybrid(queries, chunks, 4, share))
    assert [(a[0], a[3]) for a in got] == [(b[0], b[3]) for b in want]
    assert [x[2] for x in sorted(got, key=lambda x: (x[0], x[3]))] == pytest.approx([x[2] for x in sorted(want, key=lambda x: (x[0], x[3]))], abs=2e-6)
    assert sum(a == b for a, b in zip(got, want)) >= len(want) - 2  # scores a rounding step apart may change places


def test_hybrid_keeps_no_pairs_of_a_query_and_a_chunk(spark, monkeypatch):
    """Only words and the best of each block are written or shuffled, whatever the number of pairs, and halves are rounded up."""
    names = []
    plain = search.written
    monkeypatch.setattr(search, "written", lambda df, name: names.append((name, df.columns)) or plain(df, name))
    monkeypatch.setattr(search, "CHUNKS", 7)
    monkeypatch.setattr(search, "QUERIES", 2)
    c = spark.createDataFrame([(i, "the word", [1.0, float(i)]) for i in range(40)], "vec_id long, text string, embedding array<double>")
    got = search.hybrid(c.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), c, 3).collect()
    assert len(got) == 15 and not any({"query_id", "vec_id"} <= set(columns) for _, columns in names)
    one = search.hybrid(c.where("vec_id = 1").selectExpr("vec_id AS query_id", "'unknown' AS text", "embedding"), c, 40).collect()
    assert {x.vec_id: x.score for x in one}[0] == 0.353554  # half of 0.707107


def test_hybrid_segments_meet_blocks_without_a_shuffle(spark, monkeypatch):
    """A row a segment and a block is written, and only each task's best are exchanged; a repeated id is read by its greatest text."""
    wrote = []
    plain = search.written
    monkeypatch.setattr(search, "written", lambda df, name: wrote.append(plain(df, name)) or wrote[-1])
    monkeypatch.setattr(search, "CHUNKS", 16)
    monkeypatch.setattr(search, "QUERIES", 4)
    c = spark.createDataFrame([(i, f"the word w{i % 5}", [1.0, float(i)] if i % 3 else None) for i in range(96)], "vec_id long, text string, embedding array<double>").repartition(2)
    q = c.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    found = search.hybrid(q, c, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CartesianProduct" in plan
    assert found.count() == 27 and sum(df.count() for df in wrote) <= 96 // 16 + 2 + 9 // 4 + 5
    texts = {i: f"the word w{i % 5}" for i in range(96)} | {3: "the word w9"}
    twice = c.union(spark.createDataFrame([(3, "the word w9", None)], c.schema))
    want = plain_hybrid([(r.query_id, r.text, r.embedding) for r in q.collect()], [(r.vec_id, texts[r.vec_id], r.embedding) for r in c.collect()], 3, 0.0)
    got = search.hybrid(q.where("query_id <> 3"), twice, 3, 0.0)
    assert sorted((r.query_id, r.vec_id, r.place) for r in got.collect()) == sorted((a, b, p) for a, b, _, p in want if a != 3)
