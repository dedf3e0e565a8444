import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.operators import chunking, graph


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize_text(spark):
    assert one(spark, C.normalize_text(F.lit("a \t\r\nb\r\r\r\rcafé"))) == "a\nb\n\ncafé"


def test_slug_and_card(spark):
    assert one(spark, C.slugify(F.lit("  Hello, World! "))) == "hello-world"
    assert one(spark, C.slugify(F.lit("!!"))) == "page"
    assert one(spark, C.summary_card(F.lit("x" * 201))) == "x" * 197 + "..."


def test_numbers(spark):
    assert one(spark, C.clamp01(F.lit(float("nan")))) == 0.0
    assert one(spark, C.safe_ratio(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, C.safe_ratio(F.lit(3), F.lit(2))) == 1.0
    assert [one(spark, C.bucketize(F.lit(n))) for n in (0, 10, 11, 10001)] == ["1-10", "1-10", "11-100", "10000+"]
    values = F.array(*[F.lit(float(i)) for i in range(6)])
    assert one(spark, C.empirical_quantile(values, 0.5)) == 2.0  # half-even


def test_cosine_of_zero(spark):
    zero, ones = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, C.cosine(zero, ones)) == 0.0
    assert abs(one(spark, C.cosine(ones, ones)) - 1) < 1e-12


def plain_chunks(text, size, overlap):
    """The observable rule, on strings: cut, gather, look each chunk up from the overlap on."""

    def cut(t, seps):
        if len(t) <= size:
            return [t] if t else []
        sep = next((s for s in seps if s == "" or s in t), "")
        if not sep:
            return [t[i : i + size] for i in range(0, len(t), size)]
        parts = t.split(sep)
        parts = [p + sep for p in parts[:-1]] + [parts[-1]] * bool(parts[-1])
        return [x for p in parts for x in cut(p, seps[seps.index(sep) + 1 :])]

    gathered, now = [], ""
    for p in cut(text, chunking.SEPARATORS):
        if now and len(now) + len(p) > size:
            gathered.append(now)
            now = now[-overlap:] if 0 < overlap < len(now) else ""
        now += p
    out, low = [], 0
    for c in gathered + [now] * bool(now):
        at = text.find(c, low)
        at = at if at >= 0 else text.find(c)
        out.append((c, at, at + len(c)))
        low = max(at + 1, at + len(c) - overlap)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_chunks_slice_back(seed):
    r = random.Random(seed)
    text = "A first paragraph.\n\n" + "word " * 90 + "\n" + "x" * 500
    text += "".join(r.choice(["ab ", "ab. ", "c\n", "\n\n", "dd", "ab ab ", "y" * 70]) for _ in range(300))
    for size, overlap in ((400, 40), (60, 20), (50, 0), (30, 29)):
        found = chunking.chunks_of(text, size, overlap)
        assert [(text[c.start : c.end], c.start, c.end) for c in found] == plain_chunks(text, size, overlap)
    assert chunking.chunks_of("") == []


def test_chunks_are_of_normalised_text(spark):
    docs = spark.createDataFrame([(1, "a \r\n\r\n\r\n\r\nb"), (2, " \n "), (3, None), (4, "")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in chunking.chunk(docs).collect()] == [(1, "a\n\nb")]


def test_chunks_hold_little_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 2000) for i in range(5)] + [(9, None)], "doc_id long, text string")
    whole = sorted(chunking.chunk(docs).collect())
    monkeypatch.setattr(chunking, "BATCH_CHARS", 2000)  # a batch for every second chunk
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(chunking.chunk(docs).collect()) == whole and len(whole) > 30
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and {got[i] for i in (100, 101, 102)} == {100}


def test_components_extended(spark):
    first = graph.components(spark.createDataFrame([(1, 2), (5, 6)], "a long, b long"))
    more = graph.extended(first, spark.createDataFrame([(2, 6), (8, 9)], "a long, b long"))
    assert {r.node: r.label for r in more.collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8}
