"""Operators whose queries have no SQL against plain versions of their rules."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import language, pack, pii, quality_rules, shard
from marlstone.llm.tables import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: doc_id, text and columns whose names clash with those that operators make
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, kept boolean, _words string, _row string, label string, _text string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 0.5, None, "w", "r", "l", "t") for i, t, s in rows], SCHEMA)


def plain_phrases(text, edges):
    n, s = 1, 0
    for c in text:
        if c not in edges[s]:
            n, s = n + 1, 0
        s = edges[s].get(c, 0)
    return n


@pytest.mark.parametrize("seed", range(4))
def test_language_phrases_of_long_texts(seed, monkeypatch):
    """Whole parses of texts of 10,000 characters, sample text, noise and long periods, against one parse of each."""
    monkeypatch.setattr(language, "SEGMENT", [256, 7, 1, 64][seed])
    r = random.Random(seed)
    sample = "".join(r.choices("abcde", weights=[5, 4, 3, 2, 1], k=4000)) + "ab" * 900 + "c" * 500
    edges = language.suffix_automaton(list(sample))
    texts = ["ab" * 3000, "c" * 5000, sample[100:1700], sample, "z" * 700, "abz" * 900, "a"]
    texts += ["".join(sample[k : k + r.randint(1, 400)] for k in (r.randrange(6000) for _ in range(60)))[:10_000] for _ in range(8)]
    texts += ["".join(r.choices("abcdez", k=r.randint(1, 3000))) for _ in range(8)]
    need, has = language.Parser({"x": sample}).needs([t.encode() for t in texts])
    got = [round(n * len(t)) for n, t in zip(need[:, 0], texts)]
    assert has.all() and got == [plain_phrases(t, edges) for t in texts]
    assert got[2] == 1 and got[3] == 1  # a text that stands whole in the sample is one phrase


def exact_beliefs(field, unary, seen, chain, skip):
    n = len(unary)
    total = np.zeros((n, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=n):
        if all(s == 0 or s == v for s, v in zip(seen, y)):
            w = sum(unary[i, v] for i, v in enumerate(y) if not seen[i]) + sum(field.chain[y[i], y[j]] for i, j in chain) + sum(field.skip[y[i], y[j]] for i, j in skip)
            for i, v in enumerate(y):
                total[i, v] += math.exp(w)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(6))
def test_pii_beliefs_against_enumeration(seed):
    """Exact on trees; close on small loops."""
    r = np.random.default_rng(seed)
    field = pii.Field()
    a, b = r.normal(0, 0.4, (2, pii.LABELS, pii.LABELS))
    field.chain, field.skip = a + a.T, b + b.T
    n = 6
    unary = r.normal(0, 1, (n, pii.LABELS))
    seen = np.zeros(n, dtype=np.int64)
    seen[r.integers(n)] = r.integers(1, pii.LABELS)
    edges = [(int(r.integers(k)), k) for k in range(1, n)]  # a tree
    chain = np.array([e for e in edges if e[1] % 2], dtype=np.int64).reshape(-1, 2)
    skip = np.array([e for e in edges if not e[1] % 2], dtype=np.int64).reshape(-1, 2)
    assert np.abs(field.beliefs(unary, seen, chain, skip) - exact_beliefs(field, unary, seen, chain, skip)).max() < 1e-3
    loop = np.concatenate((skip, [[0, n - 1]])) if (0, n - 1) not in edges else skip
    assert np.abs(field.beliefs(unary, seen, chain, loop) - exact_beliefs(field, unary, seen, chain, loop)).max() < 0.1


def test_pii_tokens_of_swinging_messages_become_no_span(monkeypatch):
    monkeypatch.setattr(pii, "SETTLED", 0.0)  # nothing counts as settled
    field = pii.Field()
    field.chain = np.eye(pii.LABELS) * 3
    unary = np.zeros((4, pii.LABELS))
    unary[0, 3] = 9.0
    none = np.zeros((0, 2), np.int64)
    p = field.beliefs(unary, np.zeros(4, np.int64), np.array([(0, 1), (1, 2), (2, 3)]), none)
    assert (p.argmax(axis=1)[1:] == 0).all()


def xxhash(spark, values):
    """64-bit hashes as the session makes them."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", F.xxhash64("v").alias("h")).collect()
    return [r.h for r in sorted(rows, key=lambda r: r.k)]


def test_quality_rules_counts_and_ratios(spark):
    r = random.Random(9)
    good, bad = [f"good{k}" for k in range(30)], [f"bad{k}" for k in range(30)]
    texts = [" ".join(r.choices(good if k % 2 else bad, k=r.randint(1, 60))) for k in range(40)] + [None, "", " \n", "é#$ |x\n|x\n |x ", "a b c d e f g h " * 9, "a\n\nA\na\n" * 20]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(3, texts[5], "s"), (3, texts[5], "s"), (None, texts[7], "s")]
    trusted = spark.createDataFrame([(k,) for k in range(1, 40, 2)], "doc_id long")
    got = quality_rules.score(docs_of(spark, rows), trusted).select("_row.doc_id", "_row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score").collect()
    words = {t: WORDS.findall(t or "") for _, t, _ in rows}
    grams = {t: [*w, *[f"{a}\0{b}" for a, b in zip((x[-3:] for x in w), (x[-3:] for x in w[1:]))]] for t, w in words.items()}
    flat = sorted({x for w in words.values() for x in w})
    of = dict(zip(flat, xxhash(spark, flat)))
    ends = sorted({x[-3:] for x in flat})
    end_of = dict(zip(ends, xxhash(spark, ends)))
    pairs = sorted({(end_of[a[-3:]], end_of[b[-3:]]) for w in words.values() for a, b in zip(w, w[1:])})
    pair_rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a long, b long").select("k", F.xxhash64("a", "b").alias("h")).collect()
    pair_of = {pairs[x.k]: x.h for x in pair_rows}
    bucket = {t: [of[x] % quality_rules.BUCKETS for x in w] + [pair_of[end_of[a[-3:]], end_of[b[-3:]]] % quality_rules.BUCKETS for a, b in zip(w, w[1:])] for t, w in words.items()}
    assert all(len(bucket[t]) == len(grams[t]) for t in bucket)
    raw, target = Counter(), Counter()
    for i, t, _ in rows:
        raw.update(bucket[t])
        if i is not None and i % 2 and i < 40:
            target.update(bucket[t])
    n_raw, n_target = sum(raw.values()) + quality_rules.BUCKETS, sum(target.values()) + quality_rules.BUCKETS
    ratio = {b: round(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw), 6) for b in raw}
    assert len(got) == len(rows)
    for x in got:
        w, t = words[x.text], x.text or ""
        lines = [line for line in t.split("\n") if WORDS.search(line)]
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        again = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        score = sum(ratio[b] for b in bucket[x.text]) / len(bucket[x.text]) if bucket[x.text] else 0.0
        assert [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed] == [
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed,
        ]
        assert abs(x.score - score) < 1e-6 and (abs(score - quality_rules.THRESHOLD) < 1e-5 or x.kept == (not failed and score >= quality_rules.THRESHOLD))


def test_shard_sizes_sums_and_slots(spark):
    rows = [(k, None if k % 9 == 0 else "é" * (k % 7), "s") for k in range(60)] + [(5, "twice", "s")] * 3 + [(None, "x", None)]
    got = shard.assign(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    text = defaultdict(Counter)
    for i, t, _ in rows:
        text[i][(len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))] += 1
    have = defaultdict(Counter)
    slots = defaultdict(list)
    for x in got:
        have[x.doc_id][x.size, x.text_crc32] += 1
        slots[x.shard].append(x.slot)
    assert have == text and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert {x.law for x in got} == {"key"} and all(x.grown_shard in (x.shard, 8) for x in got)


def plain_best_fit(sizes, sources, clusters, capacity):
    """The tightest bin that has room and neither the source nor the cluster, by looking at all of them."""
    pieces = sorted(((min(capacity, n - at), d, at) for d, n in enumerate(sizes) for at in range(0, max(n, 1), capacity)), key=lambda p: (-p[0], p[1], p[2]))
    bins, out = [], []
    for size, d, at in pieces:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and (b["left"] > 0 or size == 0) and not b["shut"] and sources[d] not in b["sources"] and clusters[d] not in b["clusters"]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set(), "shut": False})
        bins[b]["left"] -= size
        bins[b]["shut"] = bins[b]["left"] == 0 and size > 0
        bins[b]["sources"].add(sources[d])
        bins[b]["clusters"].add(clusters[d])
        out.append((d, at, size, b))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_against_all_bins(seed):
    r = random.Random(seed)
    n = r.randint(0, 60)
    sizes = [r.choice([0, 1, 5, 10, 30, r.randint(0, 35)]) for _ in range(n)]
    sources, clusters = [r.randrange(6) for _ in range(n)], [r.randrange(20) for _ in range(n)]
    assert pack.best_fit(sizes, sources, clusters, 10) == plain_best_fit(sizes, sources, clusters, 10)


def test_packing_holds_its_rules(spark):
    r = random.Random(2)
    rows = [(k, r.choice([None, "", "same words here", " ".join(["w"] * r.randint(1, 70))]), r.choice(["a", "b", None])) for k in range(300)] + [(7, "same words here", "a")] * 40
    got = pack.pack(docs_of(spark, rows), capacity=20, group_rows=64).collect()
    room, sources, clusters = Counter(), defaultdict(list), defaultdict(set)
    for x in got:
        room[x.bin_id] += x.n_words
        sources[x.bin_id].append(x.source)
        clusters[x.bin_id].add(x.cluster)
        assert x.start == x.piece * 20
    assert max(room.values()) <= 20 and all(len(v) == len(set(v)) for v in sources.values()) and all(len(clusters[b]) == len(sources[b]) for b in sources)
    assert sum(x.n_words for x in got) == sum(len(WORDS.findall(t or "")) for _, t, _ in rows)
    assert Counter(x.doc_id for x in got if x.piece == 0) == Counter(i for i, _, _ in rows)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, repeated and clashing input through every stage; all but the last return the columns of the documents."""
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa"]) + str(r.randrange(40)) for _ in range(n))
    long, test = prose(60), prose(30)
    rows = [(1, long, "s"), (2, long, "s"), (2, long, "s"), (2, prose(50), "t"), (3, None, None), (4, "", "s"), (None, prose(40), "s"), (5, f"{prose(5)} {test} {prose(5)}", "s")]
    rows += [(6, f"{prose(40)} me@mail.org {prose(9)}", "u"), (7, prose(4000), "u")]
    docs = docs_of(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, test), (2, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for source in (docs, docs.limit(0)):
            out = stage(spark, source, str(tmp_path))
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            kept[name] = Counter((x.doc_id if "doc_id" in out.columns else None) for x in out.collect()) if source is docs else kept[name]
            assert source is docs or out.count() == 0
    assert kept["quality_rules"] == Counter([1, 2, 2, 2, None, 5, 6, 7])
    assert kept["jaccard_join"] == Counter([1, 3, 4, None, 5, 6, 7])
    assert kept["decontamination"] == Counter([1, 2, 2, 2, 3, 4, None, 6, 7])
    assert kept["pii"] == Counter(i for i, _, _ in rows)
    assert set(kept["packing"]) == {i for i, _, _ in rows}
    text = {x.doc_id: x.text for x in corpus_pipeline.private_data(spark, docs, "").collect()}
    assert "[EMAIL]" in text[6] and "me@mail.org" not in text[6] and text[3] is None


def test_pipeline_applies_its_stages_in_turn(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda x: (x.doc_id, x.piece, x.n_words, x.bin_id, x.bin_offset)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, docs.collect()))


def test_decontamination_keeps_columns_of_any_name(spark):
    from marlstone.llm import decontaminate

    docs = spark.createDataFrame([(1, "a b c d", 5, 6, "h", "i", "t")], "doc_id long, text string, _n long, _n_hit long, _hit string, _items string, _text string")
    bench = spark.createDataFrame([(1, "b c"), (2, "q")], "item_id long, text string")
    keep = ["doc_id", "_n", "_n_hit", "_hit", "_items", "_text"]
    for part_bytes in (1 << 20, 1):  # in one part and in several
        got = decontaminate.score(docs, bench, keep, part_bytes).first()
        assert tuple(got[:6]) == (1, 5, 6, "h", "i", "t") and (got.n_words, got.n_hit, got["items"]) == (4, 2, ["1"])


def test_pii_numbers_without_a_witness_need_the_threshold():
    """Numbers that look like cards but fail the check digit stay, twins of a card go."""
    r = random.Random(5)
    cards = []
    while len(cards) < 200:
        n = "4" + "".join(r.choices("0123456789", k=15))
        if pii.luhn(n):
            cards.append(n)
    texts = [f"paid by {c} on day {k % 28}" for k, c in enumerate(cards)] + [f"order {c[:-1]}{(int(c[-1]) + 1) % 10} sent" for c in cards[:60]]
    r.shuffle(texts)
    field = pii.learn([t for k, t in enumerate(texts) if k % 4])
    field.least = pii.least_sure(field, texts[::4])
    wrong = [c[:-1] + str((int(c[-1]) + 3) % 10) for c in cards[100:]]
    assert sum(bool(field.more_spans(t, [])) for t in (f"order {w} sent" for w in wrong)) == 0
    twins = [(c, f"paid by {c} on day 1, again {w} today") for c, w in zip(cards[100:], wrong)]
    assert all([(s[1], t[s[0] : s[2]]) for s in field.more_spans(t, pii.base_spans(t))] == [(2, c[:-1] + str((int(c[-1]) + 3) % 10))] for c, t in twins)


@pytest.mark.parametrize("rows", [200_000, 0])
def test_pairs_are_judged_in_fans(spark, monkeypatch, rows):
    """One middle with many members in several fans, ids with several texts, and pairs of none, against sets."""
    from marlstone.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "FAN", 7)
    monkeypatch.setattr(jaccard_join, "FAN_ROWS", rows)
    r = random.Random(6)
    base = [f"w{k}" for k in range(40)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 9])):
            w[r.randrange(40)] = f"x{r.randrange(99)}"
        texts[i] = [" ".join(w)]
    texts[7].append("other words of the same id entirely")
    texts[59] = ["", "a b"]
    docs = spark.createDataFrame([(i, t) for i, ts in texts.items() for t in ts], "doc_id long, text string")
    pairs = sorted({(min(a, b), max(a, b)) for a, b in [(0, k) for k in range(1, 60)] + [(r.randrange(60), r.randrange(60)) for _ in range(120)] if a != b})
    sets = {i: [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t else set() for t in ts] for i, ts in texts.items()}
    alike = lambda x, y: len(x & y) > 0 and 100 * len(x & y) >= 75 * len(x | y)
    got = jaccard_join._verified(docs, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((x.a, x.b, x.linked) for x in got) == [(a, b, any(alike(x, y) for x in sets[a] for y in sets[b])) for a, b in pairs]
    assert any(x.linked for x in got) and not all(x.linked for x in got)


def test_quality_rules_learn_from_all_trusted_documents(spark):
    docs = spark.range(20_300).selectExpr("id AS doc_id", "concat('w', id % 500) AS text")
    # where all documents are trusted, the target is the corpus
    assert set(quality_rules.log_ratios(docs, docs.select("doc_id"))) == {0.0}


def test_trusted_ids_meet_texts_in_the_same_way_at_every_size(spark):
    docs = spark.createDataFrame([(k, "a b c") for k in range(4)] + [(None, "d")], "doc_id long, text string")
    met = quality_rules._marked(docs, docs.where("doc_id < 2 OR doc_id IS NULL").union(docs).where("doc_id < 2 OR doc_id IS NULL").select("doc_id"))
    assert sorted((r.doc_id, r._good) for r in met.where("doc_id IS NOT NULL").collect()) == [(0, 1), (1, 1), (2, None), (3, None)]
    assert [r._good for r in met.where("doc_id IS NULL").collect()] == [None]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
