"""Edge cases of every operator, and brute-force versions of them."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, jaccard_join, language, pack, pii, quality_model, quality_rules, shard, shared_shingles, substring_dedup, textops, toxicity
from marlstone.llm.textops import ALNUM_LOWER, Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, kept boolean, label string, shard int, key long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en" if i is not None and i % 2 else None, None, None, 7, 0.5, None, "x", 3, 9) for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(vocab, k=r.randint(1, 120))) for _ in range(40)]
    near = []
    for t in base[:20]:
        w = t.split()
        for _ in range(2):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    shared = " ".join(r.choices(vocab, k=30))
    odd = ["", " \n\t ", None, "one", "a b c d", "A b C d", base[0], base[0], "éè " * 30, "word " * 30000, shared + " tail one", "head two " + shared]
    return base + near + odd


def labels(spark, n):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(n)], "doc_id long, quality int, toxic int")


def test_jaccard_join(spark, texts):
    ids = list(range(len(texts)))[::-1]
    got = {r.doc_id: r for r in jaccard_join.join(frame(spark, texts, ids)).collect()}
    sets = {}
    for i, t in zip(ids, texts):
        w = WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (c := len(sets[a] & sets[b])) and 100 * c >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: (got[i].n_shingles, got[i].component_id) for i in ids} == {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_join_loose_group(spark, seed):
    """A group whose members are linked by chains only."""
    r = random.Random(seed)
    words = [f"b{i}" for i in range(60)]
    texts = []
    for k in range(60):
        texts.append(" ".join(words))
        words[r.randrange(60)] = f"n{k}"
    got = jaccard_join.join(frame(spark, texts)).collect()
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for t in texts]
    label = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == label


def test_near_duplicates_keep_columns_and_null_ids(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", "q", "q", "", ""], [3, 3, None, None, 1, 2])
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 2, 3]


def test_substring_dedup(spark, texts):
    ids = list(range(len(texts)))[::-1]
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, texts, ids)).collect()}
    words = {i: WORDS.findall(t or "") for i, t in zip(ids, texts)}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_quality_rules(spark, texts):
    got = {r["_row"].doc_id: r for r in quality_rules.score(frame(spark, texts), quality_rules.trusted_ids(labels(spark, len(texts)))).collect()}
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeat = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), len(repeat), len(lines) - len(set(lines)))
        assert got[i].base_failed == (len(w) < 20 or 100 * len(repeat) > 30 * len(w))
        assert not (got[i].base_failed and got[i].kept)


def test_quality_rules_without_trusted(spark, texts):
    got = quality_rules.score(frame(spark, texts), labels(spark, 0).select("doc_id")).collect()
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in got)


def test_decontaminate(spark):
    item = " ".join(f"t{i}" for i in range(20))
    bench = spark.createDataFrame([(10, item), (9, item.upper()), (7, "tiny item"), (8, "--"), (6, None), (10, item)], "item_id long, text string")
    docs = ["x " * 50 + item[:50], "a " * 5 + item + " b" * 5, "so: Tiny, ITEM!", "", None, "x " * 2000 + "tiny item"]
    for part in (decontaminate.PART_BYTES, 40):  # one part, and several
        got = {r.doc_id: r for r in decontaminate.score(frame(spark, docs), bench, ["doc_id"], part).collect()}
        assert [got[i].n_hit for i in range(6)] == [15, 20, 2, 0, 0, 2]
        assert got[1]["items"] == ["10", "9"] and got[2]["items"] == ["7"]
        assert [got[i].contaminated for i in range(1, 6)] == [True, True, False, False, False]
    kept = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert {3, 4, 5} <= {r.doc_id for r in kept.collect()} and kept.columns == frame(spark, docs).columns


def test_pii_base_spans_match_the_patterns():
    r = random.Random(3)
    pats = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(3000):
        t = "".join(r.choices(["a", "@", ".", "1", "23", "4", " ", "-", "+", "(", ")", "_", "é", "4111111111111111", "256", "b.c"], k=r.randint(0, 25)))
        want = []
        for k, p in enumerate(pats):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".") if k == 1), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]
                if ok:
                    want.append((m.start(), k, m.end()))
        assert pii.base_spans(t) == sorted(want), t
    assert pii.base_spans("9" * 50000 + ".") == [] and pii.base_spans("a" * 50000) == []


def test_pii_repeats_get_one_label(spark):
    card = "4111111111111111"
    texts = [f"pay {card} now. later {card[:-1]}2 again", "call +1 (555) 123-4567", None, "", "plain"] + [f"card {card} and mail a{i}@b.org ok" for i in range(20)]
    got = {r.doc_id: r for r in pii.find(frame(spark, texts)).collect()}
    assert (got[0].n_card, got[1].n_phone, got[2].spans, got[4].spans) == (1, 1, "", "")
    assert got[0].spans.count("card:") == 2  # the twin of an observed card
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, texts)).collect()}
    assert "4111" not in out[0] and out[2] is None and out[4] == "plain"


def test_shard_moves_only_to_the_new_one(spark):
    rows = shard.assign(frame(spark, ["t"] * 3000)).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert any(r.grown_shard == 8 for r in rows)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and 250 < len(slots) < 500
    odd = shard.assign(frame(spark, [None, "é", "é"], [None, 4, 4])).collect()
    assert sorted(r.size for r in odd) == [1, 3, 3]


@pytest.mark.parametrize("base", (1, 2, 3, 8))
def test_one_more_shard_takes_rows_only_into_itself(spark, base):
    key = F.col("id").cast("string")
    rows = spark.range(2000).select(*[shard.place(shard.tree(n, base=base), key).alias(f"n{n}") for n in range(base, 15)]).collect()
    for n in range(base, 14):
        assert all(r[f"n{n + 1}"] in (r[f"n{n}"], n) for r in rows) and any(r[f"n{n + 1}"] == n for r in rows)
    with pytest.raises(ValueError):
        shard.tree(base - 1, base=base)


def test_benchmark_set_of_many_items_is_built_in_line():
    r = random.Random(3)
    items = [(str(i), " ".join(f"w{r.randrange(5000)}" for _ in range(200)).encode()) for i in range(3000)]
    began = time.time()
    grams = decontaminate.GramSet(items)
    assert time.time() - began < 10 and sum(len(h) for h in grams.hashes.values()) == 3000 * 188
    words = Words([items[7][1]], ALNUM_LOWER)
    hit, found = decontaminate.probe(words, grams, grams.filters())
    assert hit.all() and "7" in found[0]


def test_long_text_in_runs_has_the_same_set(monkeypatch):
    r = random.Random(4)
    text = " ".join(f"w{r.randrange(300)}" for _ in range(4000)).encode() + b"  \n x"
    whole = jaccard_join.sets_of([text])[0]
    monkeypatch.setattr(jaccard_join, "SLICE_BYTES", 1000)
    monkeypatch.setattr(jaccard_join, "runs", lambda t, table, n: textops.runs(t, table, n, 1000))
    assert np.array_equal(whole, jaccard_join.sets_of([text])[0])


def test_shared_shingles_against_counts(spark, monkeypatch):
    """Own and shared shingles of every document, with a slice so small that common ones come from many slices."""
    monkeypatch.setattr(shared_shingles, "SLICE_ENTRIES", 200)
    r = random.Random(6)
    pool = [" ".join(r.choices("abcdefgh", k=12)) for _ in range(30)]
    texts = [" ".join(r.choices(pool, k=r.randint(1, 5))) for _ in range(120)] + ["", None, "one two"]
    got = {x.doc_id: x for x in shared_shingles.survey(frame(spark, texts), jaccard_join.sets_of).collect()}
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = Counter(g for s in sets for g in s)
    for i, s in enumerate(sets):
        assert (got[i].n, got[i].own) == (len(s), sum(n[g] == 1 for g in s))
        assert len(got[i]["keys"]) == max(0, min(len(s), len(s) - -(-3 * len(s) // 4) + 2) - got[i].own)


def test_pack(spark, texts):
    rows = pack.pack(frame(spark, texts), capacity=100, group_rows=50).collect()
    for i, t in enumerate(texts):
        assert sum(r.n_words for r in rows if r.doc_id == i) == len(WORDS.findall(t or ""))
    used = Counter()
    for r in rows:
        used[r.bin_id] += r.n_words
    assert max(used.values()) <= 100


def test_best_fit_takes_the_tightest_compatible_bin():
    #           sizes         sources      clusters
    found = pack.best_fit([60, 70, 30], [0, 1, 1], [0, 1, 2], 100)
    assert {d: b for d, _, _, b in found} == {1: 0, 0: 1, 2: 1}  # bin 0 is tighter but holds source 1


def test_models(spark, texts):
    bad = ["junk### $$$ zz&&& " * 5 + str(i) for i in range(40)]
    good = [t for t in texts[:40]]
    docs = frame(spark, good + bad + ["", None])
    lab = spark.createDataFrame([(i, int(i < 40), int(i >= 40)) for i in range(80)], "doc_id long, quality int, toxic int")
    q = {r.doc_id: r for r in quality_model.score(docs, lab).collect()}
    assert np.mean([q[i].predicted == int(i < 40) for i in range(80)]) > 0.9 and len(q) == 82
    assert all(0 <= r.score <= 1 for r in q.values())
    t = {r.doc_id: r for r in toxicity.score(docs, lab).collect()}
    assert np.mean([t[i].toxic == (i >= 40) for i in range(80)]) > 0.9
    none = toxicity.score(docs, lab.where("doc_id < 0")).collect()
    assert not any(r.toxic for r in none)


def test_language(spark):
    r = random.Random(1)
    words = {"aa": ["tik", "tok", "tak"], "bb": ["zum", "zim", "zam"]}
    rows = [(i, " ".join(r.choices(words["ab"[i % 2] * 2], k=40)), "ab"[i % 2] * 2) for i in range(60)] + [(60, None, "aa"), (61, "12 34", "bb"), (62, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(docs).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(60))
    assert [got[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3 and all(0 <= x.score <= 1 for x in got.values())


def test_automaton_holds_every_substring():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    edges = language.suffix_automaton(text)
    for i in range(len(text)):
        s = 0
        for c in text[i:]:
            s = edges[s][c]
    assert 3 not in edges[edges[0][3]]


def test_empty_tables(spark):
    docs, lab = frame(spark, []), labels(spark, 0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        jaccard_join.join(docs), substring_dedup.dedup(docs), quality_rules.score(docs, lab.select("doc_id")), decontaminate.score(docs, bench, ["doc_id"]),
        pii.find(docs), shard.assign(docs), pack.pack(docs), quality_model.score(docs, lab), toxicity.score(docs, lab), language.predict(docs),
    ):
        assert out.count() == 0


def test_language_of_letters_beyond_the_basic_table(spark):
    r = random.Random(2)
    words = {"aa": ["tik", "tok", "tak"], "ja": ["ひらがな", "カナ", "日本語"], "zh": ["中文字", "汉语", "今天"], "zz": ["𐐨𐐩𐐪", "𐐫𐐬", "𐐭𐐮𐐯"]}
    rows = [(i, "。".join(r.choices(words[k], k=40)), k) for i, k in enumerate(list(words) * 20)] + [(80, "。、「」", "ja"), (81, "😀😀", "zh"), (82, "𐐀𐐁𐐂", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in language.predict(docs).collect()}
    assert [got[i] for i in range(80)] == [k for _, _, k in rows[:80]]
    assert [got[i] for i in (80, 81, 82)] == ["und", "und", "zz"]  # punctuation, emoji, capitals of a script above U+FFFF


def test_language_parse_with_many_letters():
    r = random.Random(4)
    sample = "".join(chr(0x4E00 + int(3000 * r.random() ** 2)) for _ in range(20_000))
    parser = language.Parser({"han": sample})
    assert parser.automata[0].table.nbytes < 8 << 20
    edges = language.suffix_automaton([ord(c) for c in sample])
    texts = [sample[k : k + 9] + chr(0x4E00 + r.randrange(3200)) + sample[7 * k : 7 * k + 5] for k in range(200)]
    need, has = parser.needs([t.encode() for t in texts])
    assert has.all()
    for t, got in zip(texts, need[:, 0]):
        phrases, s = 1, 0
        for c in map(ord, t):
            if c not in edges[s]:
                phrases, s = phrases + 1, 0
            s = edges[s].get(c, 0)
        assert phrases == round(got * len(t))


@pytest.mark.parametrize("block_bytes", [language.BLOCK_BYTES, 20_000])
def test_language_keeps_every_language(spark, block_bytes):
    """70 languages, one of short texts and one of long texts among them, in one block of automata and in several."""
    r = random.Random(6)
    rows = []
    for k in range(70):
        words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)]
        n = {0: 3, 1: 1500}.get(k, 30)
        rows += [(len(rows) + i, " ".join(r.choices(words, k=n)), f"l{k:02}") for i in range(12 if k < 69 else 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in language.predict(docs, block_bytes=block_bytes).collect()}
    wrong = [(i, got[i], k) for i, _, k in rows if got[i] != k]
    assert not wrong


def test_language_sample_takes_one_text_a_doc_id(spark):
    docs = spark.createDataFrame([(7, "some words here " * 6, "aa")] * 50 + [(7, "tiny", "aa"), (5, "12 " * 3000 + "x" * 9000, "bb")], "doc_id long, text string, lang string")
    docs = docs.union(spark.createDataFrame([(i, "few", "cc") for i in range(40)], docs.schema))
    got = language.samples(docs)
    assert set(got) >= {"cc"} and len(got["cc"]) <= 24 * 4
    for k, want in (("aa", "some words here " * 6), ("bb", "x" * 5000)):
        assert got.get(k, want) == want


def test_pii_witness_is_heard_by_all_its_twins():
    field = pii.Field()
    field.form[:, 0] = 0.1  # ten form features a token: 1.0 for none
    field.skip = 3.0 * np.eye(pii.LABELS)
    twins = [f"411111{k:010}" for k in range(200) if not pii.luhn(f"411111{k:010}")][:50]
    for at in (0, 25, 50):
        words = [*twins[:at], "4111111111111111", *twins[at:]]
        text = " and so on and on ".join(words)
        base = pii.base_spans(text)
        assert len(base) == 1
        assert len([k for _, k, _ in field.more_spans(text, base) if pii.KINDS[k] == "card"]) == 50


def test_pii_messages_cross_a_long_chain():
    field = pii.Field()
    field.skip = 12.0 * np.eye(pii.LABELS)
    n = 51
    seen = np.zeros(n, dtype=np.int64)
    seen[0] = 3
    skip = np.array([(i, i + 1) for i in range(n - 1)])
    p = field.beliefs(np.zeros((n, pii.LABELS)), seen, np.zeros((0, 2), np.int64), skip)
    assert p[:, 3].min() > 0.9


def test_pii_field_judges_texts_without_base_spans(spark, monkeypatch):
    cards = [str(n) for n in range(4111110000000001, 4111110000000400) if pii.luhn(str(n))]
    field = pii.learn([f"pay {c} for {k} things" for k, c in enumerate(cards)])
    monkeypatch.setattr(pii, "train", lambda docs: field)
    wrong = "4111111111111112"
    docs = frame(spark, [f"pay {wrong} now and {wrong} later", "room 12 at 9 o'clock", None])
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert (got[0].n_card, got[0].spans) == (0, "card:4:20,card:29:45") and (got[1].spans, got[2].spans) == ("", "")
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out == {0: "pay [CARD] now and [CARD] later", 1: "room 12 at 9 o'clock", 2: None}


def test_decontaminate_counts_items_without_an_id(spark):
    item = " ".join(f"t{i}" for i in range(20))
    bench = spark.createDataFrame([(None, item), (None, "only here"), (3, item)], "item_id long, text string")
    docs = ["a " + item, "only here", "nothing"]
    for part in (decontaminate.PART_BYTES, 40):
        got = {r.doc_id: r for r in decontaminate.score(frame(spark, docs), bench, ["doc_id"], part).collect()}
        assert [(got[i].n_hit, got[i]["items"], got[i].contaminated) for i in range(3)] == [(20, ["3", None], True), (2, [None], True), (0, [], False)]
        judged = decontaminate.score(frame(spark, docs), bench, ["doc_id"], part).select("doc_id", decontaminate.digest("items").alias("d")).collect()
        assert {r.doc_id: r.d for r in judged} == {i: hashlib.sha256(s.encode()).hexdigest() for i, s in enumerate(["3", "", ""])}


def plain_dedup(rows):
    """n_removed of each (doc_id, text) row, by sets of whole windows."""
    first = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup_of_shared_ids(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, words("a", 30)), (2, words("a", 30) + " more"), (2, words("b", 40)), (2, words("b", 40)), (3, words("c", 5) + " " + words("b", 40)), (3, words("a", 13)), (4, None), (4, "")]
    got = substring_dedup.dedup(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_dedup(rows)


def test_jaccard_join_of_shared_ids(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    near = [*base[:30], "changed", *base[31:]]
    other = [f"x{k}" for k in range(60)]
    rows = [(1, base)] * 12 + [(2, near)] * 12 + [(3, other)] + [(2, [*other[:59], "end"])] * 2 + [(5, ["lone"])]
    compared = []
    plain = jaccard_join._verified

    def counted(docs, pairs):
        compared.append(pairs.count())
        return plain(docs, pairs)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    got = jaccard_join.join(frame(spark, [" ".join(w) for _, w in rows], [i for i, _ in rows])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, 5 if i == 5 else 1) for i, _ in rows)
    assert sum(compared) <= 3  # pairs of ids, whatever the number of rows
