"""The two audits and the URL filters against brute-force versions and their edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import filter_audit, source_divergence, url_filters

DOCS = "doc_id long, text string, lang string, source string, mask int, n long, blocks string, key long, size long"
PAGES = "page_id long, url string, html string, host string, rule string, at int"
WORDS, TERMS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 7, 7, "x", 7, 7) for i, t, lang, source in rows], DOCS)


def some_docs(seed):
    r = random.Random(seed)
    texts = [None, "", " \n", "A", "é" * 64, "é" * 64 + "x", "é" * 1088 + "a", "é" * 1088 + "b", "Word $ " * 150, "one two " * 130]
    texts += [" ".join(r.choice("ab|cDE") * r.randint(1, 3) for _ in range(r.randint(150, 260))) for _ in range(12)]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""]), r.choice(["s", "t", None])) for i in range(90)]
    return rows + [(None, texts[8], "en", "s"), (3, *rows[3][1:]), (3, *rows[3][1:]), (3, "other $", "en", "t")]


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    judged = defaultdict(list)
    for i, t, lang, _ in rows:
        t = t or ""
        w = WORDS.findall(t)
        upper = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * upper > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        judged[lang or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, docs in judged.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_filter_audit(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT_ROWS", hot)
    rows = some_docs(hot)
    labels = [(i, i % 3 % 2, i % 2) for i in range(0, 90, 2)] + [(4, None, None), (6, 1, None), (6, 0, 1), (None, 1, 1)]
    got = filter_audit.audit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * len({r.part for r in got})


def test_filter_audit_compares_texts_of_equal_hashes(spark, monkeypatch):
    same = lambda blocks=7: F.lit(5).cast("long")
    monkeypatch.setattr(filter_audit, "_fold", same)
    rows = [(1, "ab", "en", "s"), (2, "cd", "en", "s"), (3, "ab", "en", "s"), (4, "xyz", "en", "s"), (5, "cd", "en", "s"), (5, "ab", "en", "s"), (5, "ab", "en", "s")]
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    facts = filter_audit.written(filter_audit.labelled(filter_audit.measured(docs).drop("text"), labels), "facts")
    assert sorted(r.doc_id for r in filter_audit.duplicates(docs, labels, facts).collect()) == [3, 5, 5, 5]


def test_filter_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs_of(spark, []), labels).count() == 0
    got = filter_audit.audit(docs_of(spark, [(1, None, None, None)]), labels).collect()
    assert {(r.part, r.kept, r.unique_fails) for r in got if r.filter_order[r.step - 1] == "A"} == {("", 0, 1)}


def test_refinement_goes_through_long_texts(spark):
    """Texts that differ in their last code point only, in every block."""
    sizes = [63, 64, 65, 1087, 1088, 1089, 18000, 300000]
    rows = [(k, "w" * (n - 1) + c, "en", "s") for k, (n, c) in enumerate((n, c) for n in sizes for c in "abb")]
    facts = filter_audit.written(filter_audit.labelled(filter_audit.measured(docs_of(spark, rows)).drop("text"), spark.createDataFrame([], "doc_id long, quality int, toxic int")), "facts")
    assert sorted(r.doc_id for r in filter_audit.survivors(facts).collect()) == [k for k in range(len(rows)) if k % 3]


def plain_divergence(rows, least=10, top=10):
    langs, counts, of, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERMS.findall((t or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        langs[lang].update(terms)
        of[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [w for w in langs[lang] if of[lang][w] >= least]
        v = len(kept)
        share = lambda c, vv=v, kk=kept: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kk) + 2 * vv) for w in kk}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = share(counts[lang, source]), share(langs[lang])
        pairs = [(s, sum(f(p[w], o[w]) for w in kept)) for g, s in groups if g == lang and s != source for o in [share(counts[lang, s])]]
        terms = [(w, f(p[w], q[w])) for w in kept if counts[lang, source][w] and p[w] > q[w]]
        order = lambda x: (-x[1], x[0].encode())
        out += [(lang, source, "pair", i, x, k) for k, (i, x) in enumerate(sorted(pairs, key=order), 1)]
        out += [(lang, source, "term", i, x, k) for k, (i, x) in enumerate(sorted(terms, key=order)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [100_000, 0])
def test_source_divergence(spark, monkeypatch, small):
    monkeypatch.setattr(source_divergence, "SMALL_ROWS", small)
    monkeypatch.setattr(source_divergence, "TERMS_A_TASK", 20)
    monkeypatch.setattr(source_divergence, "PAIRS_A_STEP", 7)
    monkeypatch.setattr(source_divergence, "PAIRS_A_TASK", 5)
    r = random.Random(3)
    vocab = [f"{a}{b}" for a in "aBcéß" for b in ("x", "yy", "é", "ΣΑ", "zzzzzzzzzzzzzz", "zzzzzzzzzzzzzy")]
    rows = [(i, " ".join(r.choices(vocab[: 8 + 7 * (i % 4)], k=r.randint(0, 40))) + "1 2,é", r.choice(["en", "de", None]), r.choice("stuv")) for i in range(160)]
    rows += [(200, None, "en", "quiet"), (201, "", "lone", "s"), (202, "few words", "two", "s"), (203, "few", "two", "t"), (None, "aX", "en", None), (5, "aX aX", "en", "s"), (5, "aX aX", "en", "s")]
    got = source_divergence.divergence(docs_of(spark, rows)).collect()
    assert sorted(tuple(x) for x in got) == plain_divergence(rows)


def test_source_divergence_edges(spark, monkeypatch):
    assert source_divergence.divergence(docs_of(spark, [])).count() == 0
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 64)
    long = "word other " * 400 + "tail"
    rows = [(i, long, "en", "s" if i % 2 else "t") for i in range(12)]
    assert sorted(tuple(x) for x in source_divergence.divergence(docs_of(spark, rows)).collect()) == plain_divergence(rows)


def test_radix_top_takes_ties_by_bytes(spark):
    r = random.Random(8)
    for values in ([7], [0, 1], [3, 1 << 16, (1 << 16) + 1, 1 << 40, (1 << 62) + 5]):
        rows = [(g, item, r.choice(values)) for g in range(4) for item in {"".join(r.choices("aé\U0001f600b", k=r.randint(0, 14))) for _ in range(40)}]
        got = source_divergence.radix_top(spark.createDataFrame(rows, "gid long, item string, value long"), 10).collect()
        want = [x for g in range(4) for x in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1].encode()))[:10]]
        assert sorted(tuple(x) for x in got) == sorted(want)


def plain_judge(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = host.translate(LOWER)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/", "http://a.com", "http://a.com/", "http://a.com?x=/", "http://a.com#/en/", "x http://b.example.com/en/1://q/en/",
    "http://Example.com/en/1", "http://www.example.com/en/1?x", "http://m.www.example.com/en/", "http://wwwexample.com/en/", "http://.net/es/", "http://net/es/", "http://net./es/",
    "http://a.net/es", "http://a.net/es/x#y", "http://a.net/fr/\nq", "http://a.net:80/fr/", "http://é.NET/fr/é", "ftp://x.org/en/", "http://" + "a." * 3000 + "net/fr/" + "x" * 5000,
]


@pytest.mark.parametrize("most", [url_filters.BROADCAST_BYTES, 0])
def test_url_filters(spark, monkeypatch, most):
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", most)
    pages = [(k, u) for k, u in enumerate(URLS)] + [(3, URLS[12])] * 3 + [(None, URLS[11])]
    table = spark.createDataFrame([(i, u, "<html>", "h", "r", 5) for i, u in pages], PAGES)
    got = url_filters.judge(table, spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(((i, u, *plain_judge(u, url_filters.RULES)) for i, u in pages), key=key)


def test_url_filters_of_many_rules_and_equal_prefixes(spark, monkeypatch):
    """A prefix of one digit: nearly all rules meet every expression, and the digest decides."""
    monkeypatch.setattr(url_filters, "PREFIX", 1)
    r = random.Random(4)
    host = lambda: ".".join(r.choices(["a", "b", "net", "com"], k=r.randint(1, 4)))
    path = lambda: r.choice(["", "/", "/a", "/a/", "/ab", "/a/b"])
    rules = sorted({(host(), path()) for _ in range(80)})
    rules = [(h, p, r.choice(["allow", "block"])) for h, p in rules]
    pages = [(k, f"http://{host()}{path()}") for k in range(200)]
    odd = [(None, "/", "block"), ("", "/", "block"), ("a/b", "/", "block"), ("a", "x", "block"), ("b", "/", "maybe"), ("both.example", None, "allow"), ("both.example", "", "block")]
    table = spark.createDataFrame([*pages, (500, "http://both.example/q")], "page_id long, url string")
    got = url_filters.judge(table, spark.createDataFrame(rules + odd, "host string, path string, verdict string")).collect()
    want = {k: plain_judge(u, rules) for k, u in pages} | {500: ("both.example", "/q", "both.example", "block")}
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got} == want and len(got) == 201


def test_url_filters_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filters.judge(pages, none).collect()] == [(None, "allow")]
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert url_filters.allowed(pages, rules).count() == 0
