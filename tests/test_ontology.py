"""Induced trees against a plain version, and the pages' text."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from marlstone.operators import ontology, pages, tree

CHUNKS = "tenant string, chunk string, text string, embedding array<float>, cluster int, position long, source string, document string"
WORD = re.compile(r"[a-z][a-z0-9]+")


def node_id(kind, label, n):
    return f"ind:{kind}:" + hashlib.sha1(f"{kind}|{label}|{n}".encode()).hexdigest()[:12]


def plain_tree(rows, seeds, alike):
    """{(tenant, id): (parent, label, kind)} and the chunks of the topics."""
    nodes, held = {}, Counter()
    for tenant in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == tenant]
        clusters = sorted({r[4] for r in own if r[4] is not None})
        label, mean = {}, {}
        for c in clusters:
            n = Counter(w for r in own if r[4] == c for w in WORD.findall((r[2] or "").lower()) if len(w) > 2 and w not in ontology.STOP_WORDS)
            label[c] = "cluster_" + ("_".join(w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:2]) or str(c))
            v = [r[3] for r in own if r[4] == c and r[3] is not None]
            mean[c] = [sum(x) / len(v) for x in zip(*v)] if v else None
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) if a and b else 0.0
        root = {c: c for c in clusters}
        for _ in clusters:
            for a in clusters:
                for b in clusters:
                    if cos(mean[a], mean[b]) >= alike:
                        root[a] = root[b] = min(root[a], root[b])
        number = {f: i for i, f in enumerate(sorted(set(root.values())))}
        seen = {w for r in own for w in WORD.findall((r[2] or "").lower())} & set(ontology.SIGNALS)
        seeded = seeds is not None and len(seen) >= 3
        for f, i in number.items():
            kind, parent = ("category", None) if seeded else ("root", None)
            if seeded:
                have = set(WORD.findall(label[f]))
                over = [len(have & set(WORD.findall(f"{t} seed:{n}".lower()))) for n, t, _ in seeds]
                name, text, _ = seeds[over.index(max(over))]
                parent = f"seed:{name}"
                nodes[tenant, parent] = (None, text, "seed")
            nodes[tenant, node_id(kind, label[f], i)] = (parent, label[f], "induced")
        for c in clusters:
            kind, f = "category" if seeded else "root", root[c]
            nodes[tenant, node_id("topic", label[c], c)] = (node_id(kind, label[f], number[f]), label[c], "induced")
            held.update((tenant, node_id("topic", label[c], c), r[1]) for r in own if r[4] == c)
    return nodes, held


@pytest.mark.parametrize("with_seeds", [True, False])
def test_induced_tree(spark, with_seeds):
    r = random.Random(1)
    vocab = ["contract", "drawing", "rfi", "the", "of", "moon", "star", "a1", "x", "Élan"]
    rows = []
    for t, words in (("a", vocab), ("b", vocab[3:]), ("c", vocab[:2] + vocab[3:])):
        for k in range(60):
            c = r.choice([0, 1, 2, 3, 5, None])
            base = [1.0, 0.0, 0.0] if c in (1, 3) else [0.0, 1.0, 0.0] if c == 0 else [0.0, 0.0, 1.0]
            vec = [x + r.random() * 0.1 for x in base]
            rows.append((t, f"{t}{k % 50}", " ".join(r.choices(words, k=6)).title(), vec if k % 7 else None, c, k, f"s{k % 9}", f"d{k}"))
    rows += [("d", "lone", "12 of the", None, 4, 0, "s", "d"), ("e", "none", None, None, None, 0, "s", "d")]
    seeds = [("paper", "Paper work", 0), ("sky", "Moon and star", 1), ("drawing", "Plans", 2), ("unused", "Zebra", 3)]
    given = spark.createDataFrame(seeds, "name string, label string, ord int") if with_seeds else None
    nodes, members = ontology.induce(spark.createDataFrame(rows, CHUNKS), given)
    want, held = plain_tree(rows, seeds if with_seeds else None, ontology.ALIKE)
    got = nodes.collect()
    assert {(n.tenant, n.id): (n.parent_id, n.label, n.kind) for n in got} == want and len(got) == len(want)
    assert Counter((m.tenant, m.id, m.chunk) for m in members.collect()) == held
    ids = {(n.tenant, n.id) for n in got}
    assert all(n.parent_id is None or (n.tenant, n.parent_id) in ids for n in got)
    walked = tree.walk(nodes)
    assert walked.count() == len(got)  # a root reaches every node


def test_answers_name_clusters(spark):
    rows = [("t", f"c{k}", "moon star", [1.0, 0.0], k % 2, k, "s", "d") for k in range(4)]
    answers = spark.createDataFrame([("t", 0, 'It is {"label": " sky ", "confidence": 2}'), ("t", 1, "no idea")], "tenant string, cluster int, answer string")
    nodes, _ = ontology.induce(spark.createDataFrame(rows, CHUNKS), answers=answers)
    assert {(n.label, n.confidence) for n in nodes.collect() if n.parent_id} == {("sky", 1.0), ("cluster_moon_star", 0.5)}


def test_empty_corpus(spark):
    nodes, members = ontology.induce(spark.createDataFrame([], CHUNKS), spark.createDataFrame([("s", "S", 0)], "name string, label string, ord int"))
    assert nodes.count() == members.count() == 0


def test_page_text(spark):
    nodes = spark.createDataFrame(
        [("t", "r", None, "top_level-Topic", "induced", 0, [0.0, 1.0]), ("t", "k1", "r", "kid", "induced", 1, None), ("t", "k2", "r", "kid", "induced", 2, None), ("t", "k3", "r", "", "induced", 3, None)],
        "tenant string, id string, parent_id string, label string, kind string, ord long, centroid array<double>",
    )
    texts = ["  it's a\thead\nsecond line", "x" * 300, " \n ", "late copy"]
    vec = [[0.0, 2.0], [1.0, 0.0], [1.0, 1.0], [0.5, 0.5]]
    chunks = [("t", f"h{k}", k, f"uri{k % 2}", t, v, f"doc{k // 2}") for k, (t, v) in enumerate(zip(texts, vec))] + [("t", "h3", 0, "uri0", "early copy", vec[3], "doc9")]
    chunks = spark.createDataFrame(chunks, "tenant string, chunk string, position long, source string, text string, embedding array<float>, document string")
    held = spark.createDataFrame([("t", "r", f"h{k}") for k in range(4)] + [("t", "k1", "h1")], "tenant string, id string, chunk string")
    types = spark.createDataFrame([("doc0", "rfi"), ("doc1", "spec"), ("doc9", "never")], "document string, type string")
    now = pages.F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    page = pages.build(tree.walk(nodes), held, chunks, now, centroids=nodes, types=types).collect()
    assert [p.node for p in page] == ["r"]  # one chunk makes no page
    mark = hashlib.sha256(b"h0|h2|h3|h1").hexdigest()[:16]
    head = repr("it's a\thead")
    summary = f"This page summarises the topic 'top_level-Topic'. It was built from 4 source chunks across 2 distinct documents. Representative excerpt: {head}. {pages.CLOSING % mark}"
    docs = "1. [uri0](uri0)\n   > it's a\thead second line\n2. [uri0](uri0)\n   > \n3. [uri1](uri1)\n   > late copy\n4. [uri1](uri1)\n   > " + "x" * 237 + "..."
    facts = "- Source documents: 2\n- Total chunks: 4\n- Last updated: 2024-02-01T00:00:00+00:00\n- Predominant document types: rfi, spec"
    assert page[0].body == f"## Overview\n\n{summary}\n\n## Key documents\n\n{docs}\n\n## Related topics\n\n- kid\n\n## Metadata\n\n{facts}\n"
    assert (page[0].title, page[0].slug, page[0].doc_types) == ("Top Level Topic", "top-level-topic", ["rfi", "spec"])


def test_kin_by_lists(spark):
    nodes = spark.createDataFrame([("t", f"n{k}", None if k == 0 else f"n{(k - 1) // 3}", f"l{k}", "x", k) for k in range(20)], "tenant string, id string, parent_id string, label string, kind string, ord long")
    got = {(r.id, r.other, r.rank) for r in tree.related(tree.walk(nodes), nodes.where("id <> 'n4'")).collect()}
    want = set()
    for a in range(20):
        for b in range(20):
            up = lambda k: None if k == 0 else (k - 1) // 3
            if a != b and b != 4 and (up(a) == b or up(b) == a or (up(a) == up(b))):
                want.add((f"n{a}", f"n{b}", 0 if up(a) == b else 1 if up(a) == up(b) else 2))
    assert got == want


def test_label_prompts_are_cut(spark):
    rows = [("t", f"c{k}", "\n" + "ab" * 400 if k == 1 else f"text {k}\n\n\nend ", None, 0, k, "s", "d") for k in range(7)]
    got = ontology.excerpts(spark.createDataFrame(rows, CHUNKS)).first().prompt
    lines = ["[doc 1] text 0\n\nend", "[doc 2] " + "ab" * 300 + "...", *[f"[doc {k + 1}] text {k}\n\nend" for k in (2, 3, 4)]]
    assert got == "Cluster excerpts:\n\n" + "\n\n".join(lines) + "\n\nReturn the JSON object now."

