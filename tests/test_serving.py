"""Tenants, guarded reads, applied skills and partial rebuilds against plain versions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import applier, pages, tenants, tree
from marlstone.session import written

DIRECTORY = "tenant_id string, slug string, display_name string, plan string, db_schema_name string, db_role_name string, created_at timestamp, opt_out boolean"


def test_names_are_unique_within_a_batch(spark):
    there = spark.createDataFrame([("1", "acme", "A", "free", "vw_acme", "vw_acme_app", None, False)], DIRECTORY)
    rows = [("2", "acme", 1), ("3", "beta", 3), ("4", "beta", 2), ("5", "Beta", 1), ("6", "a--b", 1), ("7", None, 1), ("8", "ab", 1), ("9", "b-1", 1), ("10", "abc\n", 1)]
    wanted = spark.createDataFrame([(i, s, i, None, t) for i, s, t in rows], "tenant_id string, slug string, display_name string, plan string, t long").withColumn("created_at", F.timestamp_seconds("t"))
    full, outcomes = tenants.created(there, wanted)
    assert {r.tenant_id: r.outcome for r in outcomes.collect()} == {"2": "slug_taken", "3": "slug_taken", "4": "created", "5": "invalid_slug", "6": "invalid_slug", "7": "invalid_slug", "8": "invalid_slug", "9": "created", "10": "invalid_slug"}
    got = {r.slug: r for r in full.collect()}
    assert set(got) == {"acme", "beta", "b-1"} and (got["beta"].db_schema_name, got["b-1"].db_role_name, got["beta"].plan) == ("vw_beta", "vw_b-1_app", "free")
    again, outcomes = tenants.created(full, wanted.where("slug = 'beta'"))
    assert {r.outcome for r in outcomes.collect()} == {"slug_taken"} and again.count() == 3
    rows, n = tenants.listed(full, limit=1, offset=1)
    assert n == 3 and rows.count() == 1


def test_the_guard_comes_before_existence(spark):
    directory = spark.createDataFrame([("a", "a", "a", "free", "x", "y", None, False)], DIRECTORY)
    secret = "s" * 32
    keys = [("p" * 12, secret, "a", None), ("g" * 12, secret, "gone", None), ("r" * 12, secret, "a", "2024-01-01")]
    keys = spark.createDataFrame([(p, hashlib.sha256(s.encode()).hexdigest(), t, r) for p, s, t, r in keys], "prefix string, secret_hash string, tenant_id string, revoked_at string")
    token = lambda p, s=secret: f"vw_{p * 12}_{s}"
    calls = [(0, token("p"), "a"), (1, token("p"), "b"), (2, token("p"), "nobody"), (3, token("g"), "gone"), (4, token("r"), "a"), (5, token("p", "t" * 32), "a"), (6, "nonsense", "a"), (7, None, "a"), (8, token("q"), "a"), (9, token("p"), None)]
    got = tenants.guarded(tenants.authenticated(spark.createDataFrame(calls, "n int, token string, tenant_id string"), keys), directory)
    # a foreign key is told the same of tenants that are there and of those that are not
    assert {r.n: r.status for r in got.collect()} == {0: 200, 1: 403, 2: 403, 3: 404, 4: 401, 5: 401, 6: 401, 7: 401, 8: 401, 9: 403}
    assert "token" not in got.columns and [r.n for r in tenants.readable(directory.select("tenant_id", "slug"), got).collect()] == [0]


def plain_text(matches, most, least):
    """matches: (score, kind, title, body)."""
    blocks, total, cut = [], 0, False
    for score, _, title, body in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
        if score < least:
            continue
        head = f"--- LEARNED PATTERN: {title} ---"
        whole = f"{head}\n{body}\n--- END ---"
        gap = 2 if blocks else 0
        if total + gap + len(whole) <= most:
            blocks.append(whole)
            total += gap + len(whole)
            continue
        cut = True
        room = most - total - gap - len(head) - 2 - len("--- END ---")
        if room > len(applier.TAIL) + 1:
            blocks.append(f"{head}\n{body[: room - len(applier.TAIL)]}{applier.TAIL}\n--- END ---")
        elif not blocks and len(f"{head}{applier.TAIL}\n--- END ---") <= most:
            blocks.append(f"{head}{applier.TAIL}\n--- END ---")
        break
    return ("\n\n".join(blocks), len(blocks), cut) if blocks else None


@pytest.mark.parametrize("most", [0, 40, 62, 75, 130, 400, 4000])
def test_applied_text(spark, most):
    r = random.Random(most)
    rows, bodies = [], []
    for t in range(12):
        for k in range(r.randint(1, 6)):
            rows.append((f"t{t}", r.choice(["a", "b"]), f"title{k}", f"{t}/{k}", r.choice([0.3, 0.4, 0.5, 1.0])))
            bodies.append((f"{t}/{k}", "x" * r.choice([0, 5, 50, 300])))
    got = applier.applied(spark.createDataFrame(rows, "tenant string, kind string, title string, path string, score double"), spark.createDataFrame(bodies, "path string, body string"), most).collect()
    text = dict(bodies)
    want = {t: plain_text([(s, k, n, text[p]) for u, k, n, p, s in rows if u == t], most, 0.4) for t in {x[0] for x in rows}}
    assert {x.tenant: (x.text, x.n_skills, x.truncated) for x in got} == {t: w for t, w in want.items() if w}


def test_kept_matches_hold_until_the_library_changes(spark):
    maps = ", ".join(f"{v} map<string,string>" for v in applier.VOCABULARIES)
    configs = spark.createDataFrame(
        [("a", None, False, {"x": "rfi", "y": "memo"}, None, None, {"z": "phase"}, None, None), ("b", "law", None, {}, None, None, None, None, None), ("c", "AEC", True, {"x": "rfi"}, *[None] * 5)],
        f"tenant string, domain string, opt_out boolean, {maps}",
    )
    schema = "domain string, kind string, title string, body string, path string, modified long"
    lib = spark.createDataFrame([("AEC", "naming-convention", "N", "rfi by phase", "n", 5), ("AEC", "query-pattern", "Q", "memo", "q", 5)], schema)
    first, kept = applier.matched(configs, lib)
    got = {(m.tenant, m.title): (m.score, m.cached) for m in first.collect()}
    assert got[("a", "N")] == (pytest.approx(0.30 + 0.35 * 2 / 3 + 0.25 / 2 + 0.10), False) and got[("a", "Q")] == (pytest.approx(0.30 + 0.35 / 3 + 0.25 / 2), False)
    assert ("b", None) in got and not any(t == "c" for t, _ in got)
    again, kept = applier.matched(configs, lib, kept)
    assert all(m.cached for m in again.collect()) and again.count() == 3
    other = configs.withColumn("state_vocab", F.when(F.col("tenant") == "a", F.create_map(F.lit("s"), F.lit("open"))))
    changed, _ = applier.matched(other, lib, kept)
    assert {m.tenant: m.cached for m in changed.collect()} == {"a": False, "b": True}
    narrow, kept = applier.matched(configs, lib, kept, kind="query-pattern")  # another question than the kept one
    assert [(m.title, m.cached) for m in narrow.where("tenant = 'a'").collect()] == [("Q", False)]
    newer, _ = applier.matched(configs, lib.withColumn("modified", F.lit(6)), kept)
    assert not any(m.cached for m in newer.collect())
    empty, _ = applier.matched(configs, lib.limit(0))
    assert [m.title for m in empty.collect()] == [None, None]


def test_config_hash_is_that_of_sorted_compact_json(spark):
    maps = ", ".join(f"{v} map<string,string>" for v in applier.VOCABULARIES)
    row = spark.createDataFrame([("t", {"b": "é", "a": "x"}, *[None] * 5)], f"tenant string, {maps}").select(applier.config_hash(F.col("tenant"), F.lit(False)).alias("h")).first()
    plain = {"tenant_anon_id": "t", "opt_out": False, **{v: {} for v in applier.VOCABULARIES}, "type_vocab": {"a": "x", "b": "é"}}
    assert row.h == hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_partial_rebuild_is_a_full_build(spark, monkeypatch):
    r = random.Random(4)
    nodes = [(t, f"{t}{k}", None if k < 2 else f"{t}{(k - 2) // 2}", f"label {k % 5}", "x", k, [r.random(), r.random()] if k % 3 else None) for t in "abc" for k in range(14)]
    nodes = spark.createDataFrame(nodes, "tenant string, id string, parent_id string, label string, kind string, ord long, centroid array<double>")
    walked = written(tree.walk(nodes), "walked")
    chunks = [(t, f"{t}h{k}", k, f"{t}/{k % 9}", f"text {k}", [r.random(), r.random()], f"d{k}") for t in "abc" for k in range(40)]
    members = [(t, f"{t}{r.randrange(6, 14)}", f"{t}h{k}") for t in "abc" for k in range(40)] + [("a", "a13", "ah1")]
    chunks = spark.createDataFrame(chunks, "tenant string, chunk string, position long, source string, text string, embedding array<double>, document string")
    gone = [m for m in members if m[0] == "b" and m[1] == "b7"]
    new = [m for m in members if (m[0] == "a" and int(m[2][2:]) % 6 == 0) or m in gone]
    frame = lambda rows: spark.createDataFrame(rows, "tenant string, id string, chunk string")
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    full = lambda m: pages.with_related(written(pages.build(walked, tree.rollup(walked, m), chunks, now, centroids=nodes), "pages"), walked)
    # the store lacks a's new members and still has b7's, which leave
    store = written(full(frame([m for m in members if m[0] != "a" or m not in new])).withColumn("version", F.lit(3)), "store")
    after = [m for m in members if m not in gone]
    changed = frame(new).select("tenant", "id")
    built = []
    plain = pages.build

    def seen(walked_, held, *rest):
        built.append({(x.tenant, x.id) for x in held.select("tenant", "id").distinct().collect()})
        return plain(walked_, held, *rest)

    monkeypatch.setattr(pages, "build", seen)
    got = pages.rebuilt(store, walked, frame(after), chunks, changed, now, centroids=nodes)
    monkeypatch.undo()
    key = lambda df: sorted(tuple(x) for x in df.select(*[F.col(c).cast("string") for c in store.columns if c != "version"]).collect())
    assert key(got) == key(full(frame(after)))
    above = {("b", "b7")} | {(m[0], m[1]) for m in new}
    up = {(x.tenant, x.id): x.parent_id for x in nodes.collect()}
    for t, i in list(above):
        while (i := up[t, i]) is not None:
            above.add((t, i))
    assert built[0] <= above  # no other node's chunks were read
    old = {x.page_id for x in store.collect()}
    assert all(x.version == ((4 if x.page_id in old else 1) if (x.tenant, x.node) in above else 3) for x in got.collect())


def test_gaps_ask_for_rebuilds(spark):
    q = [("t", "n", 5, 0)] * 3 + [("t", "m", 5, 0)] * 2 + [("t", "m", 1, 0), ("t", "k", 5, 2), ("t", None, 5, 0)] + [("u", "n", 5, None)] * 3
    queries = spark.createDataFrame(q, "tenant string, node string, t long, hits int").withColumn("ts", F.timestamp_seconds("t"))
    events = pages.gaps(queries, F.timestamp_seconds(F.lit(2)))
    assert {(e.tenant, *e.node_ids) for e in events.collect()} == {("t", "n"), ("u", "n")}
    store = spark.createDataFrame([("t", "n", False), ("t", "m", False), ("u", "m", False)], "tenant string, node string, is_stale boolean")
    page, todo = pages.served(pages.marked_stale(store, events), "t")
    assert {(p.node, p.is_stale) for p in page.collect()} == {("n", True), ("m", False)} and [x.node for x in todo.collect()] == ["n"]
