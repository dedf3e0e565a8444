"""Parsers, stores, rules and streams on small rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.functions import rules as R
from marlstone.operators import chains, pages, signatures, skills, stores, taxonomy, tree, vectors
from marlstone.plans import governance, queries, wiki
from marlstone.sources import files, parsers
from marlstone.streaming import feeds

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ in (governance.__name__, wiki.__name__) and n in queries.ORACLE]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "conversations", "pages", "benchmark", "embeddings", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    plain = lambda rows: sorted(str([round(x, 9) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(cur.fetchall())


def test_read_texts_replaces_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ab\xff")
    assert files.read_texts(spark, str(tmp_path)).first().text == "ab�"


def test_mail_and_sheets(spark):
    raw = b"From: a@x.org\r\nTo: b@x.org, c@x.org\r\nSubject: Hi\r\nDate: Mon, 1 Jan 2024 10:00:00 +0000\r\nMessage-ID: <1>\r\n\r\nBody"
    m = spark.createDataFrame([(bytearray(raw),), (bytearray(b""),), (None,)], "raw binary").select(parsers.parse_mail("raw").alias("m")).collect()
    assert (m[0].m.sender, m[0].m.recipients, m[0].m.sent, m[0].m.body) == ("a@x.org", ["b@x.org", "c@x.org"], "2024-01-01T10:00:00+00:00", "Body")
    assert m[1].m.body.strip() in ("", parsers.NO_BODY) and m[2].m.has_attachments == "false"
    s = spark.createDataFrame([(bytearray(b"a,,c\n1,2,\n,,\n3,,4\n"),), (bytearray(b"a\n"),), (None,)], "raw binary")
    got = s.select(parsers.sheet_dicts("raw").alias("d"), parsers.sheet_text("raw").alias("t")).collect()
    assert got[0].d == [{"a": "1", "col_1": "2", "c": None}, {"a": "3", "col_1": None, "c": "4"}] and got[1].d == [] and got[2].d == []
    assert got[0].t == "a |  | c\n1 | 2 | \n3 |  | 4"


def test_parsers(spark):
    p = lambda e, m, u: one(spark, parsers.resolve_parser(F.lit(e), F.lit(m), F.lit(u), {"rfi": "r"}, {"text/plain": "t"}, {".eml": "m"}))
    assert [p("rfi", "text/plain", "a.eml"), p("x", "text/plain", "a.eml"), p(None, None, "a/b.EML"), p(None, None, "a")] == ["r", "t", "m", None]
    a = parsers.article(F.lit("---\nname: How\ntags: [one, 'two']\n# x\n---\nBody\n"), F.lit("kb/x.md"))
    assert (one(spark, a["name"]), one(spark, a["tags"]), one(spark, a["body"])) == ("How", ["one", "two"], "Body\n")
    b = parsers.article(F.lit("plain"), F.lit("kb/x.y.md"))
    assert (one(spark, b["name"]), one(spark, b["tags"]), one(spark, b["body"])) == ("x.y", [], "plain")
    f = spark.createDataFrame([("l/AEC/query-pattern__a-b__v2.md", "t"), ("l/AEC/bad__a__v1.md", "t"), ("l/AEC/query-pattern__a--b__v1.md", "t")], "uri string, text string")
    got = parsers.skill_files(f, ("query-pattern",))
    assert [(r.domain, r.slug, r.version) for r in got.collect()] == [("AEC", "a-b", 2)]
    assert skills.next_versions(got, spark.createDataFrame([("AEC", "query-pattern", "a-b")], "domain string, kind string, slug string")).first().relpath == "AEC/query-pattern__a-b__v3.md"
    assert one(spark, parsers.parse_confidence(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("")))) == 0.5
    assert one(spark, parsers.database_row(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2")))) == {"a": "2"}


def test_rules(spark):
    r = lambda t: one(spark, R.redact(F.lit(t)))
    assert r("x 4111-1111-1111-1111.") == "x [REDACTED:CC]." and r("4111111111111112") == "4111111111111112"
    assert r("a 123-45-6789 b") == "a [REDACTED:SSN] b" and r("sk_abcdefghij") == "[REDACTED:TOKEN]" and r("vw_pre_abcdefghij") == "vw_pre_[REDACTED]"
    d = lambda t: one(spark, R.detect(F.lit(t)))
    assert [d("é@x.org"), d("123 45 6789"), d("(555) 123-4567"), d("see www.x"), d("ok"), d("123e4567-e89b-12d3-a456-426614174000")] == ["NER_HIT_EMAIL", "NER_HIT_SSN", "NER_HIT_PHONE", "NER_HIT_URL", None, None]
    t = lambda x: tuple(one(spark, R.canonical_template(F.lit(x), {" A ": "phase"}, ("phase",))))
    assert t("-<a>_X9<b><a>-<c") == ("<phase>_x-<other><phase>", ["phase", "other"]) and t("--") == ("<other>", ["other"])
    assert one(spark, R.answer(F.lit('so {"type": "x", "confidence": 3} .'), ("x",))).confidence == 1.0
    bad = one(spark, R.answer(F.lit("no"), ("x",)))
    assert (bad.type, bad.confidence, bad.error) == ("unclassified", 0.0, "NOVEL_PATTERN")
    assert one(spark, R.safe_refusal(F.lit("I cannot."))) == "I cannot." and one(spark, R.safe_refusal(F.lit("Sure."))) == R.REFUSAL + "Sure."
    assert one(spark, R.token_parts(F.lit("vw_" + "a" * 12 + "_" + "b_" * 16))).secret == "b_" * 16 and one(spark, R.token_parts(F.lit("vw_a_b"))) is None
    g = lambda *a: one(spark, R.tenant_gate(*[F.lit(x) for x in a]))
    assert [g(False, True, "a", "a", False, False), g(True, True, "a", "b", False, False), g(True, True, "a", "a", True, False), g(True, True, "a", "a", True, True)] == ["deny_unknown", "deny_mismatch", "deny_unverified", "allow"]


def test_chain_names_the_first_bad_row(spark):
    rows = spark.createDataFrame([("c", i, i * 10, 'q"x', '{"k":1}') for i in range(9)] + [("d", 1, 1, "e", "{}")], "chain string, id long, ts_ns long, event_type string, payload string")
    linked = chains.linked(rows)
    assert {r.chain: (r.rows, r.bad_id) for r in chains.verified(linked).collect()} == {"c": (9, None), "d": (1, None)}
    bad = chains.verified(linked.withColumn("ts_ns", F.when(F.col("id") == 4, 0).otherwise(F.col("ts_ns")))).where("chain = 'c'").first()
    assert (bad.bad_id, bad.fault) == (4, "hash")
    gone = chains.verified(linked.where("id <> 4 OR chain = 'd'")).where("chain = 'c'").first()
    assert (gone.bad_id, gone.fault) == (5, "link")


def test_tree_rollup_cascades_and_merges(spark):
    n = [("t", "a", None, "A", "seed", 0), ("t", "b", "a", "B", "topic", 1), ("t", "c", "b", "C", "topic", 0), ("t", "d", "a", "B", "topic", 0), ("t", "x", "gone", "X", "topic", 0), ("t", "p", "q", "P", "topic", 0), ("t", "q", "p", "Q", "topic", 0)]
    nodes = spark.createDataFrame(n, "tenant string, id string, parent_id string, label string, kind string, ord int")
    walked = tree.walk(nodes)
    assert [(r.id, r.depth) for r in walked.orderBy("place").collect()] == [("a", 0), ("d", 1), ("b", 1), ("c", 2)]
    assert {(r.id, r.fault) for r in tree.faults(nodes, walked).collect()} == {("x", "dangling"), ("p", "cycle"), ("q", "cycle")}
    held = tree.rollup(walked, spark.createDataFrame([("t", "c", "1"), ("t", "d", "2")], "tenant string, id string, chunk string"))
    assert {(r.id, r.chunk) for r in held.collect()} == {("c", "1"), ("d", "2"), ("b", "1"), ("a", "1"), ("a", "2")}
    old = walked.withColumn("id", F.concat(F.lit("old-"), "id"))
    assert {r.id: r.stable_id for r in tree.merged(walked, old.where("label <> 'A'")).collect()} == {"a": "seed:A", "b": "old-d", "d": "old-d", "c": "old-c"}


def test_pages_upsert_and_staleness(spark):
    p = spark.createDataFrame([("t", "p1", "a", False, 1), ("u", "p1", "a", False, 4)], "tenant string, page_id string, node string, is_stale boolean, version int")
    new = spark.createDataFrame([("t", "p1", "a", False, 1), ("t", "p2", "b", False, 1)], p.schema)
    assert {(r.tenant, r.page_id): r.version for r in pages.upserted(p, new).collect()} == {("t", "p1"): 2, ("t", "p2"): 1, ("u", "p1"): 4}
    e = spark.createDataFrame([("t", ["a"], False), ("t", ["a"], False)], "tenant string, node_ids array<string>, affects_all boolean")
    assert {(r.tenant, r.is_stale) for r in pages.marked_stale(pages.marked_stale(p, e), e).collect()} == {("t", True), ("u", False)}
    assert [one(spark, pages.title(F.lit(x))) for x in ("a_b-RFI log", "", "42 x")] == ["A B RFI Log", "Untitled", "42 X"]
    with pytest.raises(ValueError):
        pages.listed(p, "t")


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i % 3 * 10), float(i % 2) / 10]) for i in range(30)], "vec_id long, embedding array<double>")
    found, centroids = vectors.kmeans(rows, 3)
    by = {r.vec_id: r.cluster for r in found.collect()}
    assert all((by[a] == by[b]) == (a % 3 == b % 3) for a in by for b in by) and len(centroids) == 3
    assert [vectors.pick_k(n) for n in (0, 1, 2, 50)] == [0, 1, 2, 5] and vectors.pick_k(3, 9) == 3
    assert vectors.top_k(rows.where("vec_id = 3"), rows, 2, block_rows=1).orderBy("place").select("vec_id").collect()[0].vec_id == 9


def test_taxonomy_rules(spark):
    t = (taxonomy.DocType("rfi_log", ("x",), ("rfi*.txt",)), taxonomy.DocType("memo"))
    s = one(spark, taxonomy.scores(F.lit("An RFI log X"), F.lit("a/RFI-1.txt"), t))
    assert [(r.type, r.score) for r in s] == [("rfi_log", 0.75), ("memo", 0.0)]
    assert one(spark, taxonomy.best(taxonomy.scores(F.lit(None).cast("string"), F.lit(None).cast("string"), t))).type == taxonomy.DEFAULT
    assert [x.name for x in taxonomy.with_overrides(t, (taxonomy.DocType("new"), taxonomy.DocType("memo", ("k",))))] == ["rfi_log", "memo", "new"]


def test_stores(spark):
    s = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "id string, seq int, v string")
    assert {r.id: r.v for r in stores.latest(s, ["id"]).collect()} == {"a": "y", "b": "z"}
    q = stores.queued(s, F.lit("2024-01-02").cast("timestamp"), "id").orderBy("seq").collect()
    assert [r.file for r in q] == ["2024-01-02/a.json", "2024-01-02/a-2.json", "2024-01-02/b.json"]
    rows, total = stores.page(s, ["seq"], limit=1, offset=1)
    assert (rows.first().v, total) == ("y", 3)
    kb = spark.createDataFrame([("Refunds", ["billing"], "about money", "1"), ("Other", [], "billing billing", "2")], "name string, tags array<string>, body string, path string")
    assert [(r.path, r.points) for r in stores.search_articles(kb, "Billing refunds the billing?", ("the",)).collect()] == [("1", 8), ("2", 2)]


def test_streams(spark, tmp_path):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "uri string, etag string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "uri string, etag string")
    assert {(r.uri, r.kind, r.prior_etag) for r in feeds.changes(before, now).collect()} == {("b", "modified", "1"), ("c", "deleted", "1"), ("d", "added", None)}
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"event_id": "1", "tenant": "t", "payload": "fine"}\n{"event_id": "2", "tenant": "out", "payload": "fine"}\n{"event_id": "3", "tenant": "t", "payload": "a@b.org"}\n')
    judged = lambda df: skills.collected(df, F.col("tenant") == "out", F.col("payload").isNull(), {"pii": R.detect(F.col("payload"))})
    ok, bad = str(tmp_path / "ok"), str(tmp_path / "bad")
    feeds.collect(feeds.observation_stream(spark, str(src)), judged, ok, bad, str(tmp_path / "cp")).awaitTermination()
    assert [r.event_id for r in spark.read.parquet(ok).collect()] == ["1"]
    assert {r.reason_code for r in spark.read.parquet(bad).collect()} == {"opt_out_dropped", "NER_HIT_EMAIL"}
    ev = tmp_path / "ev"
    ev.mkdir()
    (ev / "1.json").write_text('{"tenant": "t", "node_ids": ["a"], "affects_all": false}\n')
    events = spark.readStream.schema("tenant string, node_ids array<string>, affects_all boolean").json(str(ev))
    p = spark.createDataFrame([("t", "a", False), ("t", "b", False)], "tenant string, node string, is_stale boolean")
    feeds.stale_stream(events, p, str(tmp_path / "stale"), str(tmp_path / "cp2")).awaitTermination()
    assert [r.node for r in spark.read.parquet(str(tmp_path / "stale")).collect()] == ["a"]


def test_wiki_ids(spark):
    """Ids of nodes are unique within a tenant."""
    walked = wiki._tree(spark, SMALL)[0]
    assert walked.count() == walked.select("tenant", "id").distinct().count()


def test_skill_texts(spark):
    cases = [
        ("## When\n- use `naming::<phase>` in 11-50 or 0.75 of cases\n", None), ("", "SCHEMA_VALIDATION_FAILED"), (" \n", "SCHEMA_VALIDATION_FAILED"), (None, "SCHEMA_VALIDATION_FAILED"),
        ("x" * 64001, "SCHEMA_VALIDATION_FAILED"), ("- `Email`: none", "FORBIDDEN_FIELD_NAME"), ("a dim_width here", "FORBIDDEN_FIELD_NAME"), ("ask a@b.org or 555-123-4567", "NER_HIT_EMAIL"),
        ("call 555-123-4567, 123-45-6789", "NER_HIT_PHONE"), ("id 123-45-6789", "NER_HIT_SSN"), ("see www.x.y", "NER_HIT_URL"), ("### 7 cases", "RAW_NUMERIC"), ("```\n# 42\n```\n", "RAW_NUMERIC"),
        ("y" * 241, "STRING_TOO_LONG"), ("555\n```py\n123-4567\n```", "NER_HIT_PHONE"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i INT, t STRING").select("i", skills.skill_text_fault(F.col("t")).alias("f"))
    assert {r.i: r.f for r in df.collect()} == {i: f for i, (_, f) in enumerate(cases)}


def test_signature_payloads(spark):
    texts = [
        '{"kind": "relationship_schema", "edges": [{"relation": "b", "confidence_p50": 0.5}, {"relation": "a"}, {"relation": "b", "confidence_p50": 1.0}]}', '{"kind": "relationship_schema", "edges": []}',
        '{"kind": "ingestion_pipeline_metrics", "classification_failure_rate": 0.25}', '{"kind": "procedure_pattern", "states": ["i", "h", "g", "f", "e", "d", "c", "b", "a"]}', '{"kind": "unheard"}', "{}",
    ]
    p = spark.createDataFrame([(t,) for t in texts], "t STRING").select(F.from_json("t", signatures.PAYLOAD).alias("p"))
    got = [tuple(r) for r in p.select(signatures.skill_kind(F.col("p.kind")), signatures.confidence(F.col("p")), signatures.fingerprint(F.col("p"))).collect()]
    assert got == [
        ("relationship-schema", 0.75, "rel::a+b"), ("relationship-schema", 0.0, "rel::"), ("ingestion-pattern", 0.0, "pipe::/"), ("procedure-pattern", 1.0, "proc::i+h+g+f+e+d+c+b"), (None, 0.0, ""), (None, 0.0, ""),
    ]
