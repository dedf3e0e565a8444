"""Rules and stores that no query shows."""

import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from marlstone.functions import rules as R
from marlstone.operators import chunking, skills, stores, taxonomy
from marlstone.sources import files, parsers
from marlstone.streaming import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_code_types(spark):
    code = lambda uri, mime: one(spark, chunking.is_code(F.lit(uri), F.lit(mime)))
    assert all(code(None, m) for m in ("text/x-python", "text/x-kotlin", "application/x-SQL", "application/x-php", "text/x-c++src", "text/x-csharp"))
    assert not any(code(None, m) for m in ("application/x-compressed", "application/x-sh", "text/plain", "text/python", "application/x-tar", None))
    assert code("a/B.KT", None) and not code("a.txt", None) and not code(None, None)


def test_order_of_gates(spark):
    c = {"head_ref": "agent/x", "title": "t", "body": None, "files": 1, "lines": 1, "critical": 0, "checks": 2, "pending": 1, "failed": 1}
    gate = lambda **k: one(spark, R.merge_gate({n: F.lit(v) for n, v in (c | k).items()}))
    assert [gate(), gate(pending=0), gate(pending=0, failed=0), gate(checks=0), gate(critical=1), gate(lines=501), gate(files=16, lines=501), gate(body="[NEEDS-review]"), gate(head_ref="main")] == [
        "wait", "block_failed_checks", "merge", "no_checks", "privacy_critical_path", "too_many_lines", "too_many_files", "needs_review", "head_ref_not_agent",
    ]
    state = lambda s, k=None: one(spark, R.run_state(F.lit(s), F.lit(k)))
    assert [state("queued"), state("completed", "neutral"), state("completed", "skipped"), state("completed", "cancelled"), state("completed"), state("in_progress", "failure")] == ["pending", "passed", "passed", "failed", "failed", "pending"]
    cap = lambda *s: one(spark, R.spend_decision(*map(F.lit, s)))
    assert [cap(20.0, 0.0, 0.0), cap(19.99999, 100.0, 0.0), cap(0.0, 99.9999, 350.0), cap(0.0, 0.0, 0.0)] == ["daily_cap_hit", "weekly_cap_hit", "monthly_cap_hit", "under_caps"]


def test_times(spark):
    t = lambda x: one(spark, F.unix_seconds(R.iso_time(F.lit(x))))
    assert [t("1970-01-01T00:01:00Z"), t("1970-01-01T01:00:00+01:00"), t("1970-01-02"), t("soon"), t(None)] == [60, 0, 86400, None, None]


def test_files_and_hashes(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"abc\xff")
    got = files.read_texts(spark, str(tmp_path)).first()
    assert got.file_hash == hashlib.sha256(b"abc\xff").hexdigest() and got.text == "abc\ufffd"


def test_logs_and_histories(spark):
    log = spark.createDataFrame([(k, "ab"[k % 2], f"v{k}") for k in range(9)], "id int, event_type string, v string")
    assert [r.id for r in stores.tail(log, 3).collect()] == [6, 7, 8] and [r.id for r in stores.tail(log, 2, "b").collect()] == [5, 7]
    s = spark.createDataFrame([("t", "x", 2, "new"), ("t", "x", 1, "old"), ("u", "x", 1, "other")], "tenant string, id string, seq int, v string")
    assert [r.v for r in stores.history(s, {"tenant": "t", "id": "x"}).collect()] == ["old", "new"]
    q = spark.createDataFrame([("human", 100, "a"), ("mcp", 100, "b"), ("human", 39, "c"), ("human", 40, "d")], "caller string, t int, q string").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.q for r in stores.recent(q, F.timestamp_seconds(F.lit(100)), 60).collect()] == ["a", "d"]
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    asked = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("z", True)], "node string, found boolean")
    assert {(r.node, r.demand, r.gap) for r in stores.demand(asked, n).collect()} == {("a", 2, False), ("b", 1, True), ("c", 0, False)}
    mails = spark.createDataFrame([(1, "A@x", 5), (2, "a@X", 3), (3, "b@x", 1)], "id int, sender string, ts int")
    assert {(r.conversation, r.place, r.id) for r in stores.threads(mails).collect()} == {("a@x", 1, 2), ("a@x", 2, 1), ("b@x", 1, 3)}


def test_windows_of_streams(spark, tmp_path):
    rows = [{"tenant": "t", "ts": f"2024-01-01T{h:02}:{m:02}:00Z", "value": v} for h, m, v in ((0, 0, 1.0), (0, 20, 2.0), (2, 0, 4.0), (9, 0, 8.0))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = lambda: spark.readStream.schema("tenant string, ts timestamp, value double").json(str(tmp_path / "in"))

    def told(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    spent = {r.until: r.spent for r in told(feeds.spend_stream(stream()), "spent")}
    assert spent[datetime(2024, 1, 1, 1)] == 3.0 and spent[datetime(2024, 1, 1, 3)] == 7.0 and spent[datetime(2024, 1, 1, 10)] == 15.0 and spent[datetime(2024, 1, 2, 9)] == 8.0
    assert sorted(r.n for r in told(feeds.sessions(stream()), "sessions")) == [1, 1, 2]


def test_taxonomy_files(spark):
    told = {
        "document_types": {
            "rfi": {"display_name": "RFI", "file_patterns": ["RFI*.pdf"], "fields_hints": {"Number": {}, "status": {"values": ["Open", "rfi"]}}, "keywords": ["Ask"]},
            "memo": None, "unclassified": {"description": "own"},
        },
        "settings": {"default_type": "misc"},
    }
    rows = [("a", json.dumps(told)), ("b", "{}"), ("c", "no json"), ("d", '{"document_types": {"x": {}}}')]
    got = {(r.uri, r.ord): r for r in parsers.taxonomy_types(spark.createDataFrame(rows, "uri string, text string")).collect()}
    assert [got["a", k].name for k in range(4)] == ["rfi", "memo", "unclassified", "misc"] and [got["d", k].name for k in range(3)] == ["x", "general_document", "unclassified"]
    assert (got["a", 0].patterns, got["a", 0].keywords) == (["rfi*.pdf"], ["number", "status", "open", "rfi", "ask"]) and got["a", 1].display_name == "memo" and got["a", 3].display_name == "General Document"
    assert len(got) == 7


def test_answers_that_cannot_be_read_end_the_judgement(spark):
    docs = spark.createDataFrame([("the and of that with this", "x0.txt", "no json"), (None, None, None)], "text string, uri string, answer string")
    for r in taxonomy.classified(docs).collect():
        assert (r.predicted, r.confidence, r.reason, r.alternatives, r.heuristic_agreement, r.llm_error, r.alt_count) == ("unclassified", 0.0, "NOVEL_PATTERN", [], 0.0, 1.0, None)


def test_drafts_are_all_or_nothing(spark):
    rows = [("AEC", "query-pattern", "plain words"), ("AEC", "naming-convention", "mail a@b.org"), ("AEC", "ontology-shape", ""), ("AEC", "classifier-strategy", None), ("4", "x", "plain words")]
    groups = spark.createDataFrame([(d, k, b, True, 3, 0.5, [], ["o"]) for d, k, b in rows] + [("AEC", "late", "plain", False, 3, 0.5, [], ["o"])], "domain string, kind string, body string, crossing boolean, tenants long, mean_confidence double, shapes array<string>, observation_ids array<string>")
    files = spark.createDataFrame([("AEC", "query-pattern", "aec-query-pattern", 2)], "domain string, kind string, slug string, version int")
    got = {r.kind: (r.outcome, r.reason, r.relpath) for r in skills.drafted(groups, files).collect()}
    assert got == {
        "query-pattern": ("written", None, "AEC/query-pattern__aec-query-pattern__v3.md"), "naming-convention": ("checker_rejected", "NER_HIT_EMAIL", None),
        "ontology-shape": ("draft_invalid", "DRAFT_INVALID", None), "classifier-strategy": ("checker_rejected", "RAW_NUMERIC", None), "x": ("draft_invalid", "DRAFT_INVALID", None),
    }


def test_scan_of_observations(spark, tmp_path):
    lines = [{"event_id": f"{k}", "tenant": "t", "kind": "k", "observed_at": f"2024-01-0{9 - k}T00:00:00Z"} for k in range(1, 6)] + [{"event_id": "9", "tenant": "t"}, {"kind": "k"}]
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n\n")
    assert [r.event_id for r in files.read_observations(spark, str(tmp_path), limit=2).collect()] == ["5", "4"]
    assert files.read_observations(spark, str(tmp_path)).count() == 5 and files.read_observations(spark, str(tmp_path), limit=0).count() == 0
    assert files.count_observations(spark, str(tmp_path)) == 8
