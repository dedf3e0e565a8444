"""A watched folder, restarted from its checkpoint between ticks."""

import json
import os

from marlstone.streaming import watch

TICKS = [
    {"a": "1", "b": "1", "c": "1"},
    {"a": "1", "b": "2", "d": "1"},
    {"b": "2", "c": "9"},
    {},
    {"a": "1", "b": "3"},
    {"a": "1"},
]


def plain_changes(ticks):
    out, before = set(), {}
    for n, now in enumerate(ticks):
        for uri in before.keys() | now.keys():
            if uri not in before:
                out.add((uri, n, "added", now[uri], None))
            elif uri not in now:
                out.add((uri, n, "deleted", None, before[uri]))
            elif now[uri] != before[uri]:
                out.add((uri, n, "modified", now[uri], before[uri]))
        before = now
    return out


def put(folder, n, tick):
    rows = [{"tick": n, "uri": u, "etag": e} for u, e in tick.items()] + [{"tick": n, "uri": None, "etag": None}]
    file = folder / f"{n}.json"
    file.write_text("\n".join(map(json.dumps, rows)) + "\n")
    os.utime(file, (1_700_000_000 + n,) * 2)  # files are taken in the order of their times


def test_ticks_with_restarts(spark, tmp_path):
    folder, out = tmp_path / "ticks", str(tmp_path / "out")
    folder.mkdir()
    stream = watch.snapshot_stream(spark, str(folder))
    told = lambda: {tuple(r) for r in spark.read.parquet(out).select("uri", "tick", "kind", "etag", "prior_etag").collect()}
    for n, tick in enumerate(TICKS[:3]):  # a tick, a run, and the next run from the checkpoint
        put(folder, n, tick)
        watch.watch(stream, out, str(tmp_path / "cp")).awaitTermination()
        assert told() <= plain_changes(TICKS[: n + 1])
    assert told() >= {c for c in plain_changes(TICKS[:3]) if c[2] != "deleted" or c[1] < 2}
    for n in (3, 4, 5):  # several ticks in one run
        put(folder, n, TICKS[n])
    put(folder, 6, TICKS[5])
    watch.watch(stream, out, str(tmp_path / "cp")).awaitTermination()
    want = plain_changes(TICKS + [TICKS[5]])
    assert told() == want
    assert spark.read.parquet(out).count() == len(want)  # each change once


def test_replay_of_all_ticks(spark):
    rows = [(n, u, e) for n, t in enumerate(TICKS) for u, e in [*t.items(), (None, None)]] + [(1, "a", "1")]
    got = {tuple(r) for r in watch.replayed(spark.createDataFrame(rows, watch.SNAPSHOT)).select("uri", "tick", "kind", "etag", "prior_etag").collect()}
    assert got == plain_changes(TICKS)
    assert watch.replayed(spark.createDataFrame([], watch.SNAPSHOT)).count() == 0
