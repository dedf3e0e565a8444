"""The queries of induced trees, observations, search and serving against their SQL."""

import duckdb
import pytest

from marlstone.plans import observations, ontology, queries, search, serving

SMALL = "/root/testdata/sf0.001"
MODULES = {m.__name__ for m in (observations, ontology, search, serving)}
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ in MODULES and n in queries.ORACLE]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    plain = lambda rows: sorted(str([round(x, 9) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    rows = plain(tuple(r) for r in df.select(*names).collect())
    assert rows == plain(cur.fetchall()) and (rows or name == "signature_matches")


def test_every_query_has_sql_or_a_reason():
    """Those without SQL: chunks and clusters, which are tested on strings and by their cost."""
    assert {n for n in queries.QUERIES if n not in queries.ORACLE} == {"chunks", "chunks_by_kind", "kmeans_clusters"}
