"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from sluiceway.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == rows


def test_stateful_verdicts_agree(spark):
    """Windows, the fold and the stream give the same session-mode verdicts."""
    windows = {(r.session_id, r.seq): r.allowed for r in QUERIES["session_verdict"](spark, DATA).collect()}
    fold = {(r.session_id, r.seq): r.allowed for r in QUERIES["fold_session_verdict"](spark, DATA).collect()}
    assert fold == windows
    stream = QUERIES["stream_session_verdict"](spark, DATA).collect()
    assert len(stream) == len(windows)
    per_user: dict = {}
    for r in sorted(stream, key=lambda r: (r.session_id, r.seq)):
        seen = per_user.setdefault(r.session_id, [False, False])
        sink = r.tool in ("send_email", "fetch_web_page", "mystery_tool")
        assert r.allowed == (not (sink and all(seen)))
        assert r.exposed == seen[1]
        seen[0] |= r.tool == "query_customer_db"
        seen[1] |= r.tool in ("fetch_web_page", "read_email", "mystery_tool")


def test_output_scan_finds_every_disguise(spark):
    rows = QUERIES["output_scan"](spark, DATA).collect()
    found = {r.doc_id % 6: 0 for r in rows}
    for r in rows:
        assert r.kind == "containment"
        found[r.doc_id % 6] += 1
    assert len(found) == 6


def test_lineage_replay_blocks_more_than_nothing(spark):
    rows = QUERIES["lineage_replay"](spark, DATA).collect()
    assert {r.allowed for r in rows} == {True, False}
    assert {"TEMPORAL_FALLBACK"} <= {r.link_method for r in rows}
    assert all(r.matched_tags == "" or not r.allowed for r in rows)
