"""Registered queries against their oracle SQL (DuckDB) on a small scale.

All of them run with GLINTSCAN_ALL=1; otherwise a selection that touches every
part of the package.
"""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = [
    "kw_config_order", "kw_overlapping", "nested_hits", "chunked_check", "gated_check", "archive_members",
    "ooxml_text", "mime_cascade", "ole_score", "xml_clean", "xml_character_data", "clean_dispatch", "paragraph_budget", "augment_mixed", "json_report",
    "block_hits", "dictionary_hits", "dictionary_longest", "member_block_hits", "member_states",
    "run_log", "run_log_appended", "running_counts", "stream_resume", "dedup_keep_first", "class_report", "top_features", "row_cap",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("GLINTSCAN_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9)) if value % 1 else str(int(value))
    return str(value)


def rows_of(rows, names):
    return sorted(tuple(plain(row[n]) for n in names) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = rows_of([dict(zip(columns, r)) for r in result.fetchall()], names)
    assert rows_of([r.asDict() for r in df.collect()], names) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
