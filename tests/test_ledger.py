"""Logs over several runs have gapless numbers."""

import pytest

from glintscan.plans import ledger
from glintscan.streaming import scans


def rows(spark, ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string")


def numbers(spark, log):
    return [(r.seq, r.run, r.id) for r in ledger.read_log(spark, log).orderBy("seq").collect()]


def test_runs_go_on_and_repeated_ones_keep_their_numbers(spark, tmp_path):
    log = str(tmp_path / "log")
    ledger.append_run(rows(spark, [5, 3, 4]), ["id"], log, "one")
    ledger.append_run(rows(spark, []), ["id"], log, "none")
    ledger.append_run(rows(spark, [9, 8]), ["id"], log, "two/a b")
    want = [(1, "one", 3), (2, "one", 4), (3, "one", 5), (4, "two/a b", 8), (5, "two/a b", 9)]
    assert numbers(spark, log) == want
    ledger.append_run(rows(spark, [3, 4, 5]), ["id"], log, "one")
    assert numbers(spark, log) == want
    with pytest.raises(ValueError):
        ledger.append_run(rows(spark, [3, 4]), ["id"], log, "one")
    assert numbers(spark, log) == want
    ledger.append_run(rows(spark, [7, 8, 9]), ["id"], log, "two/a b")  # the last one may change
    assert numbers(spark, log)[3:] == [(4, "two/a b", 7), (5, "two/a b", 8), (6, "two/a b", 9)]


def test_a_run_that_died_before_its_rows_takes_its_range(spark, tmp_path):
    log = str(tmp_path / "log")
    assert ledger.reserve(spark, log, "a", 2) == 1
    ledger.append_run(rows(spark, [1]), ["id"], log, "b")
    ledger.append_run(rows(spark, [5, 6]), ["id"], log, "a")
    assert numbers(spark, log) == [(1, "a", 5), (2, "a", 6), (3, "b", 1)]


def test_stream_batches_are_runs(spark, tmp_path):
    table, log, state = (str(tmp_path / n) for n in ("t", "log", "state"))
    for part in ([3, 1], [2]):
        rows(spark, part).coalesce(1).write.mode("append").parquet(table)
        stream = scans.stream_table(spark, table, "id long, t string", 1)
        scans.run_to_end(lambda: ledger.append_numbered_log(stream, ["id"], log, state))
    assert [(s, i) for s, _, i in numbers(spark, log)] == [(1, 1), (2, 3), (3, 2)]
