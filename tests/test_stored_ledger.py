"""The stored ledger: read while its inputs are the same, done anew otherwise."""

import pytest

from roaskit.operators.ingest import LEDGER_SCHEMA
from roaskit.sources import state


def test_ledger_is_read_until_an_input_changes(spark, tmp_path):
    data, path = str(tmp_path / "data"), str(tmp_path / "ledger")
    spark.range(10).write.parquet(data)
    before = state.files_state(spark.read.parquet(data))
    assert state.load_ledger(spark, path, before) is None
    rows = [("google", "bad_dates", 3, 2.0, "three")]
    state.save_ledger(spark.createDataFrame(rows, LEDGER_SCHEMA), path, before)
    assert state.files_state(spark.read.parquet(data)) == before
    assert [tuple(r) for r in state.load_ledger(spark, path, before).collect()] == rows
    spark.range(5).write.mode("append").parquet(data)
    after = state.files_state(spark.read.parquet(data))
    assert after != before and state.load_ledger(spark, path, after) is None
    state.save_ledger(spark.createDataFrame([], LEDGER_SCHEMA), path, after)
    assert state.load_ledger(spark, path, after).count() == 0 and state.load_ledger(spark, path, before) is None


def test_state_of_an_empty_folder(spark, tmp_path):
    empty = spark.read.schema("id long").parquet(str(tmp_path))
    assert state.files_state(empty) == "0:None"
    with pytest.raises(Exception, match="(?i)path"):
        state.files_state(spark.read.parquet(str(tmp_path / "none")))
