"""The registered queries as a whole: coverage, naming, and a few against their SQL on the smallest tables."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from troughline.plans import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
COUNTS = {"a": 17, "b": 24, "c": 15, "d": 37, "e": 10, "f": 18, "g": 12, "j": 8}
ROWS_ONLY = {"f01_signal_reduce", "f09_extract_events", "j03_file_digests", "j04_manifest"}


def test_every_operator_id_has_a_query():
    ids = {m.group(1) for n in entry.queries() if (m := re.match(r"([a-j]\d\d)_", n))}
    assert ids >= {f"{letter}{i:02d}" for letter, n in COUNTS.items() for i in range(1, n + 1)}


def test_only_the_named_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="given tables are absent")
@pytest.mark.parametrize("name", ["d01_funnel", "c02_modal_match", "g02_sample_per_stratum", "d07_prf_long", "d31_curve_quantiles", "b22_parse_adjudications"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r) for r in entry.queries()[name](spark, str(DATA)).select(*cols).collect()), key=repr)
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="given tables are absent")
def test_flagship_query(spark):
    assert entry.entry(spark).count() == 11


def _plan(spark, capsys, name):
    entry.queries()[name](spark, str(DATA)).explain("formatted")
    text = capsys.readouterr().out
    return text[:text.index("\n(1) ")], text


@pytest.mark.skipif(not DATA.exists(), reason="given tables are absent")
@pytest.mark.parametrize("name", ["f03_baseline_qc", "f08_signature_events", "f10_param_sweep", "b12_record_time"])
def test_ticks_of_windows_move_once(spark, capsys, name):
    tree, text = _plan(spark, capsys, name)
    by_window = [line for line in text.splitlines() if line.startswith("Arguments: hashpartitioning(series") and "anchor" in line]
    # Windows of a sweep are counted by setting afterwards; their ticks do not move again.
    ticks = [line for line in by_window if "setting" not in line]
    assert len(ticks) == 1 and "REPARTITION" in ticks[0]
    assert "SortMergeJoin" not in tree


@pytest.mark.skipif(not DATA.exists(), reason="given tables are absent")
def test_extraction_is_one_grouped_step(spark, capsys):
    tree, _ = _plan(spark, capsys, "f09_extract_events")
    assert tree.count("FlatMapGroupsInPandas") == 1


@pytest.mark.skipif(not DATA.exists(), reason="given tables are absent")
def test_row_ids_move_rows_once(spark, capsys):
    tree, text = _plan(spark, capsys, "b07_row_id")
    # The sorted rows are read from the checkpoint; what moves afterwards is a number per partition.
    assert "rangepartitioning" not in text and "SortMergeJoin" not in tree


@pytest.mark.skipif(not DATA.exists(), reason="given tables are absent")
def test_the_modal_match_plans_its_range_join_once(spark, capsys):
    _, text = _plan(spark, capsys, "c02_modal_match")
    assert "_cell" not in text
