import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from troughline.operators import quality
from troughline.schema import EVENT_INVENTORY, RUN_LOG, STAYS
from troughline.sources import files, resume
from troughline.streaming.incremental import ingest_new_files

SMALL = "subject_id string, record_id string, nbp_timestamp_s double, is_occlusion_signature boolean, reject_reason string"
PART1 = [("p2", "r1", 9.0, True, None), ("p2", "r1", 3.0, False, "no_phase2")]
PART2 = [("p1", "r9", 5.0, False, "no_pleth")]


def test_scan_and_consolidate(make, spark, tmp_path):
    make(SMALL, PART1).coalesce(1).write.parquet(str(tmp_path / "in/events_b.parquet"))
    make(SMALL, PART2).coalesce(1).write.parquet(str(tmp_path / "in/events_a.parquet"))
    parts = [spark.read.parquet(str(tmp_path / f"in/events_{x}.parquet")) for x in "ba"]
    keys = ["subject_id", "record_id", "nbp_timestamp_s"]
    one = [tuple(r) for r in files.consolidate(parts, keys).collect()]
    assert one == sorted(PART1 + PART2, key=lambda r: r[:3]) == [tuple(r) for r in files.consolidate(parts[::-1], keys).collect()]
    with pytest.raises(ValueError):
        files.consolidate([])
    with pytest.raises(ValueError, match="share one schema"):
        files.consolidate([parts[0], parts[1].drop("reject_reason")])
    part_files = files.scan_parquet(spark, str(tmp_path / "in/events_a.parquet"), "part-*.parquet")
    assert part_files.count() == 1
    with pytest.raises(FileNotFoundError):
        files.scan_parquet(spark, str(tmp_path / "in"), "nothing_*.parquet")


def test_relaxed_consolidation(make):
    out = files.consolidate_relaxed([make("a int, reject_reason string", [(1, "")]), make("a double, b string", [(2.5, "x")])])
    assert {tuple(r) for r in out.collect()} == {(1.0, None, None), (2.5, None, "x")} and dict(out.dtypes)["a"] == "double"


def test_nan_is_null_after_ingest(make):
    assert [r.v for r in files.missing_as_null(make("i int, v double", [(1, float("nan")), (2, 3.0)])).orderBy("i").collect()] == [None, 3.0]


def test_csv_with_types(spark, tmp_path):
    (tmp_path / "s.csv").write_text("subject_id,hadm_id,stay_id,intime,outtime\n1,,7,2020-01-01 10:00:00,2020-01-02 00:00:30\n")
    r = files.read_csv(spark, str(tmp_path / "s.csv"), STAYS).first()
    assert (r.subject_id, r.hadm_id, r.stay_id, r.outtime.second) == (1, None, 7, 30)


def test_plausible_times(make):
    raw = [("1000", "120"), ("2000", ""), ("3000", " 39.9 "), ("4000", "260"), ("x", "100"), ("5000", "n/a"), ("6000", None), ("7000", "261")]
    out = files.plausible_times(make("time string, `NBPs [mmHg]` string", raw), 1000.0)
    assert sorted(r.t_nbp for r in out.collect()) == [1.0, 4.0]
    with pytest.raises(ValueError, match="NBPs"):
        files.plausible_times(make("time string", []), 1.0)


def test_paths_headers_and_records(make):
    p = make("path string", [("/w/p10/p1001/8/8.hea",), ("/w/q/8",), ("/w/p5x/p12",)])
    assert [r[0] for r in p.select(files.subject_from_path(F.col("path"))).collect()] == [1001, None, 12]
    lines = [("a", 0, "# c"), ("a", 1, ""), ("a", 2, "rec/2 4 62.5/999.5 100"), ("a", 3, "x 1 7 9"), ("b", 0, "rec 4 62.5 100"), ("c", 0, "rec 4 62.5/ 100")]
    out = {r.path: (r.fs, r.counter_freq) for r in files.record_rates(make("path string, line_no int, value string", lines)).collect()}
    assert out == {"a": (62.5, 999.5), "b": (62.5, 62.5), "c": (62.5, 62.5)}
    with pytest.raises(Exception, match="unexpected header line"):
        files.record_rates(make("path string, line_no int, value string", [("z", 0, "too short")])).collect()
    listing = [f"w/{s}/{r}/{r}{e}" for s, r, es in (("p1", "2", (".hea", "n.csv.gz")), ("p1", "3", (".hea", "n.csv.gz")), ("p2", "1", (".hea",)), ("p2", "5", (".hea", "n.csv.gz")), ("p3", "9", (".hea", "n.csv.gz"))) for e in es]
    f = make("path string", [(x,) for x in listing])
    assert {tuple(r) for r in files.discover_records(f).collect()} == {("p1", "2"), ("p3", "9")}
    assert [tuple(r) for r in files.discover_records(f, 1).collect()] == [("p1", "2")]
    assert [tuple(r) for r in files.discover_records(f, listed=make("s string", [("p3",)])).collect()] == [("p3", "9")]


def test_variants(make, spark, tmp_path):
    names = make("path string", [("x/v_a.parquet",), ("x/_m.parquet",), ("x/v_a_checkpoint.csv",), ("x/v_b.parquet",)])
    assert {r.variant for r in files.discover_variants(names).collect()} == {"v_a", "v_b"}
    for v, n in (("v_a", 2), ("v_b", 3)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / f"{v}.parquet"))
    assert {(r.variant, r["count"]) for r in files.read_variant_logs(spark, str(tmp_path)).groupBy("variant").count().collect()} == {("v_a", 2), ("v_b", 3)}


def test_guarded_write(make, spark, tmp_path):
    out = str(tmp_path / "t")
    files.write_guarded(make("a int", [(1,)]), out)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_guarded(make("a int", [(2,)]), out)
    with pytest.raises(ValueError, match="input"):
        files.write_guarded(spark.read.parquet(out), out, force=True)
    files.write_guarded(make("a int", [(3,)]), out, force=True)
    files.append_log(make("a int", [(4,)]), out)
    assert sorted(r.a for r in spark.read.parquet(out).collect()) == [3, 4]


def test_typed_log_keeps_late_strings(make):
    rows = [(str(i), None if i < 150 else "boom") for i in range(200)]
    log = files.typed_log(make("row_id string, parse_error string", rows), RUN_LOG)
    assert log.schema == RUN_LOG and log.where("parse_error = 'boom'").count() == 50


def test_inventory_layout_is_fixed():
    assert len(EVENT_INVENTORY) == 22 and EVENT_INVENTORY.names[0] == "subject_id" and EVENT_INVENTORY.names[-1] == "reject_reason"


def test_resume(make):
    pool = make("row_id string, call string", [(c, None) for c in "abcd"])
    log = make("row_id string, call string, model string, temperature double, seed bigint", [("a", "x", "m", 0.0, 1), ("c", "y", None, 0.0, 2), (None, "z", "m", 0.0, 1)])
    todo = resume.resume(pool, log)
    assert sorted(r.row_id for r in todo.collect()) == ["b", "d"]
    assert resume.finish_log(log.select("row_id", "call"), todo).count() == 5
    assert resume.require_compatible(log, {"model": "m", "temperature": 0.0}) is log
    with pytest.raises(ValueError, match="seed"):
        resume.require_compatible(log, {"model": "m", "seed": 1})
    assert sorted(r.row_id for r in resume.pending(pool, log, ["row_id"]).collect()) == ["b", "d"]


def test_stream_takes_each_file_once(make, spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    go = lambda: ingest_new_files(spark, src, schema, out, cp, lambda d: d.where("a > 0"))
    make("a int", [(1,), (-1,)]).write.parquet(src)
    go()
    go()
    assert [r.a for r in spark.read.parquet(out).collect()] == [1]
    make("a int", [(2,)]).write.mode("append").parquet(src)
    go()
    assert sorted(r.a for r in spark.read.parquet(out).collect()) == [1, 2]


def test_digests_and_stamps(make, spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"abd")
    found = spark.read.format("binaryFile").load(str(tmp_path / "*.bin"))
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.bytes) for r in quality.content_digests(found).collect()}
    assert got == {n: (hashlib.sha256(c).hexdigest(), 3) for n, c in (("a.bin", b"abc"), ("b.bin", b"abd"))}
    body = "# a comment\nline two\n"
    good = hashlib.sha256(body.encode()).hexdigest()
    texts = {"ok": f"# sha256: {good.upper()}\n{body}", "missing": body, "malformed": f"# sha256: xyz\n{body}", "mismatch": f"# sha256: {good}\n{body}!", "missing2": ""}
    out = {r.path: r for r in quality.stamped_content(make("path string, content string", list(texts.items()))).collect()}
    assert {k: r.status for k, r in out.items()} == {"ok": "ok", "missing": "missing", "malformed": "malformed", "mismatch": "mismatch", "missing2": "missing"}
    assert out["ok"].sha256 == good and out["ok"].body_bytes == len(body)


def test_latest_payload_and_run_window(make):
    f = make("path string, content string", [("f_1", '{"model_id": "a"}'), ("f_2", '{"model_id": "b"}')])
    assert quality.latest_payload(f, "model_id string").first().model_id == "b"
    broken = quality.latest_payload(make("path string, content string", [("f_9", "{oops"), ("f_1", '{"model_id": "a"}')]), "model_id string").first()
    assert (broken.path, broken.model_id) == ("f_9", None)
    full = quality.run_window(make("run_utc string", [("2026-01-02T00:00:00",), ("2026-01-01T00:00:00",)])).first()
    assert (full.run_utc_start, full.run_utc_end) == ("2026-01-01T00:00:00", "2026-01-02T00:00:00")
    assert quality.run_window(make("run_utc string", [("2026-01-02",), (None,)])).first().run_utc_start is None


def test_drift_and_cardinality(make):
    obs, exp = make("k string, v double", [("a", 1.0), ("b", 2.0)]), make("k string, v double", [("a", 1.05), ("b", 2.5), ("c", 1.0)])
    assert {r.k: r.ok for r in quality.drift(obs, exp, "k", "v", 0.1).collect()} == {"a": True, "b": False, "c": False}
    rows = {r.check: r.ok for r in quality.cardinality(make("k string", [("a",), (None,)]), make("n bigint", [(2,)]), ["k"]).collect()}
    assert rows == {"row count as expected": True, "no null in k": False}
    with pytest.raises(ValueError, match="no null in k"):
        quality.enforce(quality.cardinality(make("k string", [(None,)]), make("n bigint", [(1,)]), ["k"]))
