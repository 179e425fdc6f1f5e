"""Queries that go through files (written from the given tables into the shared folder) and through text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from troughline.operators import linkage, quality, responses
from troughline.plans.registry import query
from troughline.plans.views import CARDS, INV, cards, given_files, inventory, table
from troughline.schema import RUN_LOG, STAYS
from troughline.session import scratch_path
from troughline.sources import files, resume
from troughline.streaming.incremental import ingest_new_files

WITH = f"WITH {INV}"
CARD_SQL = f"WITH {CARDS}"


# --- scans and writes ---------------------------------------------------------------------------------------

@query("a01_glob_scan", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return given_files(spark, d, "orders*.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _part(spark: SparkSession, d: str, status: str) -> DataFrame:
    orders = table(spark, d, "orders").where(F.col("o_orderstatus") == status)
    return orders.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("t"))


@query("a02_consolidate", "SELECT o_custkey AS subject_id, o_orderkey AS record_id, o_totalprice AS t FROM orders ORDER BY 1, 2, 3")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return files.consolidate([_part(spark, d, s) for s in "FOP"], ["subject_id", "record_id", "t"])


@query("a03_consolidate_relaxed", """SELECT o_custkey AS subject_id, o_orderkey AS record_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS t,
 CASE WHEN o_orderstatus = 'O' THEN 1e0 * o_custkey END AS w, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS reject_reason FROM orders""")
def a03(spark: SparkSession, d: str) -> DataFrame:
    done = _part(spark, d, "F").withColumn("reject_reason", F.lit(""))
    open_ = table(spark, d, "orders").where(F.col("o_orderstatus") == "O").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("t"),
        (F.lit(1.0) * F.col("o_custkey")).alias("w"), F.col("o_orderpriority").alias("reject_reason"),
    )
    return files.consolidate_relaxed([done, open_, _part(spark, d, "P").drop("t")])


STAY_SQL = "SELECT o_custkey AS subject_id, CAST(NULL AS BIGINT) AS hadm_id, o_orderkey AS stay_id, o_orderdate AS intime, o_orderdate + INTERVAL 2 DAY AS outtime FROM orders"


def _stay_csv(spark: SparkSession, d: str) -> str:
    path = scratch_path(spark, "stays")
    stays = table(spark, d, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.lit(None).cast("bigint").alias("hadm_id"), F.col("o_orderkey").alias("stay_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("intime"),
        F.date_format(F.expr("o_orderdate + INTERVAL 2 DAYS"), "yyyy-MM-dd HH:mm:ss").alias("outtime"),
    )
    # The published layout has columns that are not asked for, and another order.
    public = stays.select("stay_id", F.lit("unit, of care").alias("first_careunit"), "outtime", "subject_id", F.lit(1.5).alias("los"), "hadm_id", "intime")
    public.write.option("header", True).option("compression", "gzip").csv(path)
    return path


@query("a04_csv_scan", STAY_SQL)
def a04(spark: SparkSession, d: str) -> DataFrame:
    return files.read_csv(spark, _stay_csv(spark, d), STAYS)


NUMERIC = "CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'view' AND value > 50e0 THEN '120f' ELSE CAST(round(value) AS STRING) END"


@query("a05_plausible_times", """SELECT event_id, round(event_id / 999.56e0, 6) AS t_nbp FROM events WHERE event_type <> 'error' AND NOT (event_type = 'view' AND value > 50e0) AND round(value) BETWEEN 40 AND 260""")
def a05(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "numerics")
    raw = table(spark, d, "events").select(
        F.col("event_id").alias("time"), F.lit("80").alias("HR [bpm]"), "event_id", F.expr(NUMERIC).alias("NBPs [mmHg]")
    )
    raw.write.option("header", True).option("compression", "gzip").csv(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("time", T.StringType()), T.StructField("NBPs [mmHg]", T.StringType())])
    found = files.plausible_times(files.read_csv(spark, path, schema), 999.56)
    return found.select("event_id", F.round("t_nbp", 6).alias("t_nbp"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Record file listing derived from orders: .../p<customer>/<order>/<file>; urgent orders lack numerics."""
    o = table(spark, d, "orders").select(F.format_string("waves/p%d/%d/", "o_custkey", "o_orderkey").alias("dir"), F.col("o_orderkey").cast("string").alias("r"), "o_orderpriority")
    both = o.select("dir", "r", "o_orderpriority", F.explode(F.array(F.lit(".hea"), F.lit("n.csv.gz"))).alias("ext"))
    kept = both.where((F.col("o_orderpriority") != "1-URGENT") | (F.col("ext") == ".hea"))
    return kept.select(F.concat("dir", "r", "ext").alias("path"))


@query("a06_discover_records", """WITH f AS (SELECT 'p' || o_custkey AS subject, CAST(o_orderkey AS VARCHAR) AS record_dir, o_orderpriority FROM orders)
SELECT subject, record_dir FROM f QUALIFY row_number() OVER (PARTITION BY subject ORDER BY record_dir) = 1 AND o_orderpriority <> '1-URGENT'""")
def a06(spark: SparkSession, d: str) -> DataFrame:
    return files.discover_records(_paths(spark, d))


@query("a07_subject_from_path", "SELECT url, TRY_CAST(nullif(regexp_extract(url, '.*/p([0-9]+)(/|$)', 1), '') AS BIGINT) AS subject FROM (SELECT replace(replace(url, '/en/', '/p'), '/fr/', '/p7/p') AS url FROM pages)")
def a07(spark: SparkSession, d: str) -> DataFrame:
    url = F.replace(F.replace("url", F.lit("/en/"), F.lit("/p")), F.lit("/fr/"), F.lit("/p7/p"))
    return table(spark, d, "pages").select(url.alias("url")).select("url", files.subject_from_path(F.col("url")).alias("subject"))


@query("a08_header_rates", """SELECT CAST(o_orderkey AS VARCHAR) AS path, 62.4725e0 AS fs, CASE WHEN o_orderstatus = 'F' THEN 999.56e0 ELSE 62.4725e0 END AS counter_freq FROM orders""")
def a08(spark: SparkSession, d: str) -> DataFrame:
    rate = F.when(F.col("o_orderstatus") == "F", "62.4725/999.56").when(F.col("o_orderstatus") == "O", "62.4725/").otherwise("62.4725")
    lines = F.array(F.lit("# comment"), F.lit("  "), F.concat(F.lit("rec 4 "), rate, F.lit(" 1000")), F.lit("seg 2 1/2 3"))
    text = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.posexplode(lines).alias("line_no", "value"))
    return files.record_rates(text)


@query("a09_record_window", """SELECT o_orderkey, o_orderdate AS record_start, o_orderdate + to_microseconds(CAST(round(floor(o_totalprice) / 62.5e0 * 1000000) AS BIGINT)) AS record_end FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 1""")
def a09(spark: SparkSession, d: str) -> DataFrame:
    header = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("base_date"),
        F.lit("00:00:00").alias("base_time"), F.floor("o_totalprice").alias("sig_len"), F.lit("62.5").alias("fs"),
    )
    return linkage.record_window(header).select("o_orderkey", "record_start", "record_end")


@query("a10_atomic_write", f"{WITH} SELECT record_id, nbp_timestamp_s, reject_reason FROM inv")
def a10(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "inventory")
    files.write_guarded(inventory(spark, d).select("record_id", "nbp_timestamp_s", "reject_reason"), path)
    return spark.read.parquet(path)


GUARDS = ("existing refused", "input refused", "dotted input refused", "folder above input refused")


@query("a11_write_guard", f"{WITH} SELECT guard, n FROM (SELECT count(*) AS n FROM inv), (VALUES {', '.join(f'({g!r})' for g in (*GUARDS, 'replaced'))}) g(guard)")
def a11(spark: SparkSession, d: str) -> DataFrame:
    """Every refusal leaves the table as it was; a forced write replaces another one."""
    from pyspark.errors import AnalysisException

    path, other = scratch_path(spark, "guard"), scratch_path(spark, "guard")
    files.write_guarded(inventory(spark, d).select("record_id", "reject_reason"), path)
    files.write_guarded(inventory(spark, d).select("record_id").limit(1), other)
    written, refused = spark.read.parquet(path), []
    name, above = path.rsplit("/", 1)[1], path.rsplit("/", 1)[0]
    targets = (path, path, f"{path}/../{name}", above)
    for guard, target in zip(GUARDS, targets):
        fresh = guard == "existing refused"
        try:
            files.write_guarded(inventory(spark, d).select("record_id") if fresh else written, target, force=not fresh)
        except (AnalysisException, ValueError):
            refused.append(guard)
    files.write_guarded(written, other, force=True)
    same = spark.read.parquet(other).count() == spark.read.parquet(path).count()
    done = [*refused, *(["replaced"] if same else [])]
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(r) for r in done])).alias("guard"), "n")


EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


@query("a12_incremental_ingest", "SELECT event_id, event_type FROM events WHERE value >= 1e0")
def a12(spark: SparkSession, d: str) -> DataFrame:
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    keep = lambda df: df.where(F.col("value") >= 1).select("event_id", "event_type")
    for _ in range(2):  # the second pass finds no new file and adds nothing
        ingest_new_files(spark, d, EVENTS, out, checkpoint, keep, glob="events*.parquet")
    return spark.read.parquet(out)


@query("a12_pending_keys", f"{WITH} SELECT subject_id, record_id FROM inv GROUP BY ALL HAVING count(*) FILTER (pre_window_valid) = 0")
def a12_pending(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d)
    work = inv.select("subject_id", "record_id").distinct()
    return resume.pending(work, inv.where("pre_window_valid"), ["subject_id", "record_id"])


LOG_SQL = """log AS (SELECT card_id AS row_id, CASE WHEN stratum = 'en' THEN 'model-a' WHEN stratum = 'de' THEN NULL ELSE 'model-b' END AS model, 0e0 AS temperature, reader_call AS call FROM cards WHERE n_chars < 2000)"""


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = cards(spark, d)
    model = F.when(F.col("stratum") == "en", "model-a").when(F.col("stratum") != "de", "model-b")
    log = c.where("n_chars < 2000").select(F.col("card_id").alias("row_id"), model.alias("model"), F.lit(0.0).alias("temperature"), F.col("reader_call").alias("call"))
    return c, log


@query("a13_resume_antijoin", f"{CARD_SQL} SELECT card_id AS row_id, reader_call AS call, n_chars < 2000 AS resumed FROM cards")
def a13(spark: SparkSession, d: str) -> DataFrame:
    c, log = _log(spark, d)
    todo = resume.resume(c.select(F.col("card_id").alias("row_id"), F.col("reader_call").alias("call")), log)
    return resume.finish_log(log.select("row_id", "call", F.lit(True).alias("resumed")), todo.withColumn("resumed", F.lit(False)))


@query("a14_resume_guard", f"{CARD_SQL}, {LOG_SQL} SELECT 'model' AS setting, 'model-a' AS expected, count(*) FILTER (model <> 'model-a') AS n_conflicts FROM log UNION ALL SELECT 'temperature', '0.0', 0")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return resume.incompatible_settings(_log(spark, d)[1], {"model": "model-a", "temperature": 0.0})


@query("a16_variant_logs", f"{CARD_SQL} SELECT 'v_short' AS variant, count(*) AS n, count(*) FILTER (model_ok) AS n_ok FROM cards WHERE n_chars < 2000 UNION ALL SELECT 'v_long', count(*), count(*) FILTER (model_ok) FROM cards WHERE n_chars >= 2000")
def a16(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_path(spark, "variants")
    c = cards(spark, d).select("card_id", "n_chars", "model_ok")
    for name, rows in (("v_short", c.where("n_chars < 2000")), ("v_long", c.where("n_chars >= 2000")), ("_provenance", c)):
        files.write_guarded(rows, f"{folder}/{name}.parquet")
    logs = files.read_variant_logs(spark, folder)
    return logs.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if("model_ok").alias("n_ok"))


@query("a17_typed_log", f"{CARD_SQL} SELECT card_id AS row_id, model_ok AS parsed_ok, CASE WHEN n_chars > 9000 THEN 'late text' END AS parse_error, CAST(NULL AS VARCHAR) AS rationale, CAST(n_chars AS DOUBLE) AS confidence FROM cards")
def a17(spark: SparkSession, d: str) -> DataFrame:
    raw = cards(spark, d).select(
        F.col("card_id").alias("row_id"), F.col("model_ok").alias("parsed_ok"), F.when(F.col("n_chars") > 9000, "late text").alias("parse_error"), F.col("n_chars").alias("confidence")
    )
    return files.typed_log(raw, RUN_LOG).select("row_id", "parsed_ok", "parse_error", "rationale", "confidence")


# --- responses ------------------------------------------------------------------------------------------------

# One text per card in every shape a response takes; the shape follows from the card's length.
_OBJ = "concat('{\"observed\": \"dip {', card_id, '}\", \"call\": \"', {call}, '\", \"confidence\": ', {conf}, ', \"rationale\": \"r ', stratum, '\"}')"
SHAPES = {
    "n_chars < 200": "''",
    "n_chars < 400": "concat('no answer for ', card_id)",
    "n_chars < 700": "concat('```json\n', {obj}, '\n```')",
    "n_chars < 1000": "concat('Sure {not json}: ', {obj}, ' Done.')",
    "n_chars < 1300": "'{\"call\": \"ipsilateral\", \"confidence\": 0.9, \"rationale\": \"x\"}'",
    "n_chars < 1500": "'{\"call\": \"maybe\", \"confidence\": 0.5}'",
    "n_chars < 1700": "'{\"call\": \"indeterminate\", \"confidence\": \"high\"}'",
    "n_chars < 2000": "'{\"call\": \"indeterminate\", \"confidence\": true, \"observed\": \"none\"}'",
    "n_chars < 2500": "'{\"call\": \"Indeterminate \", \"confidence\": 1.7, \"observed\": \"flat\"}'",
}


def _raw_text() -> str:
    obj = _OBJ.replace("{call}", "upper(reader_call)").replace("{conf}", "'0.25'")
    body = " ".join(f"WHEN {cond} THEN {expr.replace('{obj}', obj)}" for cond, expr in SHAPES.items())
    return f"CASE {body} ELSE {obj} END"


@query("b22_parse_adjudications", f"""{CARD_SQL}, s AS (SELECT *, n_chars >= 400 AND (n_chars < 1000 OR n_chars >= 2500) AS full_obj, n_chars >= 2000 AND n_chars < 2500 AS clamped FROM cards)
SELECT card_id, full_obj OR clamped AS parsed_ok, full_obj AS schema_complete,
 CASE WHEN full_obj THEN 'dip {{' || card_id || '}}' WHEN clamped THEN 'flat' END AS observed,
 CASE WHEN full_obj THEN reader_call WHEN n_chars >= 1500 AND n_chars < 2500 THEN 'indeterminate' END AS call,
 CASE WHEN full_obj THEN 0.25e0 WHEN clamped THEN 1e0 END AS confidence,
 CASE WHEN full_obj THEN 'r ' || stratum WHEN n_chars >= 1000 AND n_chars < 1300 THEN 'x' END AS rationale,
 CASE WHEN n_chars < 200 THEN 'empty response' WHEN n_chars < 400 THEN 'no JSON object found in response' WHEN full_obj OR clamped THEN NULL
  WHEN n_chars < 1300 THEN 'legacy_call_value: ''ipsilateral'' indicates a stale prompt' WHEN n_chars < 1500 THEN 'invalid or missing call: ''maybe'''
  WHEN n_chars < 1700 THEN 'non-numeric confidence: ''high''' ELSE 'non-numeric confidence: ''true''' END AS parse_error FROM s""")
def b22(spark: SparkSession, d: str) -> DataFrame:
    log = cards(spark, d).withColumn("raw_response", F.expr(_raw_text()))
    return responses.parse_adjudications(log).select(
        "card_id", "parsed_ok", "schema_complete", "observed", "call", "confidence", "rationale", "parse_error"
    )


_EXTRACT = """CASE WHEN n_chars < 300 THEN 'nothing found' WHEN n_chars < 800 THEN concat('```\n{"phenotype": "', stratum, '", "vasopressor_use": false}\n```')
 WHEN n_chars < 1400 THEN '{"phenotype": "none", "vasopressor_use": "unknown", "shock_state": ""}'
 WHEN n_chars < 3000 THEN concat('{"phenotype": " ', subject_id, ' ", "vasopressor_use": "Yes", "shock_state": "s", "notes": "n"}') ELSE '' END"""


@query("b23_parse_extractions", f"""{CARD_SQL} SELECT card_id, n_chars >= 300 AND n_chars < 3000 AS parsed_ok, CASE WHEN n_chars >= 300 AND n_chars < 800 THEN stratum WHEN n_chars >= 1400 AND n_chars < 3000 THEN subject_id END AS phenotype,
 CASE WHEN n_chars >= 300 AND n_chars < 800 THEN false WHEN n_chars >= 1400 AND n_chars < 3000 THEN true END AS vasopressor_use, CASE WHEN n_chars >= 1400 AND n_chars < 3000 THEN 's' END AS shock_state,
 CASE WHEN n_chars >= 1400 AND n_chars < 3000 THEN 'n' END AS notes, CASE WHEN n_chars < 300 THEN 'no JSON object found in response' WHEN n_chars >= 3000 THEN 'empty response' END AS parse_error FROM cards""")
def b23(spark: SparkSession, d: str) -> DataFrame:
    log = cards(spark, d).withColumn("raw_response", F.expr(_EXTRACT))
    return responses.parse_extractions(log).select("card_id", "parsed_ok", "phenotype", "vasopressor_use", "shock_state", "notes", "parse_error")


# --- digests and stamps -----------------------------------------------------------------------------------------

@query("j03_content_digests", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def j03(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return quality.content_digests(docs)


@query("j05_stamped_content", """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN lang = 'fr' THEN 'missing' WHEN lang = 'de' THEN 'malformed' WHEN lang = 'es' THEN 'mismatch' ELSE 'ok' END AS status,
 CASE WHEN lang = 'de' THEN 'abc' WHEN lang = 'es' THEN repeat('0', 64) WHEN lang <> 'fr' THEN sha256(text) END AS stamped, CASE WHEN lang <> 'fr' THEN sha256(text) END AS sha256, CASE WHEN lang <> 'fr' THEN CAST(octet_length(encode(text)) AS BIGINT) END AS body_bytes FROM documents""")
def j05(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.when(F.col("lang") == "de", "abc").when(F.col("lang") == "es", F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("text", 256))
    content = F.when(F.col("lang") == "fr", F.col("text")).otherwise(F.concat(F.lit("# sha256: "), stamp, F.lit("\n"), F.col("text")))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return quality.stamped_content(docs)


@query("j06_latest_payload", """WITH l AS (SELECT user_id, max(lpad(CAST(event_id AS VARCHAR), 12, '0')) AS path, arg_max(props, event_id) AS props, arg_max(event_type, event_id) AS et FROM events GROUP BY 1)
SELECT user_id, path, CASE WHEN et <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM l""")
def j06(spark: SparkSession, d: str) -> DataFrame:
    content = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props"))
    found = table(spark, d, "events").select("user_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), content.alias("content"))
    return quality.latest_payload(found, "k bigint", by=["user_id"])


@query("j03_file_digests")
def j03_files(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every written part file: one task per file."""
    path = scratch_path(spark, "digests")
    files.write_guarded(inventory(spark, d).select("record_id", "reject_reason").repartition(8, "record_id"), path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return quality.content_digests(found.select("path", "content")).select("sha256", "bytes")
