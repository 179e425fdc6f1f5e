"""Reading and writing tables: glob scans, typed CSV, headers, logs, guarded writes."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from troughline.functions.labels import blank_to_null, nan_to_null, number
from troughline.schema import STAYS, require_columns


_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def scan_parquet(spark: SparkSession, folder: str, glob: str = "events_*.parquet", schema: T.StructType | None = None) -> DataFrame:
    """All Parquet files of a folder that match a name pattern, as one scan; none is an error, with a schema as well."""
    reader = spark.read.option("pathGlobFilter", glob)
    try:
        found = reader.schema(schema).parquet(folder) if schema else reader.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in _ABSENT:
            raise
        raise FileNotFoundError(f"no {glob} files found in {folder}") from e
    if schema and not found.inputFiles():
        raise FileNotFoundError(f"no {glob} files found in {folder}")
    return found


def consolidate(parts: Sequence[DataFrame], sort_keys: Sequence[str] | None = None) -> DataFrame:
    """Concatenate tables that must share one schema, optionally in a full sort."""
    if not parts:
        raise ValueError("no tables supplied to consolidate")
    names = {f.name: f.dataType for f in parts[0].schema}
    for p in parts[1:]:
        if {f.name: f.dataType for f in p.schema} != names:
            raise ValueError("tables to consolidate must share one schema")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*sort_keys) if sort_keys else out


def consolidate_relaxed(parts: Iterable[DataFrame], reason: str | None = "reject_reason") -> DataFrame:
    """Concatenate tables that may lack columns or hold narrower types; blank reasons become NULL."""
    parts = list(parts)
    if not parts:
        raise FileNotFoundError("no tables to consolidate")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if reason and reason in out.columns:
        out = out.withColumn(reason, blank_to_null(F.col(reason)))
    return out


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN in any floating column becomes NULL: the one missing-value rule after ingest."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[nan_to_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType = STAYS, timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
    glob: str | None = None,
) -> DataFrame:
    """Typed CSV (compressed or not); columns are found by the names in the header, in any order and among others.

    The first file's header gives the layout; a file with another one is an error when it is read, so
    layouts are read one call each. A column that the header lacks is an error; a value that does
    not fit its type is NULL. No inference pass over the data.
    """
    reader = spark.read.option("header", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    layout = reader.csv(path).columns  # one line of one file
    missing = [f.name for f in schema if f.name not in layout]
    if missing:
        raise ValueError(f"CSV in {path} lacks columns {missing}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in layout])
    raw = reader.schema(text).option("enforceSchema", False).csv(path)

    def typed(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            value = F.try_to_timestamp(value, F.lit(timestamp_format)).cast(field.dataType)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = number(value).cast(field.dataType)
        else:
            value = value.try_cast(field.dataType)
        return value.alias(field.name)

    return raw.select(*[typed(f) for f in schema])


def plausible_times(
    numerics: DataFrame, counter_freq: Column | float, value: str = "NBPs [mmHg]", tick: str = "time", lo: float = 40.0,
    hi: float = 260.0, out: str = "t_nbp",
) -> DataFrame:
    """Anchor seconds of a sparse numerics table: readable, plausible value; ticks over counter rate."""
    require_columns(numerics, value, tick, what="numerics")
    v, t = number(F.col(f"`{value}`").cast("string")), number(F.col(f"`{tick}`").cast("string"))
    rate = F.lit(float(counter_freq)) if isinstance(counter_freq, (int, float)) else counter_freq
    return numerics.withColumn(out, t / rate).where(v.between(lo, hi) & t.isNotNull())


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """`path, n_bytes` of every file below a folder whose name matches; contents are not read.

    Large folders are listed by tasks. A folder without such files gives an empty table.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return listed.select("path", F.col("length").alias("n_bytes"))


def subject_from_path(path: Column, pattern: str = r"(?:^|/)p(\d+)(?=/|$)") -> Column:
    """Digits of the deepest path part that is `p` and digits; NULL when there is none."""
    parts = F.regexp_extract_all(path, F.lit(pattern), F.lit(1))
    return F.try_element_at(parts, F.lit(-1)).try_cast("bigint")


def record_rates(lines: DataFrame, path: str = "path", line_no: str = "line_no", line: str = "value") -> DataFrame:
    """Frame and counter rate per header file, from its first line that is neither blank nor a comment.

    A counter rate that is not given falls back to the frame rate.
    """
    text = F.btrim(F.col(line), F.lit(" \t\r\n"))
    data = lines.where((text != "") & ~text.startswith("#"))
    first = data.groupBy(path).agg(F.min_by(text, F.col(line_no)).alias("_l"))
    field = F.get(F.split(F.get(F.split("_l", r"\s+"), F.lit(2)), "/"), F.lit(0))
    counter = F.get(F.split(F.get(F.split("_l", r"\s+"), F.lit(2)), "/"), F.lit(1))
    bad = F.raise_error(F.concat(F.lit("unexpected header line: "), F.col("_l"))).cast("double")
    fs = F.coalesce(field.try_cast("double"), bad)
    return first.select(path, fs.alias("fs")  , F.coalesce(F.nullif(counter, F.lit("")).try_cast("double"), fs).alias("counter_freq"))


def discover_records(
    files: DataFrame, n: int | None = None, path: str = "path", listed: DataFrame | None = None,
) -> DataFrame:
    """`subject, record_dir`: per listed subject its first record folder, if header and numerics are there.

    `files` lists paths `.../<subject>/<record>/<file>`. The first folder is chosen before its
    siblings are checked, so a subject whose first record is incomplete is skipped.
    """
    parts = F.split(F.col(path), "/")
    named = files.select(
        F.try_element_at(parts, F.lit(-3)).alias("subject"), F.try_element_at(parts, F.lit(-2)).alias("record_dir"),
        F.try_element_at(parts, F.lit(-1)).alias("name"),
    ).where(F.col("subject").isNotNull())
    if listed is not None:
        named = named.join(listed.select(F.col(listed.columns[0]).alias("subject")), "subject", "left_semi")
    has = lambda suffix: F.max((F.col("name") == F.concat("record_dir", F.lit(suffix))).cast("int")) == 1
    per_record = named.groupBy("subject", "record_dir").agg(has(".hea").alias("hea"), has("n.csv.gz").alias("num"))
    first = per_record.groupBy("subject").agg(F.min(F.struct("record_dir", "hea", "num")).alias("m"))
    found = first.where(F.col("m.hea") & F.col("m.num")).select("subject", F.col("m.record_dir").alias("record_dir"))
    return found if n is None else found.orderBy("subject").limit(n)


def discover_variants(paths: DataFrame, path: str = "path", skip_prefix: str = "_") -> DataFrame:
    """`variant, path` of finished variant logs: the file stem names the variant, `_` files are provenance."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return (
        paths.withColumn("_name", name)
        .where(F.col("_name").endswith(".parquet") & ~F.col("_name").startswith(skip_prefix))
        .groupBy(F.regexp_replace("_name", r"\.parquet$", "").alias("variant"))
        .agg(F.min(path).alias(path))
    )


def read_variant_logs(spark: SparkSession, folder: str, schema: T.StructType | None = None, skip_prefix: str = "_") -> DataFrame:
    """Every variant log of a folder in one scan, `variant` taken from the file name.

    A log may be a single file or a Spark-written folder named `<variant>.parquet`.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    raw = reader.schema(schema).parquet(folder) if schema else reader.parquet(folder)
    stem = F.regexp_extract(F.input_file_name(), r"/([^/]+)\.parquet(?:/[^/]+)?$", 1)
    return raw.withColumn("variant", stem).where(~F.col("variant").startswith(skip_prefix) & (F.col("variant") != ""))


def typed_log(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A log in exactly the given layout: absent columns are typed NULLs, so a late string cannot break it."""
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema
    ])


def _qualified(spark: SparkSession, path: str, is_uri: bool = False) -> str:
    """Scheme, store and full path as the file system names them; links are followed where the path exists."""
    jvm = spark._jvm
    named = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path)) if is_uri else jvm.org.apache.hadoop.fs.Path(path)
    fs = named.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(named)
    try:
        full = fs.resolvePath(full)
    except Py4JJavaError:  # not there yet
        pass
    text = full.toUri().normalize().toString()
    if text.startswith("file:"):
        text = "file:" + os.path.realpath(full.toUri().getPath())
    return re.sub(r"^s3[an]:", "s3:", text).rstrip("/")


def write_guarded(df: DataFrame, path: str, fmt: str = "parquet", force: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Write a table, refusing to overwrite its own inputs or, without `force`, existing output.

    Paths are compared as the file system qualifies them, in both directions. With `force` the
    new files are written beside the old ones, which give way only once every task has succeeded.
    """
    spark = df.sparkSession
    target = _qualified(spark, path)
    for source in (_qualified(spark, f, True) for f in df.inputFiles()):
        if source == target or source.startswith(target + "/") or target.startswith(source + "/"):
            raise ValueError(f"refusing to write onto an input: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    swap = force and fs.exists(place)
    beside = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}" if swap else path
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(beside)
    if swap:
        fs.delete(place, True)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), place):
            raise OSError(f"could not move {beside} to {path}")


def append_log(df: DataFrame, path: str) -> None:
    """Add one block to an append-only log."""
    df.write.mode("append").parquet(path)
