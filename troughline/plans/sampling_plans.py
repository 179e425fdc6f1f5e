"""Queries over samples, splits and display orders of rated cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.operators import quality, sampling
from troughline.plans.registry import query
from troughline.plans.views import CARDS, cards, table

SEED = V.SEED
WITH = f"WITH {CARDS}"
HASH = f"md5(concat_ws('|', card_id, '{SEED}')), card_id"
DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS card_id, lang AS stratum, n_chars FROM documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("card_id"), F.col("lang").alias("stratum"), "n_chars")


def _quota_sql(source: str, n: str, ties: str, raw: str) -> str:
    return f"""sz AS (SELECT stratum, count(*) AS size FROM {source} GROUP BY 1), rw AS (SELECT stratum, size, {raw} AS raw FROM sz),
fl AS (SELECT *, floor(raw) AS fl FROM rw), qt AS (SELECT stratum, size, CAST(fl + CASE WHEN row_number() OVER (ORDER BY raw - fl DESC, stratum {ties}) <= {n} - (SELECT sum(fl) FROM fl) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM fl)"""


ASC_SQL = _quota_sql("docs", "150", "ASC", "size / (SELECT sum(size) FROM sz) * 150")
DESC_SQL = _quota_sql("cards", "40", "DESC", "40 * size / (SELECT sum(size) FROM sz)")


@query("g03_largest_remainder", f"""WITH {DOCS}, {ASC_SQL}, rk AS (SELECT docs.*, row_number() OVER (PARTITION BY stratum ORDER BY {HASH}) AS k FROM docs)
SELECT card_id, stratum FROM rk JOIN qt USING (stratum) WHERE k <= quota""")
def g03(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional_sample(_docs(spark, d).select("card_id", "stratum"), 150, ["card_id"])


@query("g03_quotas", f"WITH {DOCS}, {ASC_SQL} SELECT * FROM qt")
def g03_quotas(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quotas(_docs(spark, d), 150)


@query("g04_largest_remainder_desc", f"""{WITH}, {DESC_SQL}, rk AS (SELECT cards.*, row_number() OVER (PARTITION BY stratum ORDER BY {HASH}) AS k FROM cards)
SELECT card_id, stratum, quota FROM rk JOIN qt USING (stratum) WHERE k <= quota""")
def g04(spark: SparkSession, d: str) -> DataFrame:
    c = cards(spark, d).select("card_id", "stratum")
    drawn = sampling.proportional_sample(c, 40, ["card_id"], ties="desc")
    return drawn.join(sampling.quotas(c, 40, ties="desc").select("stratum", "quota"), "stratum")


@query("g05_simple_sample", f"WITH {DOCS}, rk AS (SELECT *, row_number() OVER (ORDER BY {HASH}) AS k FROM docs) SELECT card_id, n_chars FROM rk WHERE k <= 120")
def g05(spark: SparkSession, d: str) -> DataFrame:
    return sampling.simple_sample(_docs(spark, d), 120, ["card_id"]).select("card_id", "n_chars")


@query("g06_overlap_subset", f"{WITH}, rk AS (SELECT *, row_number() OVER (ORDER BY {HASH}) AS k FROM cards) SELECT card_id, stratum FROM rk WHERE k <= 60 ORDER BY 1")
def g06(spark: SparkSession, d: str) -> DataFrame:
    return sampling.overlap_subset(cards(spark, d).select("card_id", "stratum"), 60)


SPREAD_SQL = f"""WITH {CARDS}, sz AS (SELECT stratum, count(*) AS c FROM cards GROUP BY 1), f AS (SELECT CAST(sum(c) AS BIGINT) AS n, max(c) AS most FROM sz),
st AS (SELECT stratum, CAST(coalesce(sum(c) OVER (ORDER BY c DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sz),
stride AS (SELECT (SELECT d FROM (SELECT unnest(range(most, n - most + 1)) AS d, n AS size, least(greatest(CAST(round(n * {sampling.STRIDE!r}::DOUBLE) AS BIGINT), most), n - most) AS middle FROM f)
  WHERE gcd(d, size) = 1 ORDER BY abs(d - middle), d DESC LIMIT 1) AS d),
places AS (SELECT p, (p * d) % n AS i FROM (SELECT unnest(range(n)) AS p, n FROM f), stride WHERE d IS NOT NULL),
lst AS (SELECT card_id, stratum, start + row_number() OVER (PARTITION BY stratum ORDER BY {HASH}) - 1 AS i FROM cards JOIN st USING (stratum)),
placed AS (SELECT card_id, stratum, CAST(1 + CASE WHEN d IS NOT NULL THEN p WHEN most <= (n + 1) // 2 THEN CASE WHEN i < (n + 1) // 2 THEN 2 * i ELSE 2 * (i - (n + 1) // 2) + 1 END
  WHEN i < most THEN i + least(n - most, ((i + 1) * (n - most + 1) - 1) // most) ELSE ((i - most + 1) * most) // (n - most + 1) + i - most END AS BIGINT) AS display_pos
 FROM lst LEFT JOIN places USING (i), f, stride)"""


def _spread(spark: SparkSession, d: str) -> DataFrame:
    return sampling.spread_order(cards(spark, d).select("card_id", "stratum"), ["card_id"])


@query("g08_spread_order", f"{SPREAD_SQL} SELECT * FROM placed")
def g08(spark: SparkSession, d: str) -> DataFrame:
    return _spread(spark, d)


@query("g08_adjacent_repeats", f"{SPREAD_SQL} SELECT count(*) AS n_adjacent FROM placed a JOIN placed b ON b.display_pos = a.display_pos + 1 AND a.stratum = b.stratum")
def g08_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return sampling.adjacent_repeats(_spread(spark, d))


@query("g09_blind_ids", f"{SPREAD_SQL} SELECT printf('blind_%04d', display_pos) AS blind_id, card_id, stratum FROM placed")
def g09(spark: SparkSession, d: str) -> DataFrame:
    return sampling.blind_ids(_spread(spark, d)).select("blind_id", "card_id", "stratum")


@query("g09_blind_order", f"{WITH} SELECT card_id, row_number() OVER (ORDER BY {HASH}) AS display_pos FROM cards")
def g09_order(spark: SparkSession, d: str) -> DataFrame:
    return sampling.blind_order(cards(spark, d).select("card_id"), ["card_id"])


@query("j02_staging_checks", f"""{SPREAD_SQL} SELECT 'staged count = plan count' AS "check", (SELECT count(*) FROM placed) = count(*) AS ok FROM cards UNION ALL SELECT 'keys unique', count(*) = count(DISTINCT card_id) FROM cards
UNION ALL SELECT 'positions unique', count(*) = count(DISTINCT display_pos) FROM placed UNION ALL SELECT 'positions contiguous 1..N', min(display_pos) = 1 AND max(display_pos) = count(DISTINCT display_pos) FROM placed UNION ALL SELECT 'content equal to source', count(*) = 0 FROM cards WHERE n_chars > 9000""")
def j02(spark: SparkSession, d: str) -> DataFrame:
    """Long cards are staged with altered content, so exactly the content check fails."""
    plan = cards(spark, d).select("card_id", "stratum", "n_chars", F.sha2("card_id", 256).alias("sha256"))
    staged = sampling.spread_order(plan, ["card_id"]).withColumn(
        "sha256", F.when(F.col("n_chars") > 9000, "altered").otherwise(F.col("sha256"))
    )
    return quality.staging_checks(staged, plan)
