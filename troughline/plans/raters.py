"""Queries over rated cards (documents joined to labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from troughline import vocabulary as V
from troughline.functions import labels as L
from troughline.operators import bootstrap, choose, funnel, quality, rating, reweight
from troughline.plans.registry import draw_sql, query
from troughline.plans.views import CARDS, cards, table

SEED = V.SEED
WITH = f"WITH {CARDS}"
PREDICTORS = {"detector": ("detector_call", None), "model": ("model_call", "model_ok")}
REPS = 5_000
#: Replicates of the interval of a mean.
MEAN_REPS = 10_000


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def draws_sql(sums: str, by: str, metrics: dict[str, tuple[str, str]], reps: int = REPS, own: str = "") -> str:
    """CTEs of a cluster bootstrap over `sums` (by..., cl, x/y columns): numbered, draw, reps and ci, their names after `own`."""
    on = " AND ".join(f"d.{c} = n.{c}" for c in by.split(", ")) + " AND " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    dlead = "".join(f"d.{c}, " for c in by.split(", ")) if by else ""
    group = f"GROUP BY {', '.join(str(i + 1) for i in range(len(by.split(', '))))}" if by else ""
    rgroup = f"GROUP BY {', '.join(str(i + 1) for i in range(len(by.split(', ')) + 1))}" if by else "GROUP BY 1"
    ratio = ", ".join(f"CASE WHEN sum({y}) > 0 THEN sum({x}) / sum({y}) END AS v_{m}" for m, (x, y) in metrics.items())
    ci = ", ".join(f"quantile_cont(v_{m}, 0.025) AS lo_{m}, quantile_cont(v_{m}, 0.975) AS hi_{m}" for m in metrics)
    return f"""{own}numbered AS (SELECT *, row_number() OVER ({part}ORDER BY md5(concat_ws('|', cl, '{SEED}')), cl) - 1 AS pos, count(*) OVER ({part}) AS k FROM {sums}),
{own}draw AS ({draw_sql(own + 'numbered', reps, SEED, lead)}),
{own}reps AS (SELECT {dlead}rep, {ratio} FROM {own}draw d JOIN {own}numbered n ON {on}d.pick = n.pos {rgroup}),
{own}ci AS (SELECT {lead}{ci} FROM {own}reps {group})"""


# --- labels and scalar rules ------------------------------------------------------------------------------

@query("b02_normalise_label", f"{WITH} SELECT card_id, lower(trim(w)) AS call FROM (SELECT card_id, CASE WHEN n_chars < 300 THEN '   ' ELSE '  ' || upper(reader_call) || ' ' END AS w FROM cards) WHERE trim(w) <> ''")
def b02(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("n_chars") < 300, "   ").otherwise(F.concat(F.lit("  "), F.upper("reader_call"), F.lit(" ")))
    return L.rated(cards(spark, d).select("card_id", raw.alias("call")), "call")


WORDS = "CASE WHEN n_chars < 500 THEN 'TRUE' WHEN n_chars < 1000 THEN 'yes' WHEN n_chars < 1500 THEN '1' WHEN n_chars < 2500 THEN 'no' WHEN n_chars < 4000 THEN 'maybe' END"


@query("b03_truthy", f"{WITH} SELECT card_id, lower(w) IN ('true', '1', 't', 'yes') AS flag FROM (SELECT card_id, {WORDS} AS w FROM cards)")
def b03(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", L.truthy(F.expr(WORDS)).alias("flag"))


@query("b04_tolerant_flag", f"{WITH} SELECT card_id, coalesce(lower(w) IN ('true', '1', 'yes'), false) AS flag FROM (SELECT card_id, {WORDS} AS w FROM cards)")
def b04(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", L.tolerant_flag(F.expr(WORDS)).alias("flag"))


@query("b05_recode_calls", f"""{WITH} SELECT card_id, CASE reader_call WHEN 'occlusion_signature_present' THEN 'present' WHEN 'indeterminate' THEN 'indeterminate' ELSE 'absent' END AS reader FROM cards""")
def b05(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", L.recode_strict(F.col("reader_call"), V.CALL_CLASSES, "call").alias("reader"))


@query("b06_call_label", f"{WITH} SELECT card_id, detector_call FROM cards")
def b06(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", L.call_label(F.col("detector_flag")).alias("detector_call"))


DIRECTION_SQL = """CASE WHEN reader_call = pass2_call THEN 'unchanged' WHEN pass2_call = 'occlusion_signature_present' THEN 'to_present' WHEN reader_call = 'occlusion_signature_present' THEN 'from_present'
 WHEN pass2_call = 'indeterminate' THEN 'to_indeterminate' WHEN reader_call = 'indeterminate' THEN 'from_indeterminate' ELSE 'other' END"""


@query("b14_change_direction", f"{WITH} SELECT card_id, {DIRECTION_SQL} AS direction FROM cards")
def b14(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", L.change_direction(F.col("reader_call"), F.col("pass2_call")).alias("direction"))


@query("b15_collapse_binary", f"{WITH} SELECT card_id, CASE WHEN reader_call = 'occlusion_signature_present' THEN reader_call ELSE 'no_occlusion_signature' END AS call FROM cards")
def b15(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card_id", L.collapse_binary(F.col("reader_call")).alias("call"))


KAPPA_SQL = """pair AS (SELECT {by}{a} AS a, {b} AS b FROM cards), tot AS (SELECT {by}count(*) AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END) * 1e0 AS same FROM pair {g}),
ma AS (SELECT {by}a AS c, count(*) * 1e0 AS na FROM pair GROUP BY ALL), mb AS (SELECT {by}b AS c, count(*) * 1e0 AS nb FROM pair GROUP BY ALL)"""


@query("b16_agreement_bands", f"""{WITH}, {KAPPA_SQL.format(by="subject_id, ", a="reader_call", b="pass2_call", g="GROUP BY ALL")},
pe AS (SELECT t.subject_id, t.n, same / t.n AS po, coalesce(sum(na * nb), 0e0) / (t.n * t.n) AS pe FROM tot t LEFT JOIN (SELECT ma.subject_id, na, nb FROM ma JOIN mb ON ma.subject_id = mb.subject_id AND ma.c = mb.c) m USING (subject_id) GROUP BY t.subject_id, t.n, t.same),
k AS (SELECT subject_id, CASE WHEN abs(pe - 1) <= 1.001e-5 THEN CASE WHEN po = 1 THEN 1e0 END ELSE (po - pe) / (1 - pe) END AS kappa FROM pe)
SELECT subject_id, CASE WHEN kappa IS NULL THEN 'undefined' WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2e0 THEN 'slight' WHEN kappa <= 0.4e0 THEN 'fair' WHEN kappa <= 0.6e0 THEN 'moderate' WHEN kappa <= 0.8e0 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k""")
def b16(spark: SparkSession, d: str) -> DataFrame:
    k = rating.agreement(cards(spark, d), "reader_call", "pass2_call", ["subject_id"])
    return k.select("subject_id", L.agreement_band(F.col("cohen_kappa")).alias("band"))


@query("b18_safe_rates", f"""{WITH} SELECT subject_id, round(count(*) FILTER (toxic = 1) * 1e0 / nullif(count(*) FILTER (quality = 0), 0), 6) AS rate,
 round(100e0 * count(*) FILTER (quality = 0 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 2) AS pct FROM cards GROUP BY 1""")
def b18(spark: SparkSession, d: str) -> DataFrame:
    by = cards(spark, d).groupBy("subject_id").agg(
        F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("quality") == 0).alias("q"),
        F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("both"),
    )
    return by.select(
        "subject_id", F.round(L.safe_ratio(F.col("t"), F.col("q")), 6).alias("rate"), L.safe_percent(F.col("both"), F.col("t")).alias("pct")
    )


ROLES = {"flagged": "detector_flag", "model_conf": "confidence"}
CONF = "0.5e0 + (CASE WHEN n_chars > 5000 THEN 5000 ELSE n_chars END) / 1e4"
CATEGORY_SQL = f"""CASE WHEN reader_call = 'no_occlusion_signature' AND detector_flag AND model_call <> 'occlusion_signature_present' THEN 'detector_overcall'
 WHEN reader_call = 'no_occlusion_signature' AND detector_flag AND model_call = 'occlusion_signature_present' THEN 'both_machines_overcall'
 WHEN reader_call = 'occlusion_signature_present' AND NOT detector_flag AND model_call = 'no_occlusion_signature' THEN 'reader_only_present'
 WHEN reader_call = 'indeterminate' AND {CONF} >= 0.9e0 THEN 'reader_indeterminate'
 WHEN reader_call = 'occlusion_signature_present' AND detector_flag AND model_call = 'occlusion_signature_present' THEN 'all_agree_positive' END"""


def _categorised(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).withColumn("confidence", F.expr(CONF)).withColumn("category", L.disagreement_label(**ROLES))


@query("b19_disagreement_category", f"{WITH} SELECT card_id, {CATEGORY_SQL} AS category FROM cards")
def b19(spark: SparkSession, d: str) -> DataFrame:
    return _categorised(spark, d).select("card_id", "category")


@query("d35_pool_sizes", f"{WITH} SELECT {CATEGORY_SQL} AS category, count(*) AS n FROM cards GROUP BY 1 HAVING category IS NOT NULL")
def d35(spark: SparkSession, d: str) -> DataFrame:
    return _categorised(spark, d).where(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


TOP_FEATURES = ["n_chars", "confidence", "f3"]


@query("f12_top_n_per_category", f"""{WITH}, j AS (SELECT *, {CATEGORY_SQL} AS category, {CONF} AS confidence, CASE WHEN toxic = 0 THEN n_chars * 1e0 / (quality + 1) END AS f3, CASE WHEN quality = 1 THEN 'high' WHEN toxic = 1 THEN 'low' END AS conf_word FROM cards),
m AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(confidence) AS m2, stddev_pop(confidence) AS s2, avg(f3) AS m3, stddev_pop(f3) AS s3 FROM j),
z AS (SELECT j.*, (n_chars - m1) / s1 AS z1, (confidence - m2) / s2 AS z2, (f3 - m3) / s3 AS z3 FROM j, m WHERE category IS NOT NULL),
c AS (SELECT category, coalesce(avg(z1) FILTER (z3 IS NOT NULL), 0e0) AS c1, coalesce(avg(z2) FILTER (z3 IS NOT NULL), 0e0) AS c2, coalesce(avg(z3), 0e0) AS c3 FROM z GROUP BY 1),
dd AS (SELECT z.*, sqrt((z1 - c1) * (z1 - c1) + (z2 - c2) * (z2 - c2) + coalesce((z3 - c3) * (z3 - c3), 0e0)) AS dist FROM z JOIN c USING (category)),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE conf_word WHEN 'high' THEN 0 WHEN 'med' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, round(dist, 9), md5(concat_ws('|', card_id, '{SEED}')), card_id) AS k FROM dd)
SELECT category, card_id, k - 1 AS panel_index, round(dist, 6) AS centroid_distance FROM r WHERE k <= 3""")
def f12(spark: SparkSession, d: str) -> DataFrame:
    rows = _categorised(spark, d).withColumns({
        "f3": F.when(F.col("toxic") == 0, F.col("n_chars") * F.lit(1.0) / (F.col("quality") + 1)),
        "conf_word": F.when(F.col("quality") == 1, "high").when(F.col("toxic") == 1, "low"),
    })
    top = choose.top_per_category(rows, "category", TOP_FEATURES, "card_id", 3, "conf_word")
    return top.select("category", "card_id", "panel_index", "centroid_distance")


# --- joins ---------------------------------------------------------------------------------------------------

SOURCES_SQL = """man AS (SELECT CAST(doc_id AS VARCHAR) AS card_id FROM documents WHERE lang <> 'de'), rd AS (SELECT card_id, reader_call FROM cards WHERE reader_call <> 'indeterminate'),
mo AS (SELECT CAST(doc_id AS VARCHAR) AS card_id FROM documents WHERE n_chars >= 400)"""


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("card_id"), "lang", "n_chars")
    manifest = docs.where(F.col("lang") != "de").select("card_id", "lang")
    reader = cards(spark, d).where(F.col("reader_call") != V.INDETERMINATE).select("card_id", "reader_call")
    return manifest, reader, docs.where(F.col("n_chars") >= 400).select("card_id", "n_chars")


@query("c05_three_way_join", f"{WITH}, {SOURCES_SQL} SELECT card_id, reader_call FROM man JOIN rd USING (card_id) JOIN mo USING (card_id)")
def c05(spark: SparkSession, d: str) -> DataFrame:
    return rating.join_sources(*_sources(spark, d)).select("card_id", "reader_call")


@query("c05_three_way_join_drops", f"""{WITH}, {SOURCES_SQL} SELECT (SELECT count(*) FROM rd) AS n_reader, (SELECT count(*) FROM mo) AS n_model, (SELECT count(*) FROM man) AS n_manifest,
 (SELECT count(*) FROM man JOIN rd USING (card_id) JOIN mo USING (card_id)) AS n_joined,
 (SELECT count(*) FROM man WHERE card_id IN (SELECT card_id FROM mo) AND card_id NOT IN (SELECT card_id FROM rd)) AS n_dropped_reader,
 (SELECT count(*) FROM man WHERE card_id IN (SELECT card_id FROM rd) AND card_id NOT IN (SELECT card_id FROM mo)) AS n_dropped_model,
 (SELECT count(*) FROM rd WHERE card_id IN (SELECT card_id FROM mo) AND card_id NOT IN (SELECT card_id FROM man)) AS n_dropped_manifest""")
def c05_drops(spark: SparkSession, d: str) -> DataFrame:
    return rating.source_drops(*_sources(spark, d))


@query("s08_key_sets", f"""{WITH}, {SOURCES_SQL} (SELECT 'all three' AS part, count(*) AS n FROM (SELECT card_id FROM man INTERSECT SELECT card_id FROM rd INTERSECT SELECT card_id FROM mo))
UNION ALL SELECT 'manifest only', count(*) FROM (SELECT card_id FROM man EXCEPT SELECT card_id FROM rd EXCEPT SELECT card_id FROM mo)""")
def s08(spark: SparkSession, d: str) -> DataFrame:
    """Intersection and difference of key sets."""
    a, b, c = (x.select("card_id") for x in _sources(spark, d))
    both = a.intersect(b).intersect(c).agg(F.lit("all three").alias("part"), F.count(F.lit(1)).alias("n"))
    only = a.exceptAll(b).exceptAll(c).agg(F.lit("manifest only").alias("part"), F.count(F.lit(1)).alias("n"))
    return both.unionByName(only)


def _blind(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c = cards(spark, d)
    blind = F.concat(F.lit("blind_"), F.substring(F.sha2("card_id", 256), 1, 12))
    export = c.where(F.col("lang" if "lang" in c.columns else "stratum") != "de").select(blind.alias("blind_id"), F.col("pass2_call").alias("call"))
    return (
        export, c.select(blind.alias("blind_id"), "card_id", "stratum"),
        c.select("card_id", "subject_id", F.concat("stratum", F.lit("/"), "card_id").alias("image_path")),
        c.select("card_id", F.concat_ws("_", "subject_id", "card_id").alias("row_id")),
    )


@query("c06_deblind", f"""{WITH} SELECT 'blind_' || substr(sha256(card_id), 1, 12) AS blind_id, card_id, stratum, subject_id, stratum || '/' || card_id AS image_path, subject_id || '_' || card_id AS row_id, pass2_call AS call FROM cards WHERE stratum <> 'de'""")
def c06(spark: SparkSession, d: str) -> DataFrame:
    return rating.deblind(*_blind(spark, d)).select("blind_id", "card_id", "stratum", "subject_id", "image_path", "row_id", "call")


VARIANT_SQL = """can AS (SELECT subject_id || '_' || card_id AS row_id, reader_call AS call, n_chars >= 250 AS parsed_ok FROM cards WHERE n_chars < 9000),
br AS (SELECT card_id, stratum, CASE WHEN toxic = 0 OR quality = 0 THEN subject_id || '_' || card_id END AS row_id FROM cards),
var AS (SELECT 'v_detector' AS variant, card_id, detector_call AS call, true AS ok FROM cards UNION ALL SELECT 'v_model', card_id, model_call, model_ok FROM cards WHERE stratum <> 'fr' UNION ALL SELECT 'v_pass2', card_id, pass2_call, n_chars > 350 FROM cards),
pairs AS (SELECT v.variant, v.card_id, br.stratum, v.call AS v, v.ok AS v_ok, can.call AS c, can.parsed_ok AS c_ok FROM var v JOIN br USING (card_id) LEFT JOIN can USING (row_id))"""


def _variants(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = cards(spark, d)
    row = F.concat_ws("_", "subject_id", "card_id")
    canonical = c.where("n_chars < 9000").select(row.alias("row_id"), F.col("reader_call").alias("call"), (F.col("n_chars") >= 250).alias("parsed_ok"))
    bridge = c.select("card_id", "stratum", F.when((F.col("toxic") == 0) | (F.col("quality") == 0), row).alias("row_id"))
    one = lambda df, name, call, ok: df.select(F.lit(name).alias("variant"), "card_id", F.col(call).alias("call"), ok.alias("parsed_ok"))
    variants = one(c, "v_detector", "detector_call", F.lit(True)).unionByName(
        one(c.where(F.col("stratum") != "fr"), "v_model", "model_call", F.col("model_ok"))
    ).unionByName(one(c, "v_pass2", "pass2_call", F.col("n_chars") > 350))
    return variants, bridge, canonical


@query("c07_two_hop_pairs", f"{WITH}, {VARIANT_SQL} SELECT variant, card_id, stratum, v AS variant_call, c AS canonical_call FROM pairs")
def c07(spark: SparkSession, d: str) -> DataFrame:
    return rating.variant_pairs(*_variants(spark, d)).select("variant", "card_id", "stratum", "variant_call", "canonical_call")


@query("c08_ordered_lookup", f"""{WITH}, o AS (SELECT card_id, row_number() OVER (ORDER BY md5(concat_ws('|', card_id, '{SEED}')), card_id) - 1 AS pos FROM cards) SELECT pos, card_id, n_chars FROM o JOIN cards USING (card_id)""")
def c08(spark: SparkSession, d: str) -> DataFrame:
    from troughline.functions.keys import hash_position

    order = hash_position(cards(spark, d).select("card_id"), ["card_id"], SEED)
    return rating.ordered_lookup(order, cards(spark, d).select("card_id", "n_chars"), "card_id", "pos")


RERUN_SQL = """r1 AS (SELECT card_id AS row_id, CASE WHEN n_chars >= 300 THEN reader_call END AS call FROM cards WHERE stratum <> 'es'),
r2 AS (SELECT card_id AS row_id, CASE WHEN n_chars >= 350 THEN pass2_call END AS call FROM cards WHERE n_chars < 8000)"""


def _reruns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = cards(spark, d)
    first = c.where(F.col("stratum") != "es").select(F.col("card_id").alias("row_id"), F.when(F.col("n_chars") >= 300, F.col("reader_call")).alias("call"))
    second = c.where(F.col("n_chars") < 8000).select(F.col("card_id").alias("row_id"), F.when(F.col("n_chars") >= 350, F.col("pass2_call")).alias("call"))
    return first, second


@query("c09_unpaired_keys", f"""{WITH}, {RERUN_SQL} SELECT row_id, 'first' AS missing_from FROM r2 WHERE row_id NOT IN (SELECT row_id FROM r1)
UNION ALL SELECT row_id, 'second' FROM r1 WHERE row_id NOT IN (SELECT row_id FROM r2)""")
def c09(spark: SparkSession, d: str) -> DataFrame:
    return rating.unpaired(*_reruns(spark, d))


@query("c12_stratum_weights", f"""{WITH}, u AS (SELECT stratum, count(*) AS universe FROM cards GROUP BY 1), s AS (SELECT stratum, count(*) AS sampled FROM cards WHERE n_chars >= 700 GROUP BY 1)
SELECT card_id, stratum, round(universe * 1e0 / sampled, 6) AS weight FROM cards JOIN u USING (stratum) JOIN s USING (stratum) WHERE n_chars >= 700""")
def c12(spark: SparkSession, d: str) -> DataFrame:
    c = cards(spark, d).select("card_id", "stratum", "n_chars")
    sample = c.where("n_chars >= 700")
    return rounded(reweight.assign_weights(sample, reweight.stratum_weights(c, sample)).select("card_id", "stratum", "weight"), "weight")


LOG_SQL = f"""log AS (SELECT card_id, stratum, detector_call, CASE WHEN stratum <> 'fr' THEN model_call END AS language_model_call, CASE WHEN toxic = 0 THEN reader_call END AS pass1_call, pass2_call, CAST(n_chars AS VARCHAR) AS pass2_confidence FROM cards),
chg AS (SELECT *, pass1_call IS DISTINCT FROM pass2_call AS changed, CASE WHEN coalesce(pass1_call, '') = pass2_call THEN 'unchanged' WHEN pass2_call = 'occlusion_signature_present' THEN 'to_present'
 WHEN pass1_call = 'occlusion_signature_present' THEN 'from_present' WHEN pass2_call = 'indeterminate' THEN 'to_indeterminate' WHEN pass1_call = 'indeterminate' THEN 'from_indeterminate' ELSE 'other' END AS direction FROM log)"""


def _change_log(spark: SparkSession, d: str) -> DataFrame:
    c = cards(spark, d)
    return rating.change_log(
        c.select("card_id", "stratum", F.col("pass2_call").alias("call"), F.col("n_chars").cast("string").alias("confidence")),
        c.where("toxic = 0").select("card_id", F.col("reader_call").alias("pass1_call")),
        c.select("card_id", F.col("detector_flag").alias("is_occlusion_signature")),
        c.where("stratum <> 'fr'").select("card_id", F.upper("model_call").alias("call")),
    )


@query("c13_change_log", f"{WITH}, {LOG_SQL} SELECT * FROM chg")
def c13(spark: SparkSession, d: str) -> DataFrame:
    return _change_log(spark, d)


# --- counts and rates -------------------------------------------------------------------------------------------

@query("d05_call_rates", f"""{WITH} SELECT stratum, count(*) AS n_total, count(*) FILTER (model_ok) AS n_parsed, count(*) FILTER (model_ok AND model_call = 'indeterminate') + count(*) FILTER (NOT model_ok) AS n_uncallable,
 count(*) FILTER (model_ok AND model_call IN ('occlusion_signature_present', 'no_occlusion_signature')) AS n_callable, count(*) FILTER (model_ok AND model_call = 'occlusion_signature_present') AS n_present,
 round(count(*) FILTER (model_ok AND model_call IN ('occlusion_signature_present', 'no_occlusion_signature')) * 1e0 / count(*), 6) AS callable_rate,
 round((count(*) FILTER (model_ok AND model_call = 'indeterminate') + count(*) FILTER (NOT model_ok)) * 1e0 / count(*), 6) AS uncallable_rate,
 round(count(*) FILTER (model_ok AND model_call = 'occlusion_signature_present') * 1e0 / nullif(count(*) FILTER (model_ok AND model_call IN ('occlusion_signature_present', 'no_occlusion_signature')), 0), 6) AS headline_rate_per_callable
FROM cards GROUP BY 1""")
def d05(spark: SparkSession, d: str) -> DataFrame:
    rates = funnel.call_rates(cards(spark, d), "model_call", "model_ok", ("stratum",))
    return rounded(rates, "callable_rate", "uncallable_rate", "headline_rate_per_callable")


LONG_SQL = """long AS (SELECT card_id, subject_id, stratum, n_chars, 'detector' AS predictor, reader_call AS r, detector_call AS p, true AS ok, false AS can_fail FROM cards
 UNION ALL SELECT card_id, subject_id, stratum, n_chars, 'model', reader_call, model_call, model_ok, true FROM cards)"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    return rating.long_predictors(cards(spark, d), PREDICTORS, "reader_call", ["card_id", "subject_id", "stratum", "n_chars"])


@query("d06_confusion_zero_filled", f"""{WITH}, {LONG_SQL}, voc AS (SELECT pr.predictor, r.v AS reference_value, p.v AS predictor_value FROM (VALUES ('detector'), ('model')) pr(predictor),
 (VALUES ('occlusion_signature_present'), ('no_occlusion_signature'), ('indeterminate')) r(v), (VALUES ('occlusion_signature_present'), ('no_occlusion_signature'), ('indeterminate'), ('parse_failure')) p(v) WHERE predictor = 'model' OR p.v <> 'parse_failure'),
c AS (SELECT predictor, r, CASE WHEN can_fail AND NOT ok THEN 'parse_failure' ELSE p END AS pv, count(*) AS n FROM long GROUP BY ALL)
SELECT voc.predictor, reference_value, predictor_value, coalesce(n, 0) AS count FROM voc LEFT JOIN c ON voc.predictor = c.predictor AND reference_value = r AND predictor_value = pv""")
def d06(spark: SparkSession, d: str) -> DataFrame:
    return rating.confusion(_long(spark, d))


IND = {
    "precision": ("CASE WHEN {e} AND p = 'occlusion_signature_present' AND r = 'occlusion_signature_present' THEN {w} ELSE 0e0 END", "CASE WHEN {e} AND p = 'occlusion_signature_present' THEN {w} ELSE 0e0 END"),
    "recall": ("CASE WHEN {e} AND r = 'occlusion_signature_present' AND p = 'occlusion_signature_present' THEN {w} ELSE 0e0 END", "CASE WHEN {e} AND r = 'occlusion_signature_present' THEN {w} ELSE 0e0 END"),
    "specificity": ("CASE WHEN {e} AND r = 'no_occlusion_signature' AND p = 'no_occlusion_signature' THEN {w} ELSE 0e0 END", "CASE WHEN {e} AND r = 'no_occlusion_signature' THEN {w} ELSE 0e0 END"),
}
ELIGIBLE = "r IN ('occlusion_signature_present', 'no_occlusion_signature') AND p IN ('occlusion_signature_present', 'no_occlusion_signature') AND ok"
XY = {m: (f"x{i}", f"y{i}") for i, m in enumerate(rating.METRICS)}


def _sums_sql(by: str, source: str, where: str, w: str = "1e0", eligible: str = ELIGIBLE, own: str = "") -> str:
    cols = ", ".join(f"sum({x.format(e=eligible, w=w)}) AS x{i}, sum({y.format(e=eligible, w=w)}) AS y{i}" for i, (x, y) in enumerate(IND.values()))
    return f"{own}sums AS (SELECT {by}, subject_id AS cl, {cols} FROM {source} {where} GROUP BY ALL)"


def _metric_rows(by: str, extra: str = "CAST(sum({y}) AS BIGINT) AS n_used_for_metric", own: str = "") -> str:
    on = ", ".join(by.split(", "))
    return " UNION ALL ".join(
        f"SELECT {', '.join('s.' + c for c in by.split(', '))}, '{m}' AS metric, round(CASE WHEN sum({y}) > 0 THEN sum({x}) / sum({y}) END, 6) AS point_estimate, round(any_value(lo_{m}), 6) AS ci_low, round(any_value(hi_{m}), 6) AS ci_high, {extra.format(y=y)} FROM {own}sums s JOIN {own}ci USING ({on}) GROUP BY {', '.join('s.' + c for c in by.split(', '))}"
        for m, (x, y) in XY.items()
    )


METRIC_FLOATS = ["point_estimate", "ci_low", "ci_high"]


@query("d07_prf_long", f"{WITH}, {LONG_SQL}, {_sums_sql('predictor', 'long', 'WHERE ' + ELIGIBLE)}, {draws_sql('sums', 'predictor', XY)} {_metric_rows('predictor')}")
def d07(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rating.binary_metrics(_long(spark, d), "subject_id", replicates=REPS), *METRIC_FLOATS)


@query("d08_uncallable_rates", f"""{WITH}, {LONG_SQL}, ind AS (SELECT predictor, subject_id, NOT ok AS bad, ok AND coalesce(p = 'indeterminate', false) AS und FROM long),
sums AS (SELECT predictor, subject_id AS cl, count(*) FILTER (bad OR und) * 1e0 AS x0, count(*) * 1e0 AS y0 FROM ind GROUP BY 1, 2), {draws_sql('sums', 'predictor', {'mean': ('x0', 'y0')})},
c AS (SELECT predictor, count(*) FILTER (und) AS indeterminate_count, count(*) FILTER (bad) AS parse_failure_count, count(*) AS total_n, round(count(*) FILTER (bad OR und) * 1e0 / count(*), 6) AS indeterminate_rate FROM ind GROUP BY 1)
SELECT c.*, round(lo_mean, 6) AS ci_low, round(hi_mean, 6) AS ci_high FROM c JOIN ci USING (predictor)""")
def d08(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rating.uncallable_rates(_long(spark, d), "subject_id", replicates=REPS), "indeterminate_rate", "ci_low", "ci_high")


def _classed(spark: SparkSession, d: str) -> DataFrame:
    c = cards(spark, d).where(F.col("model_call").isNotNull())
    recode = lambda col: L.recode_strict(F.col(col), V.CALL_CLASSES, "call")
    return c.select("card_id", recode("reader_call").alias("reader"), recode("detector_call").alias("detector"), recode("model_call").alias("model"))


CLASS_SQL = "cls AS (SELECT card_id, " + ", ".join(
    f"CASE {c}_call WHEN 'occlusion_signature_present' THEN 'present' WHEN 'indeterminate' THEN 'indeterminate' ELSE 'absent' END AS {c}" for c in ("reader", "detector", "model")
) + " FROM cards WHERE model_call IS NOT NULL)"


@query("d09_cells_3way", f"{WITH}, {CLASS_SQL} SELECT reader, detector, model, count(*) AS n FROM cls GROUP BY 1, 2, 3")
def d09(spark: SparkSession, d: str) -> DataFrame:
    return rating.three_way_cells(_classed(spark, d), ["reader", "detector", "model"])


@query("d10_marginals", f"{WITH}, {CLASS_SQL} SELECT 'reader' AS rater, reader AS call, count(*) AS n FROM cls GROUP BY 2 UNION ALL SELECT 'model', model, count(*) FROM cls GROUP BY 2")
def d10(spark: SparkSession, d: str) -> DataFrame:
    return rating.marginals(_classed(spark, d), ["reader", "model"])


@query("d11_percent_agreement", f"{WITH} SELECT stratum, count(*) AS n, round(avg(CASE WHEN reader_call = pass2_call THEN 1e0 ELSE 0e0 END), 6) AS percent_agreement FROM cards GROUP BY 1")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rating.agreement(cards(spark, d), "reader_call", "pass2_call", ["stratum"]).select("stratum", "n", "percent_agreement"), "percent_agreement")


def _kappa_value(a: str, b: str) -> str:
    return f"""{KAPPA_SQL.format(by="", a=a, b=b, g="")}, kap AS (SELECT n, same / n AS po, (SELECT sum(na * nb) FROM ma JOIN mb USING (c)) / (n * n) AS pe FROM tot)"""


@query("d12_kappa", f"{WITH}, {_kappa_value('reader_call', 'pass2_call')} SELECT round((po - pe) / (1 - pe), 6) AS cohen_kappa FROM kap")
def d12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rating.agreement(cards(spark, d), "reader_call", "pass2_call").select("cohen_kappa"), "cohen_kappa")


@query("d13_agreement_summary", f"""{WITH}, {_kappa_value('reader_call', 'detector_call')} SELECT n, round(po, 6) AS percent_agreement, round((po - pe) / (1 - pe), 6) AS cohen_kappa,
 (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT c FROM ma UNION SELECT c FROM mb)) AS categories FROM kap""")
def d13(spark: SparkSession, d: str) -> DataFrame:
    out = rating.agreement(cards(spark, d), "reader_call", "detector_call").withColumn("categories", F.array_join("categories", ","))
    return rounded(out, "percent_agreement", "cohen_kappa")


BAND = "CASE WHEN {k} < 0 THEN 'poor' WHEN {k} <= 0.2e0 THEN 'slight' WHEN {k} <= 0.4e0 THEN 'fair' WHEN {k} <= 0.6e0 THEN 'moderate' WHEN {k} <= 0.8e0 THEN 'substantial' ELSE 'almost perfect' END"


@query("d14_reliability", f"""{WITH}, {_kappa_value('reader_call', 'pass2_call')},
bin AS (SELECT CASE WHEN reader_call = 'occlusion_signature_present' THEN 1 ELSE 0 END AS a, CASE WHEN pass2_call = 'occlusion_signature_present' THEN 1 ELSE 0 END AS b FROM cards),
bt AS (SELECT count(*) AS n, sum(CASE WHEN a = b THEN 1e0 ELSE 0e0 END) / count(*) AS po, (sum(a) * 1e0 * sum(b) + sum(1 - a) * 1e0 * sum(1 - b)) / (count(*) * count(*)) AS pe FROM bin),
sums AS (SELECT subject_id AS cl, sum(CASE WHEN reader_call = pass2_call THEN 1e0 ELSE 0e0 END) AS x0, count(*) * 1e0 AS y0 FROM cards GROUP BY 1), {draws_sql('sums', '', {'mean': ('x0', 'y0')})},
f AS (SELECT kap.n, (kap.po - kap.pe) / (1 - kap.pe) AS k3, (bt.po - bt.pe) / (1 - bt.pe) AS k2, kap.po, lo_mean, hi_mean FROM kap, bt, ci)
SELECT n, round(k3, 6) AS kappa_3class, round(k2, 6) AS kappa_binary, round(po, 6) AS percent_agreement, round(lo_mean, 6) AS agreement_ci_low, round(hi_mean, 6) AS agreement_ci_high, {BAND.format(k='k3')} AS band_3class, {BAND.format(k='k2')} AS band_binary FROM f""")
def d14(spark: SparkSession, d: str) -> DataFrame:
    out = rating.reliability(cards(spark, d), "reader_call", "pass2_call", "subject_id", REPS)
    return rounded(out, "kappa_3class", "kappa_binary", "percent_agreement", "agreement_ci_low", "agreement_ci_high")


CELLS = [(x, y) for x in V.CALLS for y in V.CALLS]
PAIRED_SQL = f"""{RERUN_SQL}, pr AS (SELECT r1.call AS a, r2.call AS b FROM r1 JOIN r2 USING (row_id)),
wide AS (SELECT (SELECT count(*) FROM r1) AS n_first, (SELECT count(*) FROM r2) AS n_rerun, (SELECT count(*) FROM pr) AS n_paired, (SELECT count(*) FROM pr WHERE a = b) AS n_agree,
 (SELECT 100e0 * count(*) FILTER (a = b) / count(*) FROM pr) AS overall_agreement_pct, (SELECT 100e0 * count(*) FILTER (call IS NULL) / count(*) FROM r1) AS parse_failure_rate_first_pct,
 (SELECT 100e0 * count(*) FILTER (call IS NULL) / count(*) FROM r2) AS parse_failure_rate_rerun_pct, (SELECT count(*) FROM r2 WHERE row_id NOT IN (SELECT row_id FROM r1)) AS n_missing_from_first,
 (SELECT count(*) FROM r1 WHERE row_id NOT IN (SELECT row_id FROM r2)) AS n_missing_from_rerun, {", ".join(f"(SELECT count(*) FROM pr WHERE a = '{x}' AND b = '{y}') AS " + f'"confusion[{x}->{y}]"' for x, y in CELLS)})"""
PAIRED_COLS = ["n_first", "n_rerun", "n_paired", "n_agree", "overall_agreement_pct", "parse_failure_rate_first_pct", "parse_failure_rate_rerun_pct", "n_missing_from_first", "n_missing_from_rerun", *[f"confusion[{x}->{y}]" for x, y in CELLS]]


@query("d15_paired_agreement", f"{WITH}, {PAIRED_SQL} SELECT * FROM wide")
def d15(spark: SparkSession, d: str) -> DataFrame:
    return rating.paired_agreement(*_reruns(spark, d))


@query("d16_tidy_metrics", f"{WITH}, {PAIRED_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(CAST(\"{c}\" AS DOUBLE), 6) AS value FROM wide" for c in PAIRED_COLS))
def d16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rating.tidy(rating.paired_agreement(*_reruns(spark, d))), "value")


CONC_SQL = """conc AS (SELECT variant, count(*) AS n_total, count(*) FILTER (v IS NOT NULL AND c IS NOT NULL) AS n_compare, count(*) FILTER (v = c) AS n_matched, count(*) FILTER (v = 'occlusion_signature_present') AS var_present,
 count(*) FILTER (v = 'no_occlusion_signature') AS var_absent, count(*) FILTER (v = 'indeterminate') AS var_indeterminate, count(*) FILTER (NOT v_ok) AS var_parse_failure, count(*) FILTER (NOT c_ok) AS canon_parse_fail_in_sub,
 count(*) FILTER (v = 'occlusion_signature_present' AND c = 'no_occlusion_signature') AS var_pos_canon_neg, count(*) FILTER (v = 'no_occlusion_signature' AND c = 'occlusion_signature_present') AS var_neg_canon_pos FROM pairs GROUP BY 1),
conc2 AS (SELECT *, round(100e0 * n_matched / nullif(n_compare, 0), 2) AS concordance_pct, round(100e0 * var_present / nullif(var_present + var_absent + var_indeterminate, 0), 2) AS var_positive_rate_pct, n_compare - n_matched - var_pos_canon_neg - var_neg_canon_pos AS other_mismatch FROM conc)"""


@query("d17_concordance_by_variant", f"{WITH}, {VARIANT_SQL}, {CONC_SQL} SELECT * FROM conc2")
def d17(spark: SparkSession, d: str) -> DataFrame:
    return rating.concordance(rating.variant_pairs(*_variants(spark, d)))


@query("d18_concordance_by_stratum", f"{WITH}, {VARIANT_SQL} SELECT variant, stratum, count(*) AS n, count(*) FILTER (v = c) AS matched, round(100e0 * count(*) FILTER (v = c) / count(*), 1) AS conc_pct FROM pairs WHERE v IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2")
def d18(spark: SparkSession, d: str) -> DataFrame:
    return rating.concordance_by_stratum(rating.variant_pairs(*_variants(spark, d)))


@query("d19_canonical_over_bridge", f"""{WITH}, {VARIANT_SQL} SELECT count(*) AS n, count(*) FILTER (call = 'occlusion_signature_present') AS present, count(*) FILTER (call = 'no_occlusion_signature') AS absent, count(*) FILTER (call = 'indeterminate') AS indeterminate,
 round(100e0 * count(*) FILTER (call = 'occlusion_signature_present') / count(*), 2) AS positive_rate_pct FROM br JOIN can USING (row_id)""")
def d19(spark: SparkSession, d: str) -> DataFrame:
    _, bridge, canonical = _variants(spark, d)
    return rating.canonical_over_bridge(bridge, canonical)


@query("d25_net_change", f"""{WITH}, {LOG_SQL}, c AS (SELECT count(*) FILTER (direction = 'to_present') AS to_present, count(*) FILTER (direction = 'from_present') AS from_present, count(*) FILTER (direction NOT IN ('to_present', 'from_present', 'unchanged')) AS other_changed,
 count(*) FILTER (direction = 'unchanged') AS unchanged FROM chg) SELECT *, to_present - from_present AS net_present_delta FROM c""")
def d25(spark: SparkSession, d: str) -> DataFrame:
    return rating.net_change(_change_log(spark, d))


@query("d26_change_by_stratum", f"{WITH}, {LOG_SQL} SELECT stratum, count(*) AS n_sampled, count(*) FILTER (changed) AS n_changed FROM chg GROUP BY 1")
def d26(spark: SparkSession, d: str) -> DataFrame:
    return rating.change_by_stratum(_change_log(spark, d))


TESTS, REFS = {"detector": "detector_call", "language_model": "model_call"}, {"pass1": "reader_call", "pass2": "pass2_call"}
TWO_SQL = "two AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS index_test, '{r}' AS reference, subject_id, {tc} AS p, {rc} AS r, true AS ok FROM cards" for t, tc in TESTS.items() for r, rc in REFS.items()
) + ")"
TWO_CTES = f"{TWO_SQL}, {_sums_sql('index_test, reference', 'two', 'WHERE ' + ELIGIBLE)}, {draws_sql('sums', 'index_test, reference', XY)}"


def _two(spark: SparkSession, d: str) -> DataFrame:
    return rating.two_reference_metrics(cards(spark, d), TESTS, REFS, "subject_id", REPS)


@query("d27_two_reference_metrics", f"{WITH}, {TWO_CTES} {_metric_rows('index_test, reference')}")
def d27(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_two(spark, d), *METRIC_FLOATS)


def _side(ref: str) -> str:
    return ", ".join(f"max(CASE WHEN reference = '{ref}' THEN {c} END) AS {ref}_{n}" for c, n in (("point_estimate", "point"), ("ci_low", "ci_low"), ("ci_high", "ci_high")))


@query("d28_reference_delta", f"""{WITH}, {TWO_CTES}, mm AS ({_metric_rows('index_test, reference')}), w AS (SELECT index_test, metric, {_side('pass1')}, {_side('pass2')} FROM mm GROUP BY 1, 2)
SELECT *, round(pass2_point - pass1_point, 5) AS delta FROM w""")
def d28(spark: SparkSession, d: str) -> DataFrame:
    delta = rating.reference_delta(rounded(_two(spark, d), *METRIC_FLOATS))
    return delta.withColumn("delta", F.round("delta", 5))


# --- bootstrap and weights -------------------------------------------------------------------------------------------

BOOT_SQL = "sums AS (SELECT stratum AS grp, subject_id AS cl, sum(CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END) AS x0, count(*) * 1e0 AS y0, sum(toxic) * 1e0 AS x1, sum(quality) * 1e0 AS y1, count(*) AS n FROM cards GROUP BY 1, 2)"


@query("e01_boot_mean_ci", f"""{WITH}, {BOOT_SQL}, {draws_sql('sums', 'grp', {'mean': ('x0', 'y0')}, MEAN_REPS)}
SELECT grp AS stratum, CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_clusters, round(sum(x0) / sum(y0), 6) AS point, round(any_value(lo_mean), 6) AS ci_low, round(any_value(hi_mean), 6) AS ci_high FROM sums JOIN ci USING (grp) GROUP BY 1""")
def e01(spark: SparkSession, d: str) -> DataFrame:
    out = bootstrap.mean_interval(cards(spark, d), (F.col("quality") == 1).cast("double"), "subject_id", ["stratum"], MEAN_REPS)
    return rounded(out.select("stratum", "n_obs", "n_clusters", "point", "ci_low", "ci_high"), "point", "ci_low", "ci_high")


ORDER_BOOT = "SELECT o_custkey AS c, CAST(o_custkey AS VARCHAR) AS cl, count(*) FILTER (o_orderstatus = 'F') * 1e0 AS x0, count(*) * 1e0 AS y0 FROM orders GROUP BY 1"


@query("e02_boot_ratio_ci", f"""WITH sums AS (SELECT cl, x0, y0 FROM ({ORDER_BOOT})), {draws_sql('sums', '', {'ratio': ('x0', 'y0')})}
SELECT count(*) AS n_clusters, round(sum(x0) / sum(y0), 6) AS point, round(any_value(lo_ratio), 6) AS ci_low, round(any_value(hi_ratio), 6) AS ci_high FROM sums, ci""")
def e02(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    done = (F.col("o_orderstatus") == "F").cast("double")
    out = bootstrap.ratio_intervals(orders, "o_custkey", {"share_done": (done, F.lit(1.0))}, replicates=REPS)
    return rounded(out.select("n_clusters", "point", "ci_low", "ci_high"), "point", "ci_low", "ci_high")


@query("e03_boot_statistic_ci", f"""{WITH}, sums AS (SELECT DISTINCT subject_id AS cl FROM cards), numbered AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', cl, '{SEED}')), cl) - 1 AS pos, count(*) OVER () AS k FROM sums),
draw AS ({draw_sql('numbered', REPS, SEED)}),
reps AS (SELECT rep, median(n_chars) AS s FROM draw JOIN numbered ON pick = pos JOIN cards ON subject_id = cl GROUP BY 1)
SELECT (SELECT median(n_chars) FROM cards) AS point, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high, (SELECT count(*) FROM cards) AS n_obs, (SELECT count(*) FROM sums) AS n_clusters, count(s) AS n_replicates_used FROM reps""")
def e03(spark: SparkSession, d: str) -> DataFrame:
    out = bootstrap.quantile_interval(cards(spark, d), "n_chars", "subject_id", 0.5, REPS)
    return rounded(out, "ci_low", "ci_high")


@query("e04_metric_indicators", f"""{WITH}, {LONG_SQL} SELECT card_id, predictor, """ + ", ".join(f"{x.format(e=ELIGIBLE, w='1e0')} AS num_{m}, {y.format(e=ELIGIBLE, w='1e0')} AS den_{m}" for m, (x, y) in IND.items()) + " FROM (SELECT * REPLACE (CASE WHEN ok THEN p ELSE 'parse_failure' END AS p) FROM long)")
def e04(spark: SparkSession, d: str) -> DataFrame:
    call = F.when(F.col("parsed_ok"), F.col("predictor_call")).otherwise(F.lit(V.PARSE_FAILURE))
    ind = rating.metric_indicators(F.col("reference_call"), call)
    return _long(spark, d).select(
        "card_id", "predictor", *[c.alias(f"{a}_{m}") for m, pair in ind.items() for a, c in zip(("num", "den"), pair)]
    )


WEIGHT_SQL = """u AS (SELECT stratum, count(*) AS universe FROM cards GROUP BY 1), s0 AS (SELECT stratum, count(*) AS sampled FROM cards WHERE n_chars >= 700 GROUP BY 1),
wt AS (SELECT stratum, universe, sampled, universe * 1e0 / sampled AS weight FROM u JOIN s0 USING (stratum)), lw AS (SELECT l.*, weight FROM long l JOIN wt USING (stratum) WHERE n_chars >= 700)"""


def _weighted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = cards(spark, d).select("card_id", "stratum", "n_chars")
    weights = reweight.stratum_weights(c, c.where("n_chars >= 700"))
    return reweight.assign_weights(_long(spark, d).where("n_chars >= 700"), weights), weights


HT_ROWS = " UNION ALL ".join(
    f"SELECT predictor, '{m}' AS metric, round(sum({x.format(e=ELIGIBLE, w='weight')}) / nullif(sum({y.format(e=ELIGIBLE, w='weight')}), 0), 6) AS point, round(sum({y.format(e=ELIGIBLE, w='weight')}), 6) AS weighted_denominator FROM lw GROUP BY 1"
    for m, (x, y) in IND.items()
)


@query("e05_ht_metric", f"{WITH}, {LONG_SQL}, {WEIGHT_SQL} {HT_ROWS}")
def e05(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reweight.weighted_metrics(_weighted(spark, d)[0]), "point", "weighted_denominator")


@query("e06_ht_metric_ci", f"""{WITH}, {LONG_SQL}, {WEIGHT_SQL}, {_sums_sql('predictor', 'lw', '', 'weight')}, {draws_sql('sums', 'predictor', XY)} {_metric_rows('predictor', 'round(sum({y}), 6) AS weighted_denominator')}""")
def e06(spark: SparkSession, d: str) -> DataFrame:
    out = reweight.weighted_intervals(_weighted(spark, d)[0], "subject_id", replicates=REPS)
    return rounded(out.select("predictor", "metric", *METRIC_FLOATS, "weighted_denominator"), *METRIC_FLOATS, "weighted_denominator")


@query("e07_stratum_weight_table", f"{WITH}, {LONG_SQL}, {WEIGHT_SQL} SELECT stratum, universe, sampled, round(weight, 6) AS weight FROM wt")
def e07(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_weighted(spark, d)[1], "weight")


@query("e08_partition_coverage", f"""{WITH}, {LONG_SQL}, {WEIGHT_SQL}, c AS (SELECT sum(universe) AS cov, (SELECT count(*) FROM documents) AS ev FROM wt)
SELECT 'stratum' AS row_kind, stratum AS name, universe, sampled, round(weight, 6) AS weight FROM wt UNION ALL SELECT 'uncovered_remainder', 'no label', CAST(ev - cov AS BIGINT), 0, NULL FROM c UNION ALL SELECT 'coverage', 'covered / evaluable', CAST(cov AS BIGINT), ev, round(cov * 1e0 / ev, 6) FROM c""")
def e08(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "documents").agg(F.count(F.lit(1)))
    return rounded(reweight.partition_coverage(_weighted(spark, d)[1], total, "no label"), "weight")


CARDS_COUNT = "CAST(sum({y}) AS BIGINT)"
POP_ROWS = " UNION ALL ".join(
    f"SELECT s.predictor, '{m}' AS metric, 'population' AS estimate_kind, round(sum(s.{x}) / nullif(sum(s.{y}), 0), 6) AS point_estimate, round(any_value(lo_{m}), 6) AS ci_low, round(any_value(hi_{m}), 6) AS ci_high, "
    f"(SELECT CAST(sum({IND[m][1].format(e=ELIGIBLE, w='1e0')}) AS BIGINT) FROM lw WHERE lw.predictor = s.predictor) AS n_eligible_cards, round(sum(s.{y}), 6) AS weighted_denominator FROM sums s JOIN ci USING (predictor) GROUP BY 1"
    for m, (x, y) in XY.items()
)
POP_SQL = f"{WITH}, {LONG_SQL}, {WEIGHT_SQL}, {_sums_sql('predictor', 'lw', '', 'weight')}, {draws_sql('sums', 'predictor', XY)}"
POP_FLOATS = [*METRIC_FLOATS, "weighted_denominator"]


@query("e09_population_table", f"{POP_SQL} {POP_ROWS}")
def e09(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reweight.weighted_intervals(_weighted(spark, d)[0], "subject_id", replicates=REPS), *POP_FLOATS)


# The sample side: clusters of the eligible, unweighted rows.
SAMPLE_SQL = f"{_sums_sql('predictor', 'lw', 'WHERE ' + ELIGIBLE, own='s_')}, {draws_sql('s_sums', 'predictor', XY, own='s_')}"
SAMPLE_ROWS = _metric_rows("predictor", "CAST(sum({y}) AS BIGINT) AS n_eligible_cards", own="s_")


@query("d34_sample_and_population", f"""{POP_SQL}, {SAMPLE_SQL}, pop AS ({POP_ROWS}), sample AS ({SAMPLE_ROWS})
SELECT predictor, metric, estimate_kind, point_estimate, ci_low, ci_high, n_eligible_cards, weighted_denominator FROM pop
UNION ALL SELECT predictor, metric, 'gallery', point_estimate, ci_low, ci_high, n_eligible_cards, NULL FROM sample""")
def d34(spark: SparkSession, d: str) -> DataFrame:
    long, _ = _weighted(spark, d)
    population = reweight.weighted_intervals(long, "subject_id", replicates=REPS)
    sample = rating.binary_metrics(long, "subject_id", replicates=REPS)
    return rounded(reweight.sample_and_population(sample, population), *POP_FLOATS)


# --- checks and summaries ---------------------------------------------------------------------------------------------

RENDER_SQL = "rpairs AS (SELECT * FROM pairs WHERE stratum <> 'en'), r" + CONC_SQL.replace("FROM pairs", "FROM rpairs").replace("conc2 AS", "rconc2 AS").replace("FROM conc)", "FROM rconc)")
REF_SQL = "ref AS (SELECT round(100e0 * count(*) FILTER (call = 'occlusion_signature_present') / nullif(count(*), 0), 2) AS rate, count(*) AS n FROM br JOIN can USING (row_id) WHERE call IS NOT NULL)"


@query("d36_robustness_rows", f"""{WITH}, {VARIANT_SQL}, {CONC_SQL}, {RENDER_SQL}, {REF_SQL}, {PAIRED_SQL} SELECT 'determinism' AS analysis, printf('%.0f%% paired agreement (%d/%d)', overall_agreement_pct, n_agree, n_paired) AS result FROM wide
UNION ALL SELECT 'prompt sensitivity', 'Concordance: ' || string_agg(printf('%s %.1f%%', variant, round(concordance_pct, 1)), ', ' ORDER BY variant) || '. Positive rate: ' || string_agg(printf('%s %.0f%%', variant, round(var_positive_rate_pct)), ', ' ORDER BY variant)
 || ' (reference ' || (SELECT printf('%.0f%% positive over %d', round(rate), n) FROM ref) || ').' FROM conc2
UNION ALL SELECT 'render sensitivity', 'Concordance: ' || string_agg(printf('%s %.1f%%', variant, round(concordance_pct, 1)), ', ' ORDER BY variant) || '.' FROM rconc2""")
def d36(spark: SparkSession, d: str) -> DataFrame:
    rerun = rating.tidy(rating.paired_agreement(*_reruns(spark, d)))
    variants, bridge, canonical = _variants(spark, d)
    pairs = rating.variant_pairs(variants, bridge, canonical)
    rendered = pairs.where("stratum <> 'en'")  # here the cards outside one stratum stand for those rendered on the fly
    return quality.robustness_rows(rerun, rating.concordance(pairs), rating.canonical_over_bridge(bridge, canonical), rating.concordance(rendered))


@query("j07_drift_check", f"""{WITH}, {VARIANT_SQL}, {CONC_SQL}, exp AS (SELECT stratum AS variant, 50e0 AS e FROM (VALUES ('v_detector'), ('v_model'), ('v_gone')) t(stratum))
SELECT variant, e AS expected, concordance_pct AS observed, coalesce(abs(concordance_pct - e) <= 20e0, false) AS ok FROM exp LEFT JOIN conc2 USING (variant)""")
def j07(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([(v, 50.0) for v in ("v_detector", "v_model", "v_gone")], "variant string, concordance_pct double")
    return quality.drift(rating.concordance(rating.variant_pairs(*_variants(spark, d))), expected, "variant", "concordance_pct", 20.0)


@query("j08_cardinality", f"""{WITH}, {CLASS_SQL} SELECT 'row count as expected' AS "check", (SELECT count(*) FROM cls) = (SELECT count(*) FROM labels) AS ok
UNION ALL SELECT 'no null in reader', count(*) FILTER (reader IS NULL) = 0 FROM cls UNION ALL SELECT 'no null in model', count(*) FILTER (model IS NULL) = 0 FROM cls""")
def j08(spark: SparkSession, d: str) -> DataFrame:
    return quality.cardinality(_classed(spark, d), table(spark, d, "labels").agg(F.count(F.lit(1))), ["reader", "model"])
