"""Quality classifier: Bradley-Terry ranking of documents from preference pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troughline.functions.keys import hash_position
from troughline.llm.common import BLANK, keep, text_of

#: Partners that each row of the larger class meets; both classes grow with the labels, so the pairs do too.
PARTNERS = 4
#: Candidate thresholds are this many even quantiles of the training scores.
QUANTILES = 400
SEED = 29


def _count(text: Column, members: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, members, ""))


def text_features(text: Column) -> dict[str, Column]:
    """Shares and sizes that tell prose from junk, from the whole text; an empty text gives zeros."""
    n = F.length(text)
    words = F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n_words, n_lines = F.size(words), F.size(lines)
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    return {
        "log_chars": F.log1p(n), "log_words": F.log1p(n_words),
        "upper": share(_count(text, "\\p{Lu}+"), n), "letters": share(_count(text, "\\p{L}+"), n),
        "digits": share(_count(text, "\\p{N}+"), n), "stops": share(_count(text, "[.,]+"), n_words),
        "marks": share(_count(text, "[!?;:]+"), n_words), "symbols": share(_count(text, "[|<>{}#*%=_~@$&/\\\\^]+"), n_words),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), n_lines),
        "words_per_line": F.log1p(share(n_words, n_lines)), "chars_per_word": F.log1p(share(n, n_words)),
    }


FEATURES = (
    "log_chars", "log_words", "upper", "letters", "digits", "stops", "marks", "symbols", "distinct_words", "distinct_lines",
    "words_per_line", "chars_per_word",
)


def featurize(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the feature columns `f_*`. Squares let a linear score prefer middle values."""
    named = docs.withColumn("_text", text_of(text))
    wide = named.withColumns({f"f_{k}": v.cast("double") for k, v in text_features(F.col("_text")).items()}).drop("_text")
    return wide.withColumns({f"f_{k}2": F.col(f"f_{k}") * F.col(f"f_{k}") for k in FEATURES})


COLUMNS = tuple(f"f_{k}{s}" for k in FEATURES for s in ("", "2"))


@dataclass(frozen=True)
class Ranker:
    """Utilities `sum(weight * (feature - mean) / scale)`, and the utility at which a document counts as good."""

    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    quantile: float

    def utility(self) -> Column:
        total = F.lit(0.0)
        for name, mean, scale, weight in zip(COLUMNS, self.means, self.scales, self.weights):
            total = total + (F.col(name) - mean) * (weight / scale)
        return total

    def score(self) -> Column:
        """Bradley-Terry chance of beating a document at the threshold; 0.5 and more is good."""
        return 1 / (1 + F.exp(-F.greatest(F.least(self.utility() - self.threshold, F.lit(500.0)), F.lit(-500.0))))


def preference_pairs(labelled: DataFrame, label: str, key: str, partners: int = PARTNERS) -> DataFrame:
    """Arrays `better`, `worse` of features: every row of the larger class with `partners` rows of the smaller.

    The smaller class is numbered densely in hash order and a row's partners are consecutive
    numbers from a hashed start, so partners are used evenly and the pairs grow with the labels.
    """
    n_good, n_bad = labelled.agg(
        F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1))
    ).first()
    many, few, n_few = (1, 0, n_bad) if n_good >= n_bad else (0, 1, n_good)
    x = F.array(*COLUMNS)
    side = lambda v: labelled.where(F.col(label) == v)
    numbered = hash_position(side(few).select(key, x.alias("x_few")), [key], SEED).select(F.col("pos").alias("at"), "x_few")
    start = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(max(n_few, 1)))
    asking = side(many).select(x.alias("x_many"), start.alias("_s"), F.xxhash64(key, F.lit(SEED + 1)).alias("turn")).withColumn(
        "at", F.explode(F.sequence(F.col("_s"), F.col("_s") + F.lit(partners - 1)))
    ).withColumn("at", F.pmod("at", F.lit(max(n_few, 1))))
    met = asking.join(numbered, "at")
    return met.select(
        F.col("x_many" if many else "x_few").alias("better"), F.col("x_few" if many else "x_many").alias("worse"), "turn"
    )


def fit(labelled: DataFrame, label: str = "quality", key: str = "doc_id", partners: int = PARTNERS) -> Ranker:
    """Learn the weights by logistic loss on feature differences of all preference pairs, then the threshold.

    `labelled` holds feature columns and a label (1 good, 0 bad, others ignored). Training runs on
    the cluster; the driver sees sums, weights and one histogram of `QUANTILES` cells. The
    threshold is the score quantile with the best mean of both classes' accuracies. With no pair
    at all every weight is zero and every score one half.
    """
    rows = labelled.where(F.col(label).isin(0, 1))
    stats = rows.agg(*[f(c).alias(f"{n}{c}") for c in COLUMNS for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means = tuple(stats[f"m{c}"] or 0.0 for c in COLUMNS)
    scales = tuple(stats[f"s{c}"] or 1.0 for c in COLUMNS)
    pairs = preference_pairs(rows, label, key, partners)
    # A pair and its mirror say the same; turning every other one round gives the learner both classes.
    sign = F.when(F.pmod("turn", F.lit(2)) == 0, 1.0).otherwise(-1.0)
    divide = F.array(*[F.lit(s) for s in scales])
    difference = F.zip_with(F.zip_with("better", "worse", lambda a, b: a - b), divide, lambda d, s: d / s)
    examples = keep(pairs.withColumn("sign", sign).select(
        F.transform(difference, lambda d: d * F.col("sign")).alias("x"), (F.col("sign") > 0).cast("double").alias("label")
    ), "pairs")
    if examples.select("label").distinct().count() < 2:
        return Ranker(means, scales, (0.0,) * len(COLUMNS), 0.0, 0.0)
    learner = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-4, maxIter=60, tol=1e-7)
    weights = tuple(float(w) for w in learner.fit(examples.select(array_to_vector("x").alias("features"), "label")).coefficients)
    return _with_threshold(rows, label, Ranker(means, scales, weights, 0.0, 0.0))


def _with_threshold(rows: DataFrame, label: str, ranker: Ranker) -> Ranker:
    scored = rows.select(ranker.utility().alias("u"), label)
    grid = [i / QUANTILES for i in range(1, QUANTILES)]
    cuts = scored.agg(F.percentile_approx("u", grid, 100 * QUANTILES)).first()[0]
    passed = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("u")))
    cells = scored.groupBy(passed.alias("cell")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("good"), F.count(F.when(F.col(label) == 0, 1)).alias("bad"),
        F.min("u").alias("low"), F.max("u").alias("high"),
    ).orderBy("cell").collect()
    n_good, n_bad = sum(c.good for c in cells), sum(c.bad for c in cells)
    best, below_good, below_bad = (-1.0, 0.0, 0.0), 0, 0
    for before, after in zip(cells, cells[1:]):
        below_good, below_bad = below_good + before.good, below_bad + before.bad
        balance = below_bad / n_bad + (n_good - below_good) / n_good
        best = max(best, (balance, (below_good + below_bad) / (n_good + n_bad), (before.high + after.low) / 2))
    return Ranker(ranker.means, ranker.scales, ranker.weights, best[2], best[1]) if best[0] >= 0 else ranker


def learn(features: DataFrame, labels: DataFrame, train: Column, key: str, label: str) -> Ranker:
    """Ranker from the rows of a feature table where `train` holds and that have a label; only features move."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    labelled = features.where(train).select(F.col(key).alias("_id"), *COLUMNS).join(known, F.col("_id") == F.col("_key"))
    return fit(keep(labelled.select("_key", "_label", *COLUMNS), "labelled"), "_label", "_key")


def score_documents(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """`docs` rows with `score` (0 to 1) and `predicted` (1 from 0.5 on); other columns of `docs` but the text pass through.

    Only rows where `train` holds are learnt from. Null and empty texts have zero features and
    get a score like any other; repeated rows are scored each; labels of unknown documents and
    null labels are ignored. No usable label: every score is 0.5. Extra columns may have any name
    that does not start with `f_` or `_`; columns named as the result's are replaced.
    """
    features = keep(featurize(docs, text).drop(text), "features")
    score = learn(features, labels, train, key, label).score()
    passed = [c for c in docs.columns if c != text and c.lower() not in ("score", "predicted")]
    return features.select(*passed, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of `docs` that are predicted good, all columns as they are; see `score_documents`. Texts stay in their tasks."""
    features = featurize(docs, text)
    return features.where(learn(features, labels, train, key, label).score() >= 0.5).select(*docs.columns)
