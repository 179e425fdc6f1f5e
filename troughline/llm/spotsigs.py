"""SpotSigs fingerprints: chains of content words that follow common-word anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troughline.llm.common import id_ranges, keep, shuffle_width, text_of

# Common words of four languages that anchor a signature.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "his", "in", "is", "it", "not", "of", "on",
    "or", "that", "the", "this", "to", "was", "were", "which", "with",
    "au", "avec", "ce", "dans", "des", "du", "elle", "est", "et", "il", "la", "le", "les", "mais", "ne", "ou", "par", "pas", "pour", "que",
    "qui", "se", "son", "sur", "un", "une",
    "als", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "die", "ein", "eine", "er", "es", "im", "ist", "mit", "nicht", "sich",
    "sie", "und", "von", "zu",
    "al", "como", "con", "de", "del", "el", "en", "lo", "los", "las", "no", "para", "por", "su", "y",
)
#: Content words in a chain.
CHAIN = 2
#: Texts with fewer signatures are described by their single words as well.
SPARSE = 16
#: Documents whose order by id is settled in one task step.
PER_RANGE = 2_000


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Add the ascending distinct 32-bit signatures of a text column.

    Words are runs of letters and digits in lower case. A signature is an anchor and the `chain`
    content words after it, anchors between them passed over; near the end of the text the chain is
    cut short. A text with under `SPARSE` signatures is described by its words as well, one without
    words by its characters, and the empty text by nothing. Each step is a column of its own: an array
    named inside a lambda would be computed again for every element.
    """
    words = F.filter(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    split = df.withColumn("_words", words)
    placed = F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    parts = split.withColumns({
        "_anchors": F.filter(placed, lambda p: p["w"].isin(*ANCHORS)), "_content": F.filter("_words", lambda w: ~w.isin(*ANCHORS)),
    })

    # The k-th anchor at word i has i - k content words before it, so its chain starts there.
    def spot(anchor: Column, k: Column) -> Column:
        begun = anchor["i"] - k < F.size("_content")
        return F.when(begun, F.hash(anchor["w"], *[F.get("_content", anchor["i"] - k + j) for j in range(chain)]))

    spots = parts.withColumn("_spots", F.array_compact(F.transform("_anchors", spot)))
    plain = F.transform("_words", lambda w: F.hash(w, F.lit("word")))
    chosen = F.when(F.size("_spots") >= SPARSE, F.col("_spots")).when(F.size("_words") > 0, F.concat("_spots", plain)).when(
        F.length(text) > 0, F.array(F.hash(text, F.lit("text")))
    ).otherwise(F.array().cast("array<int>"))
    return spots.withColumn(out, F.array_sort(F.array_distinct(chosen))).drop("_words", "_anchors", "_content", "_spots")


def fingerprint(sigs: Column) -> Column:
    """The signature set as text: eight hex digits each, ascending."""
    return F.concat_ws("", F.transform(sigs, lambda s: F.lower(F.substring(F.lpad(F.hex(s.cast("long")), 16, "0"), -8, 8))))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets. Sets whose lengths alone keep it below `least` are not compared and give 0."""
    short, long_ = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(long_ == 0, 1.0).when(short < long_ * least, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many leading characters of the following text, or all it has."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def with_next(docs: DataFrame, key: str, text: str, per_range: int | None = None) -> DataFrame:
    """`id, t, sigs, next_t, next_sigs`: each document beside the next one in descending order of id.

    Ids are cut into ranges; a range is ordered in one task step, and the first document of each
    range visits the range before it as a guest. The last document is followed by the first of all.
    Texts move once. Equal ids are ordered by text; a null id comes last.
    """
    ids = docs.select(F.col(key).cast("long").alias("id"))
    n_rows = ids.count()
    of = F.coalesce(-id_ranges(ids, "id", n_rows, per_range or PER_RANGE), F.lit(1).cast("long")).alias("range")
    # One row per range that holds any document: its first id in order, and the range before it.
    heads = ids.select("id", of).groupBy("range").agg(F.max("id").alias("head"))
    before = Window.partitionBy(F.lit(0)).orderBy("range")
    cycle = heads.withColumn("host", F.coalesce(F.lag("range").over(before), F.max("range").over(Window.partitionBy(F.lit(0)))))
    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t")).withColumn("range", of)
    keyed = rows.join(F.broadcast(cycle) if n_rows <= PER_RANGE * 50_000 else cycle, "range")
    places = F.when(F.col("id").eqNullSafe(F.col("head")), F.array(
        F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("at"), F.lit(True).alias("guest"))
    )).otherwise(F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest"))))
    dealt = with_signatures(keyed.select("id", "t", F.explode(places).alias("p")).select("id", "t", "p.at", "p.guest").repartition(
        shuffle_width(docs), "at"
    ), "t", "sigs")
    order = Window.partitionBy("at").orderBy("guest", F.col("id").desc_nulls_last(), "t")
    return dealt.withColumns({"next_t": F.lead("t").over(order), "next_sigs": F.lead("sigs").over(order)}).where("NOT guest")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`.

    The edited text is described under `edited`. Null texts count as empty; two empty texts are
    alike (1). Equal texts have equal fingerprints. A single document is its own next. Rows that repeat an id
    follow each other in order of text. An empty table gives no rows; other columns are ignored.
    """
    pairs = with_next(docs, key, text).withColumn("e", edited(F.col("t"), F.col("next_t")))
    both = with_signatures(pairs, "e", "e_sigs")
    return both.select(
        F.col("id").alias(key), F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("e_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("e_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs `a, b, likeness` of representatives of equal signature sets, and the membership `key, representative`.

    Sets are partitioned by length in steps of 1 / `least`, so only neighbouring partitions can
    hold similar sets. In a partition pair, sets meet on their rarest signatures: as many as two
    similar sets must share one of. Pairs that the lengths rule out are dropped before the sets are compared.
    """
    rows = keep(with_signatures(docs.select(F.col(key).alias("id"), text_of(text).alias("t")), "t", "sigs").drop("t"), "signatures")
    sets = keep(rows.groupBy("sigs").agg(F.min("id").alias("rep")).where(F.size("sigs") > 0), "sets")
    common = sets.select("rep", F.explode("sigs").alias("s"))
    ranked = common.join(common.groupBy("s").count(), "s").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("count", "s"))).alias("by"))
    n = F.size("by")
    short = ranked.select("rep", n.alias("n"), F.slice("by", F.lit(1), (n - F.ceil(n * least) + 1).cast("int")).alias("first"))
    cut = short.select("rep", "n", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least)) + 1e-9).alias("part"), F.explode("first.s").alias("s"))
    probe = cut.withColumn("part", F.explode(F.array(F.col("part") - 1, F.col("part"))))
    met = probe.alias("p").join(cut.alias("c"), ["part", "s"]).where(
        (F.col("c.n") >= F.col("p.n") * least) & ((F.col("c.n") < F.col("p.n")) | ((F.col("c.n") == F.col("p.n")) & (F.col("c.rep") < F.col("p.rep"))))
    ).select(F.col("p.rep").alias("a"), F.col("c.rep").alias("b")).distinct()
    left, right = sets.select(F.col("rep").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("sigs").alias("sb"))
    pairs = met.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"), least)).where(F.col("likeness") >= least)
    members = rows.join(sets, "sigs").select(F.col("id").alias(key), F.col("rep").alias("representative"))
    return pairs.select("a", "b", "likeness"), members
