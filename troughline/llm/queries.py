"""The text operators over the given tables, each at its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from troughline.llm import alignment, collocations, exact_dedup, katz, licenses, line_dedup, mixing, packing, polytope, quality, simhash_dedup, spotsigs, token_counts
from troughline.llm.common import id_remainder
from troughline.plans.views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_ranking")
def quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 3) == 1
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op2_content_sort", """
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM norm WINDOW same AS (PARTITION BY t)""")
def content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(table(spark, sf_dir, "documents"), largest=True)


@query("op4_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)


_WORDS = "[^\\x20\\x09-\\x0D]+"


def _feistel(x: str) -> str:
    """SQL of one pass of the index permutation over the grid `ga` x `gb`."""
    halves = [f"({x} % ga)", f"({x} // ga)"]
    for j in range(4):
        own, size = j % 2, ("ga", "gb")[j % 2]
        halves[own] = f"(({halves[own]} + CAST('0x' || substr(md5(concat_ws('|', src, {j}, {halves[1 - own]})), 1, 15) AS BIGINT) % {size}) % {size})"
    return f"({halves[1]} * ga + {halves[0]})"


@query("op10_source_mix", f"""
WITH sized AS (SELECT doc_id AS id, source IS NULL AS none, coalesce(source, '') AS name, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size FROM documents),
per AS (SELECT none, name, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY none, name) - 1 AS src FROM per),
weighed AS (SELECT *, CASE src % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w, 3 * source_size AS most FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed WINDOW o AS (ORDER BY most / w, src)),
share AS (SELECT coalesce(first(level ORDER BY most / w, src), 0e0) AS share FROM levels WHERE level * w <= most),
target AS (SELECT none, name, src, source_size, least(share * w, CAST(most AS DOUBLE)) AS target FROM levels, share),
words AS (SELECT *, CAST(round(target) AS BIGINT) AS words, CAST(ceil(source_size / 64) AS BIGINT) AS n FROM target WHERE source_size > 0),
counts AS (SELECT *, words % source_size AS rest, words // source_size * n + (words % source_size + 63) // 64 AS count FROM words),
slot AS (SELECT *, unnest(range(count)) AS slot FROM counts),
grid AS (SELECT *, slot % n AS x, CAST(ceil(sqrt(n)) AS BIGINT) AS ga, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS gb FROM slot),
walked AS (SELECT *, {_feistel("x")} AS y FROM grid),
drawn AS (SELECT src, CAST('0x' || substr(md5(concat(src, '|', slot)), 1, 15) AS BIGINT) % (SELECT greatest(1, CAST(ceil(sum(count) / 4096e0) AS BIGINT)) FROM counts) AS shard,
  CASE WHEN y < n THEN y ELSE list_reduce(list_prepend(y, range(40)), lambda z, i: CASE WHEN z < n THEN z ELSE {_feistel("z")} END) END AS block,
  CASE WHEN slot = count - 1 AND rest % 64 > 0 THEN rest % 64 ELSE 64 END AS length FROM walked),
used AS (SELECT src, block, sum((length = 64)::INT) AS times, coalesce(max(CASE WHEN length < 64 THEN length END), 0) AS part, min(shard) AS shard FROM drawn GROUP BY ALL),
rows AS (SELECT row_number() OVER () AS r, id, size, src, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized JOIN target USING (none, name)),
cells AS (SELECT r, src, start, size, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS block FROM rows WHERE size > 0),
met AS (SELECT r, shard, times * (least(start + size, block * 64 + 64) - greatest(start, block * 64))
  + greatest(least(start + size, block * 64 + part) - greatest(start, block * 64), 0) AS got FROM cells JOIN used USING (src, block)),
taken AS (SELECT r, CAST(sum(got) AS BIGINT) AS taken, min(CASE WHEN got > 0 THEN shard END) AS first_shard FROM met GROUP BY r)
SELECT id AS doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_shard FROM rows LEFT JOIN taken USING (r)""")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_bin_completion")
def bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op3_line_similarity")
def line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select(
        "doc_id", "n_lines", "n_removed", F.length("text").alias("chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256")
    )


@query("op5_spot_signatures")
def spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op9_katz_backoff")
def katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(table(spark, sf_dir, "documents"), id_remainder("doc_id", 5) == 1)


#: Short documents lie in the folder of their source and language, longer ones in blocks below it.
_PATH = "concat_ws('/', source, lang, CASE WHEN n_chars >= 400 THEN CAST(doc_id - doc_id % 1000 AS STRING) END, CAST(doc_id AS STRING))"


@query("op7_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    short = F.size(licenses.terms(F.col("text"))) <= licenses.FILE_WORDS
    return licenses.scan(docs, F.expr(_PATH), (F.col("n_chars") < 400) & short)


@query("op8_edit_counts")
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of every document: a passage at a third of it gives way to the text's beginning, then a word at the end."""
    import public_tokenizers

    n = F.length("text")
    edit = lambda start, cut, insert: F.struct(start.cast("int").alias("start"), F.lit(cut).alias("cut"), insert.alias("insert"))
    edits = F.array(
        edit(F.floor(n / 3), 25, F.substring("text", 1, 40)), edit(n + 1000, 0, F.concat(F.lit(" "), F.substring("text", 5, 9)))
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return token_counts.edit_counts(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op12_cross_polytope")
def cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op13_itemset_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
lengths AS (SELECT lang, w, unnest(range(1, 5)) AS k FROM split),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lengths),
f AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, words, unnest(range(1, words)) AS k FROM f WHERE words > 1),
parts AS (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM cuts),
scored AS (SELECT p.lang, p.phrase, a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.head JOIN f y ON y.lang = p.lang AND y.phrase = p.rest),
worst AS (SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_k AS (SELECT lang, f, string_split(phrase, ' ') AS w, words, unnest(range(2, words)) AS k FROM f WHERE words > 2),
inner_at AS (SELECT *, unnest(range(1, words - k + 2)) AS i FROM inner_k),
held AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS longer FROM inner_at GROUP BY ALL),
free AS (SELECT worst.* FROM worst LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""")
def itemset_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op11_fragment_alignment")
def fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
