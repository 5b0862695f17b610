"""The queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, bpe_lexicon, exact_topk, language_id, lexical_search, period_runs, piece_codec, quality_model, simhash_dedup, source_mix, substring_dedup, token_count, warc_derivatives
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(table(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives.derive(warc_derivatives.responses(table(spark, sf_dir, "pages")))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_classes(table(spark, sf_dir, "documents"))


def op5_ann_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.nearest(table(spark, sf_dir, "embeddings"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), with_pieces=False)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.passages(table(spark, sf_dir, "documents"))
    return out.select(F.col("r.doc_id").alias("doc_id"), "text", "n_chunks", "n_words", "repeated_words", "cut_words", (F.col("repeated_words") > 0).alias("has_repeat"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_scores(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, quality_model.grades_of_labels(table(spark, sf_dir, "labels")))
    return quality_model.grade(docs, model).select(F.col("r.doc_id").alias("doc_id"), "score", "expected_grade", "tail_probability", "keep")


def op11_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_lexicon.decode(bpe_lexicon.encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def looped_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """op13's contract: of one document in ten the words from a place on repeat the first few of them; a null id changes nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = period_runs.find_runs(table(spark, sf_dir, "documents"), looped_words)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    out = out.withColumn("b", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", (-F.col("b.n")).alias("length"), "b.period",
        F.floor(-1000 * F.col("b.n") / F.col("b.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_warc_derivatives, op3_source_mix, op4_simhash, op5_ann_blocks, op6_merge_dropout, op7_substring_dedup, op8_token_count, op9_exact_topk, op10_quality, op11_bpe_lexicon, op12_lexical_search, op13_period_runs)
}

#: Best 20 of each query by a score, ties to the smaller id.
_BEST = """
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, {score} AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
WHERE rank <= 20"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op12_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
s AS (SELECT count(*) AS big_n, CAST(sum(len(words)) AS BIGINT) AS big_l FROM d WHERE len(words) > 0),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
i AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT item_id, r, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN t USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0
QUALIFY rank <= 10""",
    "op9_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
    + _BEST.format(score="CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT)"),
    "op5_ann_blocks": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
    + _BEST.format(score="list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b)"),
}
