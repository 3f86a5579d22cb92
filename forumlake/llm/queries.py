"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from forumlake.llm import brown, chat_windows, chosen_path, exact_dedup, imatch, licenses, mixing, packing, periodic_runs, quality, substrings, token_counts, whitening
from forumlake.llm.common import conversations, documents, embeddings
from forumlake.session import stage

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.fingerprints(documents(spark, sf_dir))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every document."""
    return chosen_path.near_groups(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents; the one with the largest id stays."""
    return exact_dedup.exact_copies(documents(spark, sf_dir), keep="largest")


OP3_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)
"""


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under word classes learnt from the training documents."""
    return brown.lm_scores(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stay when passages of earlier documents are removed, as a digest."""
    rows = substrings.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, s, list_aggregate(words[s:s + 12], 'string_agg', ' ') AS body
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS s FROM d)),
g AS (SELECT body, min(doc_id) AS least FROM w GROUP BY body HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 12)) AS pos FROM w JOIN g USING (body) WHERE least < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS body, count(*) AS n
         FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d) x
         WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.pos = x.pos) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, expected number of draws and draws of every document."""
    rows = mixing.with_margins(documents(spark, sf_dir))
    six = lambda name: F.round(F.col(name), 6).alias(name)
    mixed = mixing.mixed(stage(rows, "mixing-rows"))
    return mixed.select("doc_id", *mixing.MARGINS, F.col("tokens").alias("n_tokens"), six("weight"), six("expected"), "copies")


def _raking_sql() -> str:
    goals = ", ".join(
        f"""
seen_{m} AS (SELECT {m}, sum(tokens) AS seen, sum(tokens) < {mixing.LEAST_SHARE} * sum(sum(tokens)) OVER () AS alone, sum(sum(tokens)) OVER () AS everything FROM cells GROUP BY {m}),
goal_{m} AS (SELECT {m}, CASE WHEN alone THEN seen ELSE pow(seen, {mixing.TEMPER[m]}) / (sum(pow(seen, {mixing.TEMPER[m]})) FILTER (NOT alone) OVER ())
             * (everything - coalesce(sum(seen) FILTER (alone) OVER (), 0)) END AS target FROM seen_{m})"""
        for m in mixing.MARGINS
    )
    steps, last = [], "w0"
    for i in range(mixing.MOST_ROUNDS):
        if i and i % mixing.ROUNDS == 0:
            off = " UNION ALL ".join(
                f"SELECT max(abs(now / target - 1)) AS off FROM (SELECT {m}, sum(tokens * weight) AS now FROM {last} GROUP BY {m}) JOIN goal_{m} USING ({m}) WHERE target > 0" for m in mixing.MARGINS
            )
            steps.append(f"off{i} AS MATERIALIZED (SELECT max(off) > {mixing.TOLERANCE} AS more FROM ({off}))")
        more = f"(SELECT more FROM off{i // mixing.ROUNDS * mixing.ROUNDS})" if i >= mixing.ROUNDS else "true"
        for k, m in enumerate(mixing.MARGINS):
            steps.append(
                f"n{i}{k} AS (SELECT {m}, sum(tokens * weight) AS now FROM {last} GROUP BY {m}),\n"
                f"w{i}{k} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, CASE WHEN now > 0 AND c.tokens > 0 AND {more} THEN c.weight * target / now ELSE c.weight END AS weight"
                f" FROM {last} c JOIN n{i}{k} USING ({m}) JOIN goal_{m} USING ({m}))"
            )
            last = f"w{i}{k}"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN length(coalesce(text, '')) < 500 THEN 'note'
              WHEN length(text) < 2000 THEN 'article' WHEN length(text) < 8000 THEN 'essay' ELSE 'book' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
{goals},
w0 AS (SELECT *, 1.0::DOUBLE AS weight FROM cells),
{(',' + chr(10)).join(steps)}
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round({mixing.RATE} * weight, 6) AS expected,
       CAST(floor({mixing.RATE} * weight) AS BIGINT) + CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) / 4294967296.0
            < {mixing.RATE} * weight - floor({mixing.RATE} * weight) AS BIGINT) AS copies
FROM d JOIN {last} USING (source, lang, topic)
"""


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted windows, and of one that speaks in control strings."""
    told = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(told).alias("text"),
    )
    rows = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_windows.digests(chat_windows.chat_windows(rows))


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences, with a digest in place of the ids."""
    pieces = packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.drop("ids")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notice of every document."""
    return licenses.scan(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, weak label and verdict of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = quality.scored(docs, quality.fit_quality(docs))
    return rows.select(
        "doc_id",
        F.col("__score").alias("score"),
        F.col("__posterior").alias("weak_label"),
        F.col("__votes").alias("votes"),
        (F.col("__score") >= quality.THRESHOLD).alias("accepted"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the four leading eigenvectors, in units of their standard deviations."""
    return whitening.whitened_embeddings(embeddings(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest periodic run of every document, and digests of all its runs and of its collapsed text."""
    return periodic_runs.digests(periodic_runs.collapse_runs(documents(spark, sf_dir), seeded=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_imatch": op1_imatch,
    "op2_chosen_path": op2_chosen_path,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_brown_lm": op4_brown_lm,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_chat_windows": op7_chat_windows,
    "op8_cost_packing": op8_cost_packing,
    "op9_license_scan": op9_license_scan,
    "op10_quality": op10_quality,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op6_source_mixing": _raking_sql()}
