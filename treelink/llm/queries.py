"""Thin queries over the operators of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .conversations import damage, repair, with_lost
from .decontaminate import decontaminate
from .hard_negatives import mine
from .knn_join import search_exactly
from .language import identify, learn_trigrams
from .line_dedup import dedup_lines
from .near_join import jaccard_groups
from .packing import pack_power_of_two
from .pii import replace_pii
from .substring_dedup import remove_repeated
from .toxicity import is_held_out, learn_lexicon, score_toxicity
from .vectors import search
from .warc_zip import round_trip


def tokenizer_path() -> str:
    """The contract's vocabulary file; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Setting of the session that holds the secret key of surrogates; without it a key for tests is used.
PII_KEY = "spark.treelink.pii.key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = replace_pii(table(spark, sf_dir, "documents"), key=spark.conf.get(PII_KEY, "corpus-key"))
    return new.select("doc_id", "n_entities", F.array_join("kinds", ",").alias("kinds"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.size("hits").cast("long")
    return hit.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"), min_lines=2, min_words=50)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack_power_of_two(docs, tokenizer_path(), max_len=2048, end_id=1, with_ids=False)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, loglik = learn_trigrams(table(spark, sf_dir, "documents"))
    return identify(table(spark, sf_dir, "pages"), langs, loglik).select("page_id", "lang", "probability", "declared", "suffix")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, lexicon, keep=["doc_id"])
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), threshold=0.8, shingle=5).select("doc_id", "class_id", "n_links", "n_copies")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated(table(spark, sf_dir, "documents"), length=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_exactly(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = with_lost(repair(damage(rows)), rows)
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.col("repaired"), 256).alias("repaired_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_substrings": op8_substrings,
    "op9_vectors": op9_vectors,
    "op10_warc_zip": op10_warc_zip,
    "op11_exact_topk": op11_exact_topk,
    "op12_conversations": op12_conversations,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op3_line_dedup": """
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts, text FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS spot FROM raw WHERE text IS NOT NULL),
full_lines AS (SELECT doc_id, spot, trim(line, ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS k FROM lines WHERE trim(line, ' ') <> ''),
runs AS (SELECT a.doc_id, a.k, a.t AS t1, b.t AS t2 FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
firsts AS (SELECT doc_id, k, first_value(doc_id) OVER w AS d0, first_value(k) OVER w AS k0 FROM runs WINDOW w AS (PARTITION BY t1, t2 ORDER BY doc_id, k)),
later AS (SELECT doc_id, k, k + 1 AS k2 FROM firsts WHERE d0 <> doc_id OR k0 + 2 <= k
          UNION ALL SELECT doc_id, k, k FROM full_lines WHERE len(regexp_extract_all(t, '[^ \\t]+')) >= 50 QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT f.doc_id, f.spot FROM later l JOIN full_lines f ON f.doc_id = l.doc_id AND f.k IN (l.k, l.k2)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.spot) AS text FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.spot = l.spot GROUP BY l.doc_id)
SELECT r.doc_id, (SELECT count(*) FROM full_lines f WHERE f.doc_id = r.doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = r.doc_id) AS n_removed,
       CASE WHEN r.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS kept_sha256
FROM raw r LEFT JOIN kept k ON k.doc_id = r.doc_id
""",
}
