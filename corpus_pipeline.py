"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes the documents that the one before kept, as a table reread from Parquet, and returns a
table with the columns of ``documents``; the last one returns token ids. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrow.llm.bpe import encode, n_ids
from labelgrow.llm.decontaminate import find_leaks
from labelgrow.llm.jaccard_join import link_components
from labelgrow.llm.langid import fit, held_out, identify
from labelgrow.llm.line_dedup import dedup_lines
from labelgrow.llm.shared import fresh, stored

#: Predictions below this posterior probability are no language.
LEAST_SCORE = 0.5
NO_ID = -(2**63)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that have no letter or no likely language."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    lang, score = fresh(docs, "lang_pred", "score")
    kept = identify(docs, model).filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document that loses all of them stays with an empty text."""
    done = dedup_lines(docs).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates; rows that repeat whole stay once.

    Documents without words have no group and stay. A row without an id goes if its group has an id.
    """
    doc, text_hash, group = fresh(docs, "doc", "text_hash", "group")
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_hash: F.xxhash64("text")})
    linked = link_components(keyed.select("doc_id", "text", doc, text_hash), group_col=group)
    alone = linked.filter(F.col(group).isNull()).select(doc, text_hash)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col(doc), F.col(text_hash)))
    firsts = linked.filter(F.col(group).isNotNull()).groupBy(group).agg(first.alias("x")).select(f"x.{doc}", f"x.{text_hash}")
    kept = stored(firsts.union(alone).distinct(), "kept")
    return keyed.join(kept, [doc, text_hash], "left_semi").dropDuplicates([doc, text_hash]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    (matches,) = fresh(docs, "matches")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size(matches) == 0).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, bytes_col="decoded")
    return done.select("doc_id", n_ids(F.col("ids")).alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: Naive Bayes and byte pairs aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
