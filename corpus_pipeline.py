"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in
the shared folder and gives it, read again, to the next stage. All but the last keep the columns of documents,
whatever further columns there are and whatever their names. Every stage turns an empty table into an empty one and
bears nulls in any column: a null or empty text has no window of toxic words, no benchmark passage, no entity and no
token, and is a near-duplicate of other texts without words only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import byte_bpe, decontaminate, pii, simhash, toxicity
from spindrift.llm.common import pick_rows, write_table
from spindrift.llm.queries import surrogate_key, table, tokenizer

#: Score from which a document is rejected as toxic, and similarity of near-duplicates.
TOXIC, SIMILAR = 0.3, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below ``TOXIC``; learnt from the labels of the input's documents.
    Repeated rows get equal scores and stay or go together."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="__sd_score").filter(F.col("__sd_score") < TOXIC).drop("__sd_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of documents about ``SIMILAR`` alike in five-word shingles the one with the smallest doc_id.

    Of rows with equal doc_id and text one stays; rows of a group that share only their doc_id stay or go together. Documents without a doc_id can't be named as
    the one that stays; they are kept unless their group has a document with one. Rows are chosen by a written number, never by doc_id.
    """
    keyed = write_table(docs.withColumns({"__sd_row": F.monotonically_increasing_id(), "__sd_md5": F.md5("text")}), "simhash-keyed")
    groups = simhash.similar_documents(keyed, SIMILAR, 5, row="__sd_row", carry=("__sd_md5",))
    stays = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "__sd_md5").agg(F.min("__sd_row").alias("__sd_row"))
    stays = write_table(stays.select("__sd_row"), "simhash-kept")
    return pick_rows(keyed, "__sd_row", stays).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without any window of a benchmark item; repeated rows stay or go together."""
    away = {c: f"__sd_{c}" for c in docs.columns if c in decontaminate.RESULTS}
    got = decontaminate.decontaminate(docs.withColumnsRenamed(away), table(spark, sf_dir, "benchmark"))
    return got.filter(~F.col("contaminated")).select(*(F.col(away.get(c, c)).alias(c) for c in docs.columns))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; n_chars follows the new text, a null n_chars stays null. Every row stays."""
    out = pii.pseudonymise(docs, surrogate_key(spark), count="__sd_entities").drop("__sd_entities")
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, one row per row; a null or empty text has none."""
    out = byte_bpe.encode(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", hide_personal_data), ("token_ids", encode)]

#: SQL can express neither the scores nor the fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
