"""From raw documents to packed training sequences, stage by stage.

Each stage takes all that the one before kept and returns the columns of the documents table,
but the last, which returns the pieces with their token ids and places in sequences:

1. quality rules: documents that the base or the learned list rejects go;
2. line dedup: repeated chunks are cut out; documents that are left without a word go, and
   ``n_chars`` is counted anew;
3. n-gram Jaccard join: of each component the document of the smallest id stays;
4. benchmark decontamination: documents with a shared window go;
5. best-fit packing.

Decisions are joined to rows by id and text together, so documents that share an id by mistake are
judged apart, and a row repeated in both stays once if its group stays. Null and empty texts fail the first stage;
an empty table gives no rows in any stage. Further columns pass through all stages but the last.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import decontaminate, jaccard_join, line_chunks, packing, quality_rules
from siteloom.llm.tables import row_key, small_batches, table
from siteloom.scale import lookup_join, written

#: The stages learn rules and pack by tokens, which SQL cannot state.
ORACLE_SQL = None

WORD = r"[^ \t-\r]"


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose row key is not in ``rows``."""
    keyed = docs.select(F.struct("*").alias("doc"), row_key("doc_id", "text").alias("row"))
    return lookup_join(keyed, rows, ["row"], "left_anti").select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_chunks.deduplicated(docs).filter((F.size("spans") == 0) | F.col("text").rlike(WORD))
    kept = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("bigint")} if "n_chars" in docs.columns else {})
    return done.select(*[kept.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    members = written(jaccard_join.similar_components(docs).filter("n_shingles > 0"), "members")
    first = members.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))["row"].alias("row"))
    gone = written(members.join(first.select("row"), "row", "left_anti").select("row").distinct(), "gone")
    kept = without(docs, gone)
    twice = written(members.groupBy("row").count().filter("count > 1").select("row"), "twice")
    if twice.isEmpty():
        return kept
    keyed = kept.withColumn("_row", row_key("doc_id", "text"))
    again = keyed.join(twice.withColumnRenamed("row", "_row"), "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
    return without(kept, twice).unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, written(found.filter("n_hit > 0").select("row").distinct(), "contaminated"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path(packing.TOKENIZER))


def sparing(stage):
    """The stage with small batches between Spark and Python, as its workers and executors serve all stages."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return stage(spark, docs, sf_dir)
    return run


STAGES = [(name, sparing(stage)) for name, stage in (
    ("quality_rules", quality), ("line_dedup", line_dedup), ("jaccard_join", near_duplicates),
    ("decontamination", decontamination), ("packing", sequences))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table; each reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
