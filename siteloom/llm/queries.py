"""One query per corpus operator over its whole table, and SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import (
    chat_format,
    decontaminate,
    hard_negatives,
    jaccard_join,
    license_scan,
    line_chunks,
    packing,
    quality_rules,
    quality_trees,
    token_align,
    token_counts,
    url_filter,
    warc,
)
from siteloom.llm.sql import STATEMENTS
from siteloom.llm.tables import table
from siteloom.scale import scratch_path


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("content"))
        for role in ("user", "assistant")]).alias("messages"))
    return _chat_digests(chat_format.canonical_turns(table(spark, sf_dir, "conversations")).union(chat_format.canonical_turns(planted)))


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as JSON records of all layouts, read and formatted: nothing may be lost or change its place."""
    turns, _ = chat_format.canonical_json_turns(json_records(table(spark, sf_dir, "conversations")), "record")
    return _chat_digests(turns)


def json_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): a layout for each conversation, by what it holds. One question with one answer goes
    into single fields, a conversation that opens or closes as a dialogue of some kind into a list, others into one record per turn."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("t"))
    first, last = F.col("t")[0], F.element_at("t", -1)
    roles = F.array_join("t.role", ",")
    ask, answer = first["text"], last["text"]
    parts = F.split(ask, "\n\n", 2)

    def fields(**named) -> Column:
        return F.array(F.to_json(F.struct(*[c.alias(n) for n, c in named.items()])))

    pick = F.pmod(F.xxhash64(ask), F.lit(4))
    single = (F.when((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""),
                     fields(instruction=parts[0], input=parts[1], output=answer))
              .when(pick == 0, fields(instruction=ask, output=answer)).when(pick == 1, fields(prompt=ask, completion=answer))
              .when(pick == 2, fields(prompt=ask, response=answer)).otherwise(fields(question=ask, answer=answer)))
    listed = lambda role, text: F.transform("t", lambda x: F.struct(x["role"].alias(role), x["text"].alias(text)))
    rows = F.transform("t", lambda x: F.to_json(F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")),
                                                {"ignoreNullFields": "false"}))
    layout = (F.when((roles == "user,assistant") & (ask != "") & (answer != ""), single)
              .when(first["role"] == "system", fields(messages=listed("role", "content")))
              .when(last["role"] == "user", fields(conversations=listed("from", "value"))).otherwise(rows))
    return whole.select("conv_id", F.explode(layout).alias("record"))


def _chat_digests(turns: DataFrame) -> DataFrame:
    out = chat_format.formatted(turns).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn(
        "loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("bigint").alias("formatted_chars"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path, with_payload=False).drop("url")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages).select("_row.page_id", "host", "path", "rule", "verdict", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality_rules.train(documents, table(spark, sf_dir, "labels"))
    return quality_rules.judged(documents, rules).select("doc.doc_id", *quality_rules.COUNTS[:5], "base_failed", "rule", "kept")


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_chunks.deduplicated(table(spark, sf_dir, "documents"))
    lines = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["lines"])
    return done.select("doc.doc_id", F.size("spans").cast("bigint").alias("n_removed_chunks"), lines.alias("n_removed_lines"),
                       (F.length("doc.text") - F.length("text")).cast("bigint").alias("n_removed_chars"),
                       F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"), "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(packing.TOKENIZER)
    return packing.packed(table(spark, sf_dir, "documents"), path).drop("ids")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, path = table(spark, sf_dir, "documents"), public_tokenizers.path(token_counts.MODEL)
    return token_counts.counted(documents, path, scores=token_counts.fitted(documents, path))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found, _ = token_align.aligned(documents, public_tokenizers.path(token_align.MODEL_A), public_tokenizers.path(token_align.MODEL_B))
    return found


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", hard_negatives.scaled(F.col("embedding")).alias("vector"), moved.alias("label"))
    return hard_negatives.mined(vectors, F.col("id") % 50 == 0)


def op13_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_trees.scored(documents, quality_trees.train(documents, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_chunks": op6_line_chunks,
    "op7_license_scan": op7_license_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_counts": op9_token_counts,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_token_align": op11_token_align,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_trees": op13_quality_trees,
    "chat_records": chat_records,
}

SQL: dict[str, str] = dict(STATEMENTS)
