"""License scans by diagonal voting of word k-grams.

Every template is a sequence of words. The hash of every window of ``k`` words of a text is
joined to the places where templates have it; each match votes for a diagonal, the text place
less the template place. Diagonals of one template within ``SHIFT`` of each other (words put in or
left out) are merged into one span; spans of a template that follow each other in both text and template, with at most
``GAP`` words between them, become one; and a span that covers enough of its template is verified word by word. A
span of more than ``tile`` words, which only drifting repetition makes, is verified in overlapping tiles, each
place of at most half a tile lying whole in one, so that work grows with the text and not with its square. Phrases are templates as long as their window, so each vote is a whole
place. Texts drop hashes that no template has, by a bitmap of fixed size, before the join.

Labels of whole templates come beside the labels of phrases. The score is the verified share of the
best template, 1 where a phrase stands, 0 where nothing does. Null and empty texts have no words. Rows
equal in id and text get the same result; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm import kernel as K
from siteloom.llm.tables import row_key
from siteloom.scale import written

GRAM = 4
SHIFT = 3
GAP = 24
COVERED = 0.5
VERIFIED = 0.8

#: Phrases whose places are counted, and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Texts of public licences and notices, and statements that name one (fixed values).
TEMPLATES = [
    ("mit-statement", "released under the MIT License"),
    ("apache-2.0-statement", "licensed under the Apache License, Version 2.0"),
    ("gpl-3.0-statement", "this work is licensed under the GNU General Public License, version 3"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation"),
    ("lgpl-notice", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
     "by the Free Software Foundation"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-statement", "licensed under a Creative Commons Attribution 4.0 International License"),
]

HITS = pa.list_(pa.struct([("k", pa.int32()), ("pos", pa.int32()), ("hash", pa.int64())]))


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    k: int
    phrase: bool

    def hashes(self) -> K.Words:
        data = np.frombuffer(" ".join(self.words).encode(), dtype=np.uint8)
        return K.words_of(data, np.array([0, len(data)]), K.ALNUM, lower=True)


def words_in(text: str) -> tuple[str, ...]:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered))


def templates(phrases: dict[str, str] = PHRASES, texts=TEMPLATES, gram: int = GRAM) -> list[Template]:
    out = [Template(i, label, words_in(p), len(words_in(p)), True) for i, (p, label) in enumerate(phrases.items())]
    return out + [Template(len(out) + i, label, words_in(t), min(gram, len(words_in(t))), False) for i, (label, t) in enumerate(texts)]


def template_grams(known: list[Template]) -> list[tuple[int, int, int, int]]:
    """(k, hash, template, place) of every window of every template."""
    out = []
    for t in known:
        gram, first = K.grams(t.hashes(), t.k)
        out += [(t.k, int(h), t.number, int(p)) for h, p in zip(K.as_long(gram), first, strict=True)]
    return out


def scan(df: DataFrame, doc_id: str, grams: list[tuple[int, int, int, int]]) -> DataFrame:
    """Per row: id, row, n_words, its matching windows, and the word hashes from the first of them to the last."""
    kind = df.schema[doc_id].dataType.simpleString()
    sizes = sorted({g[0] for g in grams})
    held = {}
    for size in sizes:
        bits = np.zeros(1 << 20, dtype=bool)
        bits[np.array([g[1] for g in grams if g[0] == size], dtype=np.int64) & ((1 << 20) - 1)] = True
        held[size] = K.Bitmap(np.packbits(bits, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.groups(batch.column("text")):
                words = K.words_of(data, offsets, K.ALNUM, lower=True)
                count = words.per_doc()
                begin = np.concatenate([[0], np.cumsum(count)])
                parts = []
                for size in sizes:
                    gram, first = K.grams(words, size)
                    take = np.flatnonzero(held[size].has(gram))
                    parts.append((np.full(len(take), size), first[take], gram[take]))
                k, at, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(at, kind="stable")
                k, at, gram = k[order], at[order], gram[order]
                doc = words.doc[at]
                hit = np.unique(doc)
                first, last = np.searchsorted(doc, hit, "left"), np.searchsorted(doc, hit, "right") - 1
                origin, stop = np.zeros(hi - lo, dtype=np.int64), np.zeros(hi - lo, dtype=np.int64)
                origin[hit] = np.maximum(at[first] - 2 * GRAM, begin[hit])
                stop[hit] = np.minimum(at[last] + 3 * GRAM, begin[hit + 1])
                size = stop - origin
                near = np.repeat(origin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                flat = pa.StructArray.from_arrays([pa.array(k.astype(np.int32)), pa.array((at - begin[doc]).astype(np.int32)),
                                                   pa.array(K.as_long(gram.astype(np.uint64)))], fields=list(HITS.value_type))
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))])
                spread = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(lo, hi - lo), batch.column("row").slice(lo, hi - lo), pa.array(count),
                    pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), flat), pa.array(origin - begin[:-1]),
                    pa.ListArray.from_arrays(pa.array(spread, type=pa.int32()), pa.array(K.as_long(words.hash)[near]))],
                    names=["id", "row", "n_words", "hits", "origin", "near"])

    rows = df.select(F.col(doc_id).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.select("id", row_key("id", "text").alias("row"), "text").mapInArrow(
        run, f"id {kind}, row string, n_words bigint, hits array<struct<k:int,pos:int,hash:bigint>>, origin bigint, near array<bigint>")


def aligned_share(own: list[int], template: list[int]) -> float:
    """Share of the template's words that stand in the span in the same order."""
    found = difflib.SequenceMatcher(None, own, template, autojunk=False).get_matching_blocks()
    return sum(b.size for b in found) / len(template)


def spans(votes: DataFrame) -> DataFrame:
    """Per row and template: spans of merged neighbouring diagonals, with the template words they cover."""
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    near = (votes.groupBy("row", "template", "diagonal").agg(
        F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k")).alias("end"), F.collect_set("place").alias("places"), F.max("k").alias("k"))
        .withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > SHIFT).cast("int"), F.lit(0)))
        .withColumn("span", F.sum("new").over(by)))
    places = F.array_distinct(F.flatten(F.collect_list("places")))
    return near.groupBy("row", "template", "span").agg(
        F.min("first").alias("first"), F.max("end").alias("end"), places.alias("places"), F.max("k").alias("k"))


def tile(length):
    """Words that are verified at once for a template of ``length`` words."""
    return 4 * length + 2 * GAP


def chained(found: DataFrame, about: DataFrame) -> DataFrame:
    """Spans that follow each other joined, with the template words they cover. A span inside an earlier one, or a single
    window of a long template, joins nothing and is left out; spans too long for one comparison are cut into tiles."""
    text_order = Window.partitionBy("row", "template").orderBy("first", F.desc("end"))
    before = text_order.rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.col("end") <= F.max("end").over(before), F.lit(False))
    single = (F.size("places") == 1) & (F.col("length") >= 8 * F.col("k"))
    parts = (found.join(F.broadcast(about.select("template", "length")), "template").filter(~single)
             .withColumn("within", within).filter(~F.col("within")).withColumn("at", F.array_min("places")))
    apart = (F.col("first") - F.lag("end").over(text_order) > GAP) | (F.col("at") <= F.lag("at").over(text_order))
    linked = parts.withColumn("chain", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(text_order))
    places = F.array_distinct(F.flatten(F.collect_list("places")))
    whole = linked.groupBy("row", "template", "length", "chain").agg(
        F.min("first").alias("first"), F.max("end").alias("end"), (F.size(places) + (F.max("k") - 1) * F.count(F.lit(1))).alias("covered"))
    size = tile(F.col("length"))
    starts = F.when(F.col("end") - F.col("first") <= size, F.array("first")).otherwise(
        F.sequence("first", F.col("end") - (size / 2).cast("int"), (size / 2).cast("int")))
    return (whole.filter(F.col("covered") >= F.col("length") * COVERED)
            .withColumn("first", F.explode(starts)).withColumn("end", F.least("end", F.col("first") + size)))


def scanned(documents: DataFrame, doc_id: str = "doc_id", known: list[Template] | None = None) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first, end, share)."""
    known = templates() if known is None else known
    spark: SparkSession = documents.sparkSession
    grams = template_grams(known)
    rows = written(scan(documents, doc_id, grams), "scan")
    places = spark.createDataFrame(grams, "k int, hash bigint, template int, place int")
    about = spark.createDataFrame([(t.number, t.label, t.phrase, len(t.words)) for t in known],
                                  "template int, label string, phrase boolean, length int")
    hits = rows.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*").distinct()
    votes = hits.join(F.broadcast(places), ["k", "hash"]).withColumn("diagonal", F.col("pos") - F.col("place"))
    votes = written(votes.join(F.broadcast(about), "template"), "votes")

    base = votes.filter("phrase").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("pos").cast("bigint").alias("first_word"), F.max("pos").cast("bigint").alias("last_word"),
        F.collect_set("label").alias("base_labels"))
    words = {t.number: [int(h) for h in K.as_long(t.hashes().hash)] for t in known}

    @F.pandas_udf("double")
    def share(own: pd.Series, template: pd.Series) -> pd.Series:
        return pd.Series([aligned_share(list(o), words[t]) for o, t in zip(own, template, strict=True)], dtype=float)

    likely = chained(spans(votes.filter("not phrase")), about).join(F.broadcast(about.select("template", "label")), "template")
    texts = rows.filter(F.size("hits") > 0).select("row", "origin", "near").dropDuplicates(["row"])
    start = F.greatest(F.col("first") - F.col("origin"), F.lit(0)).cast("int")
    checked = (likely.join(texts, "row").withColumn("own", F.slice("near", start + 1, (F.col("end") - F.col("first")).cast("int")))
               .withColumn("share", share("own", "template")))
    methods = checked.groupBy("row").agg(
        F.max("share").alias("best"), F.collect_set(F.when(F.col("share") >= VERIFIED, F.col("label"))).alias("own_labels"),
        F.collect_list(F.struct("label", F.col("first").cast("bigint").alias("first"), F.col("end").cast("bigint").alias("end"),
                                "share")).alias("spans"))
    none = F.array().cast("array<string>")
    joined = rows.select("id", "row", "n_words").join(base, "row", "left").join(methods, "row", "left")
    base_labels, own = F.coalesce("base_labels", none), F.coalesce("own_labels", none)
    return joined.select(
        F.col("id").alias(doc_id), "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        F.array_sort(base_labels).alias("base_labels"), F.array_sort(F.array_union(base_labels, own)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), F.col("spans"))
