"""N-gram Jaccard components with prefix filters under several token orders.

A text's set is its distinct word shingles (48-bit hashes; a text of fewer words is one
shingle). Texts with the same set are one class, named by a 64-bit sum over the set.
Two sets of Jaccard similarity ``t`` or more share a token among the first
``n - ceil(t * n) + 1`` tokens of both, under any one order of all tokens. The first order is
used in a join (equal token, sizes within ``t``, and places that leave room for the overlap such sizes
need), and the prefixes must have as many tokens in common as such sizes need; the pair must also meet under
the other orders before its whole sets are intersected. All orders put frequent tokens
last, so prefixes are rare tokens; which tokens count as frequent changes the work, never
the result. Orders differ in how tokens of like frequency are ranked.

Components need links, not all pairs: a few rounds first compare each class with one
leader of its posting lists, so groups of near copies fall together; then every
remaining candidate pair across two components is compared. No link between components
is lost, and inside a component no further pair is made. Lists of frequent
tokens are dealt over ``SALTS`` chunks in the first round; the second sees one class per component. Lists of
more than ``BLOCK`` classes are compared across components block by block.

Null and empty texts, and texts without words, have an empty set and are linked with
nothing. Repeated rows are in one class. A null id can be a member, never a component's name
unless all its ids are null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteloom.llm import kernel as K
from siteloom.llm.components import components
from siteloom.llm.tables import bitmap_of, discard, row_key
from siteloom.scale import written

SHINGLE = 5
PERCENT = 80
SALTS = 64
LEADER_ROUNDS = 2
#: Classes of one list that a task compares with as many others; a longer list is split.
BLOCK = 1024
#: Statistics window, least count in it, and the number of most frequent tokens told to all tasks.
WINDOW_TOKENS = 4_000_000
FLOOR = 4
FREQUENT = 1 << 18

TOKEN = np.uint64((1 << 48) - 1)
TOKEN_BITS, RANK_BITS = np.uint64(48), np.uint64(6)
MAX_ROWS = 1000
#: Odd multipliers of the token orders, and their inverses modulo 2 ** 48.
ORDERS = [1, 0x5851F42D4C95, 0x14057B7EF767]
ORDERS = [(np.uint64(m), np.uint64(pow(m, -1, 1 << 48))) for m in ORDERS]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of texts: how many, set sizes, and the distinct tokens with their text numbers."""
    for lo, hi, data, offsets in K.groups(texts, max_rows=MAX_ROWS):
        words = K.words_of(data, offsets, K.NOT_SPACE, lower=True)
        gram, first = K.grams(words, k)
        count = words.per_doc()
        few = np.flatnonzero((count > 0) & (count < k))
        doc = np.concatenate([words.doc[first], few]).astype(np.uint64)
        token = np.concatenate([gram, K.whole(words, few)]) & TOKEN
        key = np.unique((doc << TOKEN_BITS) | token)
        doc = (key >> TOKEN_BITS).astype(np.int64)
        yield hi - lo, np.bincount(doc, minlength=hi - lo), doc, key & TOKEN


def node_ids(size: np.ndarray, doc: np.ndarray, token: np.ndarray) -> np.ndarray:
    """64-bit name of each set."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(K.mix(token), dtype=np.uint64)])
    begin = np.concatenate([[0], np.cumsum(size)])
    return K.mix(total[begin[1:]] - total[begin[:-1]] + size.astype(np.uint64) * K.GRAM)


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Prefix length of a set."""
    return np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)


class Frequent:
    """The most frequent tokens and the rank (1 to 63, by powers of two of their count) of each; others rank 0."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens = tokens[order].astype(np.uint64)
        self.ranks = np.clip(np.log2(np.maximum(counts[order], 2)) * 1.5, 1, 63).astype(np.uint64)
        bits = np.zeros(1 << 22, dtype=bool)
        bits[(self.tokens & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.bits = np.packbits(bits, bitorder="little")
        self.filter = K.Bitmap(self.bits)

    def rank(self, token: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token), dtype=np.uint64)
        if len(self.tokens):
            maybe = np.flatnonzero(self.filter.has(token))
            at = np.minimum(np.searchsorted(self.tokens, token[maybe]), len(self.tokens) - 1)
            hit = self.tokens[at] == token[maybe]
            out[maybe[hit]] = self.ranks[at[hit]]
        return out


def ordered(doc: np.ndarray, token: np.ndarray, rank: np.ndarray, order: int) -> np.ndarray:
    """Tokens of every text in the given order, with rank and text number in one sorted key."""
    place = (token * ORDERS[order][0]) & TOKEN
    return np.sort((doc.astype(np.uint64) << (TOKEN_BITS + RANK_BITS)) | (rank << TOKEN_BITS) | place)


def unplaced(key: np.ndarray, order: int) -> np.ndarray:
    return ((key & TOKEN) * ORDERS[order][1]) & TOKEN


def firsts(size: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Positions, in tokens laid out text by text, of the first ``prefix`` of each."""
    begin = np.cumsum(size) - size
    return np.repeat(begin - (np.cumsum(prefix) - prefix), prefix) + np.arange(prefix.sum())


def signatures(df: DataFrame, id_column: str, k: int) -> DataFrame:
    """Per row: id, row key, set size, node (null for an empty set), and in some rows counts of tokens that are
    frequent among the rows before it."""
    kind = df.schema[id_column].dataType.simpleString()
    heavy_type = pa.list_(pa.struct([("token", pa.int64()), ("count", pa.int64())]))

    def tally(held: list[np.ndarray]) -> list[dict]:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        often = np.flatnonzero(count >= FLOOR)
        return [{"token": int(t), "count": int(c)} for t, c in zip(token[often], count[often], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            at = 0
            for rows, size, doc, token in shingle_sets(batch.column("text"), k):
                held.append(token)
                total += len(token)
                heavy = [[] for _ in range(rows)]
                if total >= WINDOW_TOKENS:
                    heavy[-1], held, total = tally(held), [], 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(at, rows), batch.column("row").slice(at, rows), pa.array(size.astype(np.int64)),
                    pa.array(K.as_long(node_ids(size, doc, token)), mask=size == 0), pa.array(heavy, type=heavy_type)],
                    names=["id", "row", "n", "node", "heavy"])
                at += rows
        if total:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1).cast(batch.column("id").type), pa.nulls(1, pa.string()), pa.array([-1], type=pa.int64()),
                pa.nulls(1, pa.int64()), pa.array([tally(held)], type=heavy_type)], names=["id", "row", "n", "node", "heavy"])

    rows = df.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.select("id", row_key("id", "text").alias("row"), "text").mapInArrow(
        run, f"id {kind}, row string, n bigint, node bigint, heavy array<struct<token:bigint,count:bigint>>")


def postings(df: DataFrame, frequent: Frequent, k: int, percent: int) -> DataFrame:
    """One row per class (copies within a task once) and token of its prefix under the first order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for rows, size, doc, token in shingle_sets(batch.column("text"), k):
                node = node_ids(size, doc, token)
                prefix = np.where(seen.first(node), needed(size, percent), 0)
                key = ordered(doc, token, frequent.rank(token), 0)[firsts(size, prefix)]
                pos = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                yield pa.RecordBatch.from_arrays([
                    pa.array(unplaced(key, 0).astype(np.int64)), pa.array(np.repeat(K.as_long(node), prefix)),
                    pa.array(np.repeat(size, prefix).astype(np.int32)), pa.array(pos.astype(np.int32)),
                    pa.array((key >> TOKEN_BITS & np.uint64(63)) > 0)], names=["token", "node", "n", "pos", "frequent"])

    return df.select(F.col("text").cast("string").alias("text")).mapInArrow(
        run, "token bigint, node bigint, n int, pos int, frequent boolean")


class Seen:
    """Classes met by a task, forgotten beyond a bound; only saves repeated rows."""

    def __init__(self, most: int = 500_000):
        self.nodes, self.most = set(), most

    def first(self, node: np.ndarray) -> np.ndarray:
        if len(self.nodes) > self.most:
            self.nodes.clear()
        out = np.zeros(len(node), dtype=bool)
        for i, x in enumerate(node.tolist()):
            if x not in self.nodes:
                self.nodes.add(x)
                out[i] = True
        return out


def sets_of(df: DataFrame, wanted: K.Bitmap, frequent: Frequent, k: int, percent: int) -> DataFrame:
    """Whole sets of classes in the bitmap, in the second order, and their prefix under the third."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for rows, size, doc, token in shingle_sets(batch.column("text"), k):
                node = node_ids(size, doc, token)
                use = (size > 0) & wanted.has(node)
                use[use] = seen.first(node[use])
                mine = use[doc]
                doc, token, size = (np.cumsum(use) - 1)[doc[mine]], token[mine], size[use]
                rank = frequent.rank(token)
                prefix = needed(size, percent)
                second, third = (ordered(doc, token, rank, i) for i in (1, 2))
                third = third[firsts(size, prefix)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(K.as_long(node[use])), pa.array(prefix.astype(np.int32)),
                    K.lists(unplaced(second, 1).astype(np.int64), doc, len(size), pa.int64()),
                    K.lists(unplaced(third, 2).astype(np.int64), np.repeat(np.arange(len(size)), prefix), len(size), pa.int64())],
                    names=["node", "prefix", "tokens", "third"])

    rows = df.select(F.col("text").cast("string").alias("text")).mapInArrow(
        run, "node bigint, prefix int, tokens array<bigint>, third array<bigint>")
    return rows.groupBy("node").agg(F.first(F.struct("prefix", "tokens", "third")).alias("s")).select("node", "s.*")


def may_meet(a: str, b: str, percent: int) -> Column:
    """Whether a token of two prefixes can be the first that similar sets have in common: sizes ``n_*`` fit, and
    from this place ``pos_*`` on both sets hold as many tokens as they must share."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    overlap = F.floor(((n_a + n_b) * percent + 99 + percent) / (100 + percent))
    return ((n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)
            & (F.col(f"pos_{a}") <= n_a - overlap) & (F.col(f"pos_{b}") <= n_b - overlap))


def common_needed(percent: int) -> Column:
    """Least number of tokens that similar sets of sizes n_a and n_b have in common within their prefixes: where the
    prefix that ends first ends, at most the rest of its own set is still to come."""
    overlap = F.floor(((F.col("n_a") + F.col("n_b")) * percent + 99 + percent) / (100 + percent))
    rest = lambda n: F.floor((F.col(n) * percent + 99) / 100) - 1
    return F.greatest(F.lit(1), overlap - F.greatest(rest("n_a"), rest("n_b")))


def enough_in_common(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes have as many tokens in common as similar sets of their sizes must have. Tokens
    that only one class has are in no list, so they are not sent."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    lists = written(shared.join(ends, "node", "left_semi").groupBy("node").agg(
        F.first("n").alias("n"), F.collect_set("token").alias("tokens")), "prefixes")
    side = lambda x: lists.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(F.size(F.array_intersect("tokens_a", "tokens_b")) >= common_needed(percent)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that meet in the prefixes of all further orders and whose whole sets are similar."""
    side = lambda x: sets.select(*[F.col(c).alias(f"{c}_{x}" if c != "node" else x) for c in sets.columns])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    meets = (F.arrays_overlap(F.slice("tokens_a", F.lit(1), F.col("prefix_a")), F.slice("tokens_b", F.lit(1), F.col("prefix_b")))
             & F.arrays_overlap("third_a", "third_b"))
    similar = common * 100 >= (F.size("tokens_a") + F.size("tokens_b") - common) * percent
    return both.filter(meets).filter(similar).select("a", "b")


def across_components(placed: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b) of different components that one list lets meet. A list of more than ``block`` classes is
    dealt over blocks, and every two blocks meet in a group of their own."""
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / block)
    open_ = written(placed.join(mixed.filter("low <> high").select("token", blocks.alias("blocks")), "token")
                    .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))), "open")
    side = lambda s, i, j: open_.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "root")], i, j)
    own = F.col("own")
    x = side("a", own.alias("i"), F.explode(F.sequence(own, F.col("blocks") - 1)).alias("j"))
    y = side("b", F.explode(F.sequence(F.lit(0).cast("long"), own)).alias("i"), own.alias("j"))
    once = (F.col("i") < F.col("j")) | (F.col("node_a") < F.col("node_b"))
    found = x.join(y, ["token", "i", "j"]).filter(once & (F.col("root_a") != F.col("root_b")) & may_meet("a", "b", percent))
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def leaders(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """At most one partner (b) for each class (a): the leader that most of its lists have in common with it. The
    leader of a list is the class with most tokens in common with others, which stands in the middle of its
    copies; equal ones are ranked by a hash that changes with the round."""
    first = Window.partitionBy("token", "chunk").orderBy(F.desc("degree"), F.xxhash64("node", F.lit(turn)))
    led = lists.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"),
                       F.first(F.struct("node", "n", "pos")).over(first).alias("l"))
    led = led.select("a", "n_a", "pos_a", F.col("l.node").alias("b"), F.col("l.n").alias("n_b"), F.col("l.pos").alias("pos_b"))
    votes = (led.filter("a <> b").groupBy("a", "n_a", "b", "n_b")
             .agg(F.count(F.lit(1)).alias("count"), F.max(may_meet("a", "b", percent)).alias("meet"))
             .filter(F.col("meet") & (F.col("count") >= common_needed(percent))))
    return votes.groupBy("a").agg(F.max(F.struct("count", "b"))["b"].alias("b"))


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Component of each class after more links."""
    to = groups.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    edges = (links.join(groups.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a").join(to, "b")
             .filter("root_a <> root_b").select("root_a", "root_b").distinct())
    roots = components(edges, "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("new"))
    return written(groups.join(roots, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "groups")


def similar_components(documents: DataFrame, doc_id: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: id, row key, n_shingles, component_id (least id of the component), class_id (least id of the same
    set) and component (a number that names it; null for an empty set)."""
    rows = written(signatures(documents, doc_id, k), "signatures")
    top = (rows.select(F.explode("heavy").alias("h")).groupBy("h.token").agg(F.sum("h.count").alias("count"))
           .orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas())
    frequent = Frequent(top["token"].to_numpy(), top["count"].to_numpy())
    docs = rows.filter("n >= 0").select("id", "row", "n", "node")
    classes = docs.filter("n > 0").groupBy("node").agg(F.min("id").alias("class_id"))

    dealt = postings(documents, frequent, k, percent).withColumn(
        "chunk", F.when(F.col("frequent"), F.pmod("node", F.lit(SALTS))).otherwise(0).cast("int"))
    by_token = Window.partitionBy("token", "chunk").orderBy("node")
    whole = by_token.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = written(dealt.select("token", "chunk", "node", "n", "pos", "frequent", F.lag("node").over(by_token).alias("before"),
                                  F.first("node").over(whole).alias("low"), F.last("node").over(whole).alias("high"))
                     .filter("(before is null or before <> node) and (frequent or low <> high)")
                     .select("token", "chunk", "node", "n", "pos"), "shared")
    plain = shared
    shared = written(plain.join(plain.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node"), "ranked")
    discard(plain)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        ends = bitmap_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
        sets = written(sets_of(documents, ends, frequent, k, percent), "sets")
        links = written(verified(pairs, sets, percent), "links")
        discard(sets)
        return links

    groups = written(shared.select("node", F.col("node").alias("root")).distinct(), "groups")
    lists = shared
    for turn in range(LEADER_ROUNDS):
        groups = merged(groups, linked(leaders(lists, turn, percent)))
        lists = (shared.join(groups, "node").groupBy("token", "root").agg(F.max(F.struct("degree", "node", "n", "pos")).alias("m"))
                 .select("token", F.lit(0).alias("chunk"), "m.*"))

    placed = shared.select("token", "node", "n", "pos").join(groups, "node")
    across = written(across_components(placed, percent), "across")
    groups = merged(groups, linked(enough_in_common(across, shared, percent)))

    named = written(groups.join(classes, "node").groupBy("root").agg(F.min("class_id").alias("component_id")), "named")
    member = groups.join(named, "root").select("node", "root", "component_id")
    known = classes.join(member, "node", "left").select("node", "class_id", F.coalesce("root", "node").alias("component"),
                                                        F.coalesce("component_id", "class_id").alias("component_id"))
    return docs.join(written(known, "known"), "node", "left").select(
        F.col("id").alias(doc_id), "row", F.col("n").alias("n_shingles"), "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"))
