"""Quality verdicts by a learned decision list over text statistics.

One pass counts plain statistics of every whole text. Sequential covering then grows
conjunctions of thresholds on ratios of these counts, one rule after another, on two
thirds of a labelled sample: each condition is the one of highest information gain; a grown
rule loses trailing conditions while that raises its worth on the other third, and is kept
only while it is precise there. The list becomes one ordered Spark conditional expression.

The labelled sample is the ``SAMPLE`` documents of lowest id hash (the documented bound); the
counts and verdicts cover all rows. Without labels of both kinds the list is empty and only the
base conditions reject.

Null and empty texts have no words, so they fail the base. Labels that are null are left out, of
several for one document the lowest counts. Rows with a null id are judged, never trained on. Other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siteloom.llm import kernel as K

SAMPLE = 20_000
MIN_WORDS = 50
MAX_REPEAT = 50
CUTS = 48
CONDITIONS = 4
PRECISION = 0.95
LEAST = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]

SYMBOL, UPPER, DIGIT, MARK, LINE = (np.zeros(256, dtype=bool) for _ in range(5))
SYMBOL[list(b"#*$%&|<>")] = UPPER[65:91] = DIGIT[48:58] = MARK[list(b"!?.,;:'\"-")] = True
LINE[:] = True
LINE[10] = False


def packed(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Text number and 54 bits of a hash in one word, for sorting within texts."""
    return (doc.astype(np.uint64) << np.uint64(54)) | (hashes >> np.uint64(10))


def counts(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each group of texts: how many, and the columns of ``COUNTS``."""
    for lo, hi, data, offsets in K.groups(texts):
        rows = hi - lo

        def per_text(flags: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return np.diff(total[at])

        words = K.words_of(data, offsets, K.NOT_SPACE, lower=False)
        inside = K.NOT_SPACE[data]
        lines = K.words_of(data, offsets, LINE, lower=False)
        filled = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
        said = np.flatnonzero(filled[lines.end] > filled[lines.start])
        line_doc = lines.doc[said]
        n_lines = np.bincount(line_doc, minlength=rows)
        distinct = np.unique(packed(line_doc, lines.hash[said])) >> np.uint64(54)
        n_dup = n_lines - np.bincount(distinct.astype(np.int64), minlength=rows)

        gram, first = K.grams(words, 3)
        key = packed(words.doc[first], gram)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = first[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(key) else first
        covered = np.zeros(len(words.hash) + 3, dtype=bool)
        for j in range(3):
            covered[twice + j] = True
        n_repeat = np.bincount(words.doc[covered[:len(words.hash)]], minlength=rows)
        yield rows, [words.per_doc(), per_text(inside & ((data & 0xC0) != 0x80)), per_text(SYMBOL[data]), n_dup, n_repeat,
                     n_lines, per_text(UPPER[data]), per_text(DIGIT[data]), per_text(MARK[data])]


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def counts_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        parts = [np.stack(values).astype(np.int64) for _, values in counts(batch)]
        whole = np.concatenate([np.zeros((len(COUNTS), 0), dtype=np.int64), *parts], axis=1)
        yield pa.StructArray.from_arrays([pa.array(c) for c in whole], COUNTS)


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row as a struct ``doc`` and its counts beside it; columns keep their names inside. Only the text goes through Python."""
    found = df.select(F.struct("*").alias("doc"), counts_of(F.col(text).cast("string")).alias("counts"))
    return found.select("doc", *[F.col("counts")[c].alias(c) for c in COUNTS])


def ratio(above: Column, below: str) -> Column:
    return F.when(F.col(below) > 0, above / F.col(below)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """The ratios that rules may test."""
    c = F.col
    return {"words": c("n_words").cast("double"), "word_length": ratio(c("word_chars"), "n_words"),
            "symbols_per_word": ratio(c("n_symbols"), "n_words"), "dup_line_share": ratio(c("n_dup_lines"), "n_lines"),
            "repeat_share": ratio(c("n_repeat_words"), "n_words"), "words_per_line": ratio(c("n_words"), "n_lines"),
            "upper_share": ratio(c("n_upper"), "word_chars"), "digit_share": ratio(c("n_digits"), "word_chars"),
            "marks_per_word": ratio(c("n_marks"), "n_words")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.cut if self.above else values[self.feature] <= self.cut

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.cut if self.above else x <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, dtype=bool)
    for condition in rule:
        mask &= condition.holds(values)
    return mask


def grow(values: dict[str, np.ndarray], low: np.ndarray, open_: np.ndarray) -> Rule:
    """Add the condition of highest gain until no good document is covered."""
    rule, mask = (), open_.copy()
    while len(rule) < CONDITIONS and (mask & ~low).any() and (mask & low).any():
        before = np.log2((mask & low).sum() / mask.sum())
        best = (1e-9, None, None)
        for name, x in values.items():
            own = np.unique(x[mask])
            cuts = (own[1:] + own[:-1]) / 2
            if len(cuts) > CUTS:
                cuts = np.unique(np.quantile(x[mask], np.linspace(0, 1, CUTS + 2)[1:-1]))
                hard = np.unique(np.quantile(x[mask & low], np.linspace(0, 1, CUTS // 2 + 2)))
                cuts = np.unique(np.concatenate([cuts, hard]))
            for cut in cuts:
                for above in (True, False):
                    part = mask & ((x > cut) if above else (x <= cut))
                    p, n = int((part & low).sum()), int((part & ~low).sum())
                    gain = p * (np.log2(p / (p + n)) - before) if p else 0.0
                    if gain > best[0]:
                        best = (gain, Condition(name, above, float(cut)), part)
        if best[1] is None:
            break
        rule, mask = (*rule, centred(best[1], values[best[1].feature][mask])), best[2]
    return rule


def centred(condition: Condition, x: np.ndarray) -> Condition:
    """The same split, with the cut in the middle of the gap around it."""
    below, above = x[x <= condition.cut], x[x > condition.cut]
    if not len(below) or not len(above):
        return condition
    return Condition(condition.feature, condition.above, float(below.max() + above.min()) / 2)


def worth(rule: Rule, values: dict[str, np.ndarray], low: np.ndarray, open_: np.ndarray) -> tuple[float, int, int]:
    mask = covers(rule, values, len(low)) & open_
    p, n = int((mask & low).sum()), int((mask & ~low).sum())
    return (p - n) / (p + n) if p + n else -1.0, p, n


def learn(values: dict[str, np.ndarray], low: np.ndarray) -> list[Rule]:
    """Ordered rules for low quality; what none of them covers is kept."""
    held = np.arange(len(low)) % 3 == 2
    open_grow, open_prune = ~held, held.copy()
    rules: list[Rule] = []
    while (low & open_grow).sum() >= LEAST:
        rule = grow(values, low, open_grow)
        shorter = [rule[:i] for i in range(len(rule), 0, -1)]
        if not shorter:
            break
        rule = max(shorter, key=lambda r: (worth(r, values, low, open_prune)[0], len(r)))
        grown, pruned = worth(rule, values, low, open_grow), worth(rule, values, low, open_prune)
        if grown[1] < LEAST or pruned[1] < LEAST // 2 or any(p < PRECISION * (p + n) for _, p, n in (grown, pruned)):
            break
        rules.append(rule)
        mask = covers(rule, values, len(low))
        open_grow &= ~mask
        open_prune &= ~mask
    return rules


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id",
          text: str = "text") -> list[Rule]:
    """Rules from at most ``sample`` labelled documents, chosen by id hash; the same rows give the same rules."""
    chosen = (labels.select(F.col(doc_id).alias("id"), F.col("quality").cast("int").alias("quality"))
              .filter("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    named = [e.alias(name) for name, e in features().items()]
    table = (counted(rows).select(F.col("doc.id").alias("id"), F.col("doc.quality").alias("quality"), *named)
             .orderBy(F.xxhash64("id"), "id", *features()).limit(sample).toPandas())
    low = (table["quality"] == 0).to_numpy(dtype=bool)
    if not low.any() or low.all():
        return []
    return learn({name: table[name].to_numpy(dtype=float) for name in features()}, low)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 where none does and the text is kept."""
    column = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        column = F.when(test, i).otherwise(column)
    return column


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)


def judged(documents: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Every row as ``doc``, its counts, base_failed, the rule that rejects it (0: none), and kept."""
    return (counted(documents, text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def filtered(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base nor a rule rejects, with their own columns."""
    return judged(documents, train(documents, labels)).filter("kept").select("doc.*")
