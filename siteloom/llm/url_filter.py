"""URL verdicts by gradient-boosted trees on lexical features, in DataFrame functions only.

Host and path are cut out of the URL, explicit rules decide first (the longest that fits),
and boosted trees judge the rest. They are trained from labelled URLs, at most ``SAMPLE``
of them by URL hash (the documented bound), with Spark's own learner, and become one sum
of nested conditions, so judging is a plain projection. Suffix statistics count all rows:
how frequent the last two host labels are, and how often labelled URLs under them are blocked. A row that is
trained on sees the labels of the other folds of URLs only, never its own. Where the labels are the verdicts of the explicit
rules, as by default, the trees can learn no more than how URLs look that those rules block or allow.

A null URL, or one without ``://``, has an empty host and path; no rule fits it. Repeated rows get
equal results. Without labelled URLs of both kinds the method allows everything.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.scale import lookup_join, written

SAMPLE = 20_000
FOLDS = 5
TREES = 12
DEPTH = 4
STEP = 0.3
ALPHABET = string.ascii_lowercase + string.digits + "/.-_?=&%#:"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host ``host`` and all below it, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
         Rule("allow", "org", "/fr/"))

FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy",
            "params", "query_length", "has_fragment", "secure", "suffix_count", "suffix_blocked"]


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``_url`` (null: empty), ``host`` and ``path`` to the given columns."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return (df.withColumn("_url", u).withColumn("host", F.translate(host, string.ascii_uppercase, string.ascii_lowercase))
            .withColumn("path", path))


def matched(rules: tuple[Rule, ...], what: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits, else null."""
    host, path = F.col("host"), F.col("path")
    column = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        column = F.when(fits, F.lit(getattr(rule, what))).otherwise(column)
    return column


def entropy(text: Column) -> Column:
    """Bits per character over ``ALPHABET``; all other characters count as one."""
    n = F.length(text)
    total, seen = F.lit(0.0), F.lit(0)
    counts = [n - F.length(F.translate(text, c, "")) for c in ALPHABET]
    for count in counts:
        seen = seen + count
    for count in [*counts, n - seen]:
        total = total - F.when(count > 0, (count / n) * F.log2(count / n)).otherwise(0.0)
    return total


def with_features(df: DataFrame) -> DataFrame:
    """Lexical features of ``_url``, ``host`` and ``path``, and the host's ``suffix``."""
    u, host, path = F.lower("_url"), F.col("host"), F.col("path")
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    real = {"url_length": F.length("_url"), "host_length": F.length(host), "path_length": F.length(path),
            "depth": F.length(F.regexp_replace(path, "[^/]", "")), "labels": F.size(F.split(host, r"\.")),
            "digit_ratio": F.when(F.length("_url") > 0, digits("_url") / F.length("_url")).otherwise(0.0),
            "host_digits": digits("host"), "hyphens": F.length(F.regexp_replace(host, "[^-]", "")), "entropy": entropy(u),
            "params": F.when(query != "", F.length(F.regexp_replace(query, "[^&]", "")) + 1).otherwise(0),
            "query_length": F.length(query), "has_fragment": F.col("_url").contains("#").cast("int"),
            "secure": u.startswith("https:").cast("int")}
    return df.withColumns({k: v.cast("double") for k, v in real.items()} | {"suffix": F.substring_index("host", ".", -2)})


def fold() -> Column:
    return F.pmod(F.xxhash64("_url"), F.lit(FOLDS))


def share_blocked(blocked: Column, labelled: Column) -> Column:
    """Share of labelled rows that are blocked, drawn to one half by one row of either kind."""
    return (blocked + 1) / (labelled + 2)


def fold_statistics(df: DataFrame, blocked: str) -> DataFrame:
    """Per suffix and fold, over all rows: rows, labelled rows (non-null ``blocked``) and blocked ones."""
    return df.groupBy("suffix", fold().alias("fold")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(blocked).alias("labelled"), F.coalesce(F.sum(blocked), F.lit(0.0)).alias("blocked"))


def suffix_statistics(folds: DataFrame) -> DataFrame:
    """Per suffix, over all rows: log count, and share of labelled rows that are blocked."""
    return folds.groupBy("suffix").agg(
        F.log1p(F.sum("rows").cast("double")).alias("suffix_count"),
        share_blocked(F.sum("blocked"), F.sum("labelled")).alias("suffix_blocked"))


def out_of_fold(known: DataFrame, folds: DataFrame) -> DataFrame:
    """Training rows with ``suffix_blocked`` from the folds that they are not in."""
    wanted = known.select("suffix", fold().alias("own")).distinct()
    others = (lookup_join(folds, wanted, ["suffix"], "inner").groupBy("suffix", "own").agg(
        share_blocked(F.sum(F.when(F.col("fold") != F.col("own"), F.col("blocked")).otherwise(0.0)),
                      F.sum(F.when(F.col("fold") != F.col("own"), F.col("labelled")).otherwise(0))).alias("suffix_blocked")))
    return known.drop("suffix_blocked").withColumn("own", fold()).join(others, ["suffix", "own"])


def score_of(model) -> Column:
    """The trained trees as one expression; above 0 is class 1."""
    def branch(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.col(FEATURES[split.featureIndex()]) <= float(split.threshold()),
                      branch(node.leftChild())).otherwise(branch(node.rightChild()))

    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        total = total + branch(tree._java_obj.rootNode()) * float(weight)
    return total


def train(rows: DataFrame, blocked: str, folds: DataFrame, sample: int = SAMPLE) -> Column:
    """Score expression from at most ``sample`` distinct pairs of URL and known ``blocked`` (0 or 1), in hash
    order, each weighted by how often it occurs."""
    known = (rows.filter(F.col(blocked).isNotNull()).select("_url", F.col(blocked).cast("double").alias("label"), "suffix", *FEATURES)
             .groupBy("_url", "label", "suffix", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"))
             .orderBy(F.xxhash64("_url"), "_url", "label").limit(sample))
    known = written(out_of_fold(written(known.coalesce(1), "labelled"), folds).coalesce(1).sortWithinPartitions("_url", "label"), "training")
    if known.select("label").distinct().count() < 2:
        return F.lit(0.0)
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, checkpointInterval=-1, weightCol="weight")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known)
    return score_of(learner.fit(vectors.select("features", "label", "weight")))


def judged(df: DataFrame, labelled: Column | None = None, rules: tuple[Rule, ...] = RULES, url: str = "url",
           sample: int = SAMPLE) -> DataFrame:
    """The given rows with host, path, rule, score and verdict. ``labelled`` is 1.0 (blocked), 0.0 or
    null per row; by default the rows that a rule decides are the labelled ones."""
    kept = df.select(F.struct("*").alias("_row"), F.col(url).alias("_given"))
    cut = with_parts(kept, "_given").withColumn("rule", matched(rules, "text")).withColumn("ruled", matched(rules, "verdict"))
    own = F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0) if labelled is None else labelled
    cut = with_features(cut.withColumn("blocked", own))
    folds = written(fold_statistics(cut, "blocked"), "folds")
    full = lookup_join(cut, written(suffix_statistics(folds), "suffixes"), ["suffix"], "left")
    score = train(full, "blocked", folds, sample)
    return full.withColumn("score", score).select(
        "_row", "host", "path", "rule", "score",
        F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))
