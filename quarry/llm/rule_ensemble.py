"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled rows; every path from a root is a rule, a conjunction of bounds on statistics. A
lasso logistic regression gives most rules the weight 0. What remains is compiled into one Spark column expression, so
scoring is a map over whole texts inside the JVM, without a shuffle and without Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that a fit uses at most (chosen by a hash of doc_id), trees, their depth, and the lasso's weight.
MAX_LABELLED, TREES, DEPTH, LASSO = 20_000, 24, 3, 0.002
#: Rows of a node at most asked for, and what part of the rarer label's rows a node must be able to do with.
LEAF, LEAF_PART = 20, 4
PICKS = 1_000_000
THRESHOLD = 0.3
FEATURES = "__quality_features"
_MARKS = "%&$#*|<>{}[]=+~^@\\/_"


def _without(text: Column, chars: str) -> Column:
    """How many characters of a text are among `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by built-in functions, all doubles; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(F.translate(t, "\t\r\n\x0b\x0c", "     "), " "), lambda w: w != "")
    many = F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "word_length": F.length(t) / many,
        "distinct_words": F.size(F.array_distinct(words)) / many,
        "upper": _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        "marks": _without(t, _MARKS) / n,
        "bars": _without(t, "|") / n,
        "calls": _without(t, "!?") / n,
        "stops": _without(t, ".,;:") / n,
        "digits": _without(t, "0123456789") / n,
        "lines": _without(t, "\n") / n,
    }


#: The statistics, in the order of a tree's features.
NAMES = ["log_chars", "word_length", "distinct_words", "upper", "marks", "bars", "calls", "stops", "digits", "lines"]


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, is upper bound, value) that all hold."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self, features: str = FEATURES) -> Column:
        holds = F.lit(True)
        for name, upper, value in self.bounds:
            x = F.col(f"{features}.{name}")
            holds = holds & ((x <= value) if upper else (x > value))
        return holds.cast("double")


def paths(debug: str) -> list[tuple[tuple[int, bool, float], ...]]:
    """The conditions on the way to each node of a tree, from Spark ML's text of it."""
    found, stack = [], []
    for line in debug.splitlines():
        if m := re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (-?[0-9.E+-]+)\)", line):
            stack = stack[: len(m[1])]
            stack += [None] * (len(m[1]) - len(stack)) + [(int(m[3]), m[4] == "<=", float(m[5]))]
            found.append(tuple(c for c in stack if c))
    return found


def simplified(path: tuple[tuple[int, bool, float], ...]) -> Rule:
    """A path's rule, with one upper and one lower bound a statistic."""
    tight: dict[tuple[int, bool], float] = {}
    for i, upper, v in path:
        old = tight.get((i, upper))
        tight[i, upper] = v if old is None else min(old, v) if upper else max(old, v)
    return Rule(tuple((NAMES[i], upper, v) for (i, upper), v in sorted(tight.items())))


@dataclass
class RuleEnsemble:
    """Rules with weights. Without rules, the score is `prior` for every text."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    prior: float | None = None

    def column(self, features: str = FEATURES) -> Column:
        """The score as one expression over the struct of statistics."""
        if self.prior is not None:
            return F.lit(self.prior)
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + rule.column(features) * F.lit(weight)
        return 1.0 / (1.0 + F.exp(-total))

    def scored(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """docs with a score from 0 to 1; a map over rows."""
        stats = F.struct(*[c.cast("double").alias(k) for k, c in statistics(F.col(text_col)).items()])
        return docs.withColumn(FEATURES, stats).withColumn(score_col, self.column()).drop(FEATURES)


def held_out(doc_id: Column) -> Column:
    """The rows that no fit may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fractions(counts: dict[float, int], most: int) -> dict[float, float]:
    """The share of each label's rows that a fit uses: all of the rarer labels that fit into equal parts of `most`.

    What a rare label leaves of its part goes to the more frequent ones. Shares are whole numbers of PICKS.
    """
    out, left = {}, most
    for i, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        share = min(1.0, left // (len(counts) - i) / n)
        out[label] = min(PICKS, int(share * PICKS) + 1) / PICKS
        left -= min(n, left // (len(counts) - i))
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> RuleEnsemble:
    """Learns from labelled rows that are not held out; ids only choose rows, they are no input.

    At most about max_labelled labels are used, so their table may be broadcast; the statistics of only their texts are
    computed. The rarer label keeps all its rows up to half of that bound, the rest is filled with the other label's rows,
    each chosen by a hash of doc_id alike at every size; weights give both their true shares again. The least size of a
    tree's node and the lasso follow the rarer label, so that few bad rows among many good ones can still make a rule; a
    single one cannot. Labels that are null are left out; a doc_id with several labels counts with each. With labels of
    one kind only, the score is their smoothed share; with none, 0.5.
    """
    known = labels.select("doc_id", F.col(label_col).cast("double").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return RuleEnsemble(prior=(counts.get(1.0, 0) + 1) / (total + 2))
    used = fractions(counts, max_labelled)
    of = lambda f: F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(used.items()) for x in (k, f(v))]), F.col("label"))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PICKS)) < of(lambda v: round(v * PICKS))).withColumn("weight", of(lambda v: 1.0 / v))
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "weight", F.struct(*[stats[n].cast("double").alias(n) for n in NAMES]).alias(FEATURES))
    rows = rows.repartition(8).persist()
    try:
        classes = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}
        if len(classes) < 2:
            return RuleEnsemble(prior=(counts.get(1.0, 0) + 1) / (total + 2))
        leaf = max(2, min(LEAF, min(r["n"] for r in classes.values()) // LEAF_PART))
        rare = min(r["weight"] for r in classes.values()) / sum(r["weight"] for r in classes.values())
        vectors = rows.select("label", "weight", array_to_vector(F.array(*[F.col(f"{FEATURES}.{n}") for n in NAMES])).alias("features"))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=leaf, featureSubsetStrategy="onethird", seed=7, weightCol="weight").fit(vectors)
        rules = sorted({simplified(p) for t in forest.trees for p in paths(t.toDebugString)}, key=lambda r: r.bounds)
        if not rules:
            return RuleEnsemble(prior=(counts.get(1.0, 0) + 1) / (total + 2))
        fired = rows.select("label", "weight", array_to_vector(F.array(*[r.column() for r in rules])).alias("features"))
        model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO * min(1.0, 10 * rare), maxIter=60, standardization=False, weightCol="weight").fit(fired)
        return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients, strict=True) if w != 0])
    finally:
        rows.unpersist()


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for each document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = fit(docs, labels).scored(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that a fit on their labels doesn't reject, with their own columns."""
    return fit(docs, labels).scored(docs, score_col="__quality").filter(F.col("__quality") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
