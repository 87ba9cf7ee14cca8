"""A sparse rule ensemble for document quality.

Shallow trees grown on text statistics give paths; each path is a conjunctive rule. A lasso logistic regression over the
rules' truth values keeps a few of them with a weight each, and the kept rules compile into one Spark column expression,
so scoring is a projection of the scan: no user function, no shuffle, nothing collected.

Learning reads at most ``sample`` labelled rows (the ones with the smallest hash of the id, a fixed choice); everything
else covers all rows. Null texts count as empty and are scored like any other. Labels other than 0 and 1, or without an
id, take no part; of several labels of one document the smallest counts. Without rows of both classes the score is the
share of good labels (0.5 without any). Repeated rows, and columns beyond those named, do not matter.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityframe.llm import text as T
from entityframe.llm.quality_rules import stop_words

SAMPLE = 20_000
PREDICT_FROM = 0.3
FOLDS = 5
_PREFIX = "__f_"


def statistics(text: Column) -> dict[str, dict[str, Column]]:
    """Two projections: the counts taken from a text, and the statistics made of those."""
    words = F.col("__words")
    n, chars = F.col("__n"), F.col("__chars")
    return {
        "split": {"__words": T.words(text), "__lines": T.lines_with_words(text), "__text": T.whole(text)},
        "count": {
            "__n": T.long_size(words),
            "__chars": F.length("__text"),
            "__marks": T.count_of(F.col("__text"), r"[#*$%&|<>!?=+~^{}\[\]\\]"),
            "__upper": T.count_of(F.col("__text"), r"\p{Lu}"),
            "__digits": T.count_of(F.col("__text"), r"[0-9]"),
            "__stops": stop_words(words),
            "__lines_n": T.long_size(F.col("__lines")),
            "__dup_lines": T.repeats(F.col("__lines")),
            "__same_next": T.long_size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i + 1) == w, F.lit(False)))),
            "__repeats": T.repeats(words),
            "__longest": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)),
        },
        "share": {
            "log_words": F.log1p(n.cast("double")),
            "mean_word": T.ratio(chars, n),
            "longest_word": F.log1p(F.col("__longest").cast("double")),
            "marks": T.ratio(F.col("__marks"), n),
            "upper": T.ratio(F.col("__upper"), chars),
            "digits": T.ratio(F.col("__digits"), chars),
            "stop_words": T.ratio(F.col("__stops"), n),
            "dup_lines": T.ratio(F.col("__dup_lines"), F.col("__lines_n")),
            "line_words": T.ratio(n, F.col("__lines_n")),
            "same_next": T.ratio(F.col("__same_next"), n),
            "words_per_root": T.ratio(n - F.col("__repeats"), F.sqrt(n.cast("double"))),
        },
    }


FEATURES = (
    "log_words", "mean_word", "longest_word", "marks", "upper", "digits", "stop_words", "dup_lines", "line_words", "same_next", "words_per_root",
)


def with_statistics(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    parts = statistics(F.col("__t"))
    out = docs.select(*keep, F.col(text).alias("__t"))
    out = out.select(*keep, *[c.alias(n) for n, c in parts["split"].items()])
    out = out.select(*keep, *[c.alias(n) for n, c in parts["count"].items()])
    return out.select(*keep, *[c.alias(_PREFIX + n) for n, c in parts["share"].items()])


@dataclass(frozen=True)
class Term:
    feature: str
    at_most: bool
    threshold: float

    def holds(self) -> Column:
        value = F.col(_PREFIX + self.feature)
        return value <= F.lit(self.threshold) if self.at_most else value > F.lit(self.threshold)


Rule = tuple[Term, ...]


@dataclass(frozen=True)
class Model:
    """Kept rules with their weights; ``score`` is the logistic of their sum."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(_all(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for term in rule:
        out = out & term.holds()
    return out


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_paths(described: str) -> list[Rule]:
    """Every root path of the trees in a model's description, as a rule; each rule once, in order."""
    found: dict[Rule, None] = {}
    stack: list[tuple[int, Term]] = []
    for line in described.splitlines():
        if not (m := _SPLIT.match(line)):
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, Term(FEATURES[int(m[3])], m[4] == "<=", float(m[5]))))
        found[_tidy(tuple(t for _, t in stack))] = None
    return list(found)


def _tidy(rule: Rule) -> Rule:
    """One term per feature and side, the tightest, so that equal rules look equal."""
    best: dict[tuple[str, bool], float] = {}
    for t in rule:
        at = (t.feature, t.at_most)
        best[at] = (min if t.at_most else max)(best.get(at, t.threshold), t.threshold)
    return tuple(Term(f, side, v) for (f, side), v in sorted(best.items()))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    sample: int = SAMPLE, trees: int = 16, depth: int = 3, lasso: float = 0.001, seed: int = 7,
) -> Model:
    """Fit the ensemble on at most ``sample`` labelled documents whose fold is not 0."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
    known = known.filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (fold(F.col("__id")) != 0))
    known = known.groupBy("__id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # The sample has at most `sample` rows of 12 bytes, whatever the size of the tables: sure to fit a broadcast.
    own = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__own")).join(F.broadcast(known), "__id")
    rows = with_statistics(own, ["__y"], "__own").toDF("label", *FEATURES).repartition(4)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features", *FEATURES).cache()
    try:
        counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(counts) < 2:
            share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
            share = min(max(share, 0.001), 0.999)
            return Model(math.log(share / (1 - share)), ())
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=seed)
        rules = tree_paths(forest.fit(rows).toDebugString)
        truths = [F.when(_all(rule), 1.0).otherwise(0.0).alias(f"r{i}") for i, rule in enumerate(rules)]
        named = rows.select("label", *[F.col(f).alias(_PREFIX + f) for f in FEATURES]).select("label", *truths)
        active = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="active").transform(named)
        fit = LogisticRegression(featuresCol="active", regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(active.select("label", "active"))
        weights = [float(w) for w in fit.coefficients.toArray()]
        return Model(float(fit.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9))
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``held_out`` (fold 0), ``score`` and ``predicted``."""
    rows = with_statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__own")), ["doc_id"], "__own")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    scored = rows.select("doc_id", held.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
