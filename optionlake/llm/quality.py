"""Quality classifier: a sparse rule ensemble over text statistics.

Paths of shallow trees become conjunctive rules, a lasso logistic regression weights them, and
the rules that keep a weight are compiled to one Spark column expression. The trees and weights
are fitted on a sample of at most ``max_rows`` labelled documents, chosen by a hash of doc_id; the
expression scores every whole text. Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts are scored like any other (all statistics 0). Rows without a label, or with
a null one, are not learned from. With fewer than two classes the score is the mean label, or 0.5
without any. Repeated rows are scored each; extra columns of the table are kept or ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optionlake.llm.measures import COUNTS, with_measures
from optionlake.sources.stages import StageTables

#: Statistics of a text, from its measurements.
STATISTICS = {
    "words": "ln(1 + {p}n_words)",
    "word_length": "{p}word_chars / greatest({p}n_words, 1)",
    "distinct_words": "{p}n_distinct_words / greatest({p}n_words, 1)",
    "repeat_words": "{p}n_repeat_words / greatest({p}n_words, 1)",
    "dup_lines": "{p}n_dup_lines / greatest({p}n_lines, 1)",
    "line_words": "ln(1 + {p}n_words / greatest({p}n_lines, 1))",
    "symbols": "{p}n_symbols / greatest({p}word_chars, 1)",
    "capitals": "{p}n_upper / greatest({p}n_upper + {p}n_lower, 1)",
    "digits": "{p}n_digits / greatest({p}word_chars, 1)",
    "marks": "{p}n_marks / greatest({p}n_words, 1)",
    "bars": "{p}n_bars / greatest({p}n_words, 1)",
    "ends": "{p}n_ends / greatest({p}n_words, 1)",
}
_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)$")


@dataclass(frozen=True)
class QualitySettings:
    """``max_rows`` bounds the labelled sample; ``cut`` is the score from which a text is good."""

    max_rows: int = 20_000
    trees: int = 24
    depth: int = 3
    lasso: float = 0.0005
    cut: float = 0.3


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, holder: str = "") -> Column:
        """The probability of label 1, over columns (or fields of a struct) named like STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            if holder:
                rule = re.sub(r"([a-z_]+) (<=|>)", rf"{holder}.\1 \2", rule)
            total = total + F.when(F.expr(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(text: str, names: list[str]) -> list[str]:
    """Every path prefix of a forest, as SQL conjunctions, from its printed form."""
    rules: dict[str, None] = {}
    path: list[tuple[int, str]] = []
    for line in text.splitlines():
        found = _SPLIT.match(line)
        if found:
            depth = len(found[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, f"{names[int(found[3])]} {found[4]} {float(found[5])!r}D"))
            rules[" AND ".join(sorted({p[1] for p in path}))] = None
        elif line.strip().startswith("Tree "):
            path = []
    return list(rules)


def fit_rules(sample: DataFrame, settings: QualitySettings) -> RuleModel:
    """``sample`` has the statistics and a double ``label`` of 0 or 1."""
    names = list(STATISTICS)
    sums = sample.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not sums.n or sums.ones in (0, sums.n):
        mean = 0.5 if not sums.n else min(max(sums.ones / sums.n, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(mean / (1 - mean)))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(sample)
    forest = RandomForestClassifier(
        numTrees=settings.trees, maxDepth=settings.depth, maxBins=64, seed=7,
        featureSubsetStrategy="onethird").fit(data.select("features", "label"))
    rules = tree_rules(forest.toDebugString, names)
    columns = [F.expr(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features")
    model = LogisticRegression(regParam=settings.lasso, elasticNetParam=1.0, maxIter=60).fit(
        matrix.transform(sample.select("label", *columns)).select("features", "label"))
    weights = {r: float(w) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w}
    return RuleModel(float(model.intercept), weights)


def _statistics(prefix: str) -> list[Column]:
    return [F.expr(f"cast({e.format(p=prefix)} as double)").alias(n) for n, e in STATISTICS.items()]


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column,
                    settings: QualitySettings) -> DataFrame:
    """(doc_id, text, label): a bounded sample of the labelled rows for which ``learn`` holds."""
    chosen = labels.select("doc_id", F.col("quality").cast("double").alias("label")).filter(
        F.col("label").isin(0.0, 1.0) & learn).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(
            settings.max_rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id")


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column,
            settings: QualitySettings = QualitySettings()) -> RuleModel:
    sample = with_measures(labelled_sample(docs, labels, learn, settings))
    table = StageTables(spark).get("sample", lambda: sample.select(
        "label", *_statistics("")).coalesce(8))
    return fit_rules(table.persist(), settings)


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with its own columns and, last, its score; the name is made free if it is taken."""
    prefix = "m_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "m" + prefix
    rows = with_measures(docs, prefix)
    rows = rows.select(*docs.columns, F.struct(*_statistics(prefix)).alias(prefix + "all"))
    name = "quality_score"
    while name in docs.columns:
        name = "_" + name
    return rows.select(*docs.columns, model.score(prefix + "all").alias(name))
