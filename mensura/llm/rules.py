"""Quality classifier: a sparse ensemble of rules.

Text statistics are column expressions. Small trees are grown on a bounded
sample of labelled rows; every path of a tree is a rule, a conjunction of
comparisons of statistics with thresholds. A logistic regression with an L1
penalty weighs the rules and drops most of them. What is left is compiled
into one column expression, so scoring is a scan without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import apart, SPACES, stage_table, text_or_empty

#: Bound of the labelled rows that a fit uses.
MAX_LABELS = 20_000
TREES = 24
TREE_DEPTH = 3
PENALTY = 0.002
THRESHOLD = 0.7
SEED = 11
_SCALE = 1 << 20

#: A rule: comparisons (statistic, at most?, threshold), all of which hold.
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, named; an empty text gives zeros."""
    chars = F.char_length(text)
    words = F.col("_words")

    def share(n: Column, of: Column) -> Column:
        return F.when(of > 0, n.cast("double") / of).otherwise(F.lit(0.0))

    def among(characters: str) -> Column:
        return share(chars - F.char_length(F.translate(text, characters, "")), chars)

    def matching(runs: str) -> Column:
        """Share of the characters in such runs; cheaper than counting matches."""
        return share(chars - F.char_length(F.regexp_replace(text, F.lit(runs), F.lit(""))), chars)

    n_words = F.size(words)
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(F.char_length(F.translate(text, SPACES, "")), n_words),
        "distinct_words": share(F.col("_distinct"), n_words),
        "variety": F.when(n_words > 1, F.log(F.col("_distinct").cast("double"))
                          / F.log(n_words.cast("double"))).otherwise(F.lit(0.0)),
        "distinct_lines": share(F.size(F.array_distinct(F.split(text, "\n"))), F.size(F.split(text, "\n"))),
        "upper": matching(r"\p{Lu}+"),
        "letters": matching(r"\p{L}+"),
        "digits": among("0123456789"),
        "marks": among("#*$%&@^~=+_<>\\"),
        "bars": among("|"),
        "shouts": among("!?"),
        "stops": among(".,;:"),
        "lines": share(F.char_length(text) - F.char_length(F.translate(text, "\n", "")), n_words),
    }


NAMES = ["log_words", "word_length", "distinct_words", "variety", "distinct_lines", "upper", "letters", "digits",
         "marks", "bars", "shouts", "stops", "lines"]


def with_statistics(docs: DataFrame, prefix: str = "_s_") -> DataFrame:
    """Add the statistics of ``text`` (null: empty) to every row. Columns of
    ``docs`` must not begin with an underscore (``common.apart``).

    They come out of a generator of one row, so that a filter on a score is
    never pushed below them, where each rule would compute its statistics
    from the text again."""
    spaced = F.trim(F.translate(F.lower("_text"), SPACES, " " * len(SPACES)))
    d = docs.withColumn("_text", text_or_empty()).withColumn("_words", F.array_remove(F.split(spaced, " "), ""))
    d = d.withColumn("_distinct", F.size(F.array_distinct("_words")))
    stats = statistics(F.col("_text"))
    row = F.struct(*[stats[n].cast("double").alias(prefix + n) for n in NAMES])
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(row)))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


@dataclass
class RuleModel:
    """Weights of rules and an intercept."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, prefix: str = "_s_") -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, prefix), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def holds(rule: Rule, prefix: str = "_s_") -> Column:
    out = None
    for name, at_most, value in rule:
        c = F.col(prefix + name) <= value if at_most else F.col(prefix + name) > value
        out = c if out is None else out & c
    return out


def tree_rules(tree, names: list[str]) -> set[Rule]:
    """Conjunctions on the paths from a tree's root to each of its nodes."""
    out: set[Rule] = set()

    def simplified(path: tuple) -> Rule:
        bounds: dict[tuple[str, bool], float] = {}
        for name, at_most, value in path:
            k = (name, at_most)
            bounds[k] = value if k not in bounds else (min if at_most else max)(bounds[k], value)
        return tuple(sorted((n, m, v) for (n, m), v in bounds.items()))

    def walk(node, path: tuple) -> None:
        if path:
            out.add(simplified(path))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, value = names[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), (*path, (name, True, value)))
        walk(node.rightChild(), (*path, (name, False, value)))

    walk(tree._java_obj.rootNode(), ())
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, trees: int = TREES,
        tree_depth: int = TREE_DEPTH, penalty: float = PENALTY, seed: int = SEED) -> RuleModel:
    """Learn from labelled rows that are not held out: about ``max_labels``
    of them, picked by a hash of the id (all, if fewer).

    ``labels``: ``doc_id`` and ``quality`` (0 or 1; others are ignored). With
    labels of one kind only, or none, every text gets the same score: the
    share of label 1, or 1 without any label. A null or empty text is learnt
    from as an empty one, a long one whole; a labelled doc_id that several rows
    have counts once for each, and one with both labels once for each label.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
                          ).select("doc_id", F.col("quality").cast("double").alias("label")).distinct()
    n = known.count()
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(_SCALE)) < int(_SCALE * min(1.0, max_labels / max(n, 1)))
    sample = stage_table(known.filter(part), "labels")
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    rows = with_statistics(texts.join(sample, texts["_id"] == sample["doc_id"])).select(
        "label", *[F.col("_s_" + c) for c in NAMES])
    vector = VectorAssembler(inputCols=["_s_" + c for c in NAMES], outputCol="features")
    rows = stage_table(rows, "statistics")
    kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return RuleModel(intercept=-30.0 if set(kinds) == {0.0} else 30.0)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=tree_depth, seed=seed, featureSubsetStrategy="onethird", subsamplingRate=0.5,
        minInstancesPerNode=max(1, sum(kinds.values()) // 1000)).fit(vector.transform(rows))
    found = sorted(set().union(*(tree_rules(t, NAMES) for t in forest.trees)))
    if not found:
        return RuleModel(intercept=math.log(kinds[1.0] / kinds[0.0]))
    ruled = rows.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(found)])
    flags = VectorAssembler(inputCols=[f"r{i}" for i in range(len(found))], outputCol="features")
    ruled = stage_table(flags.transform(ruled).select("label", "features"), "rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=True).fit(ruled)
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(found, weights) if w != 0.0])


def score(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from
    ``threshold`` on). Every row is scored from its whole text alone; a null
    text counts as empty. Columns of those names are replaced."""
    docs, names = apart(docs.drop("held_out", "score", "predicted"))
    scored = with_statistics(docs).withColumn("_score", model.score())
    return scored.select(
        *names, held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, unchanged.

    Each row is judged by its whole text, however long: repeated rows stay or
    go together, a null text counts as empty, a null doc_id does not matter,
    and an empty table gives an empty result."""
    docs, columns = apart(docs)
    scored = with_statistics(docs).withColumn("_score", model.score())
    return scored.filter(F.col("_score") >= threshold).select(*columns)
