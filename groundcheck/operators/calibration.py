"""Threshold searches on development labels, ordinal severity metrics and topic splits."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.functions import scores as S
from groundcheck.operators import rules
from groundcheck.operators.ranks import numbered
from groundcheck.schema import LABELS, SEVERITIES


def threshold_grid(step: float = 0.05) -> list[float]:
    """Multiples of the step in [0, 1], at 10 decimals, and 1."""
    if not 0 < step <= 1:
        raise ValueError("step must be in (0, 1]")
    return sorted({*(round(i * step, 10) for i in range(int(1 / step + 1e-9) + 1)), 1.0})


def _checked(values: list[float] | None) -> list[float]:
    """Candidates in rising order."""
    values = sorted(set(threshold_grid() if values is None else values))
    if not values or any(not 0 <= v <= 1 for v in values):
        raise ValueError("candidates must be in [0, 1], and there must be one")
    return values


def _passed(strength: Column, values: list[float]) -> Column:
    """How many of the rising candidates a strength reaches."""
    return reduce(lambda n, v: n + (strength >= v).cast("int"), values, F.lit(0))


def check_observations(observations: DataFrame, key: list[str]) -> None:
    """Raise unless keys are unique and scores are in [0, 1]."""
    scores = [rules.Rule(f"{c} out of range", ~S.in_unit(F.col(c))) for c in ("support_score", "contradiction_score")]
    rules.require(rules.violations(observations, scores, key))
    rules.require(rules.repeated(observations, key, "repeated key"))


def verification_grid(observations: DataFrame, values: list[float] | None = None) -> DataFrame:
    """Accuracy, macro-F1, balanced accuracy and coverage of every pair of thresholds.

    ``observations`` has ``support_score, contradiction_score, gold_label``.
    Only the greater score can win, and only if it reaches its threshold, so
    claims are counted once by (winner, candidates reached, gold): some hundred
    rows whatever the input.  The pairs are evaluated on those counts.  Scores
    are taken over the labels that occur in gold.
    """
    values = _checked(values)
    s, c = F.col("support_score"), F.col("contradiction_score")
    winner = F.when(s > c, "supported").when(c > s, "contradicted").otherwise("unknown")
    counts = observations.groupBy("gold_label", winner.alias("winner"), _passed(F.greatest(s, c), values).alias("reached")).agg(F.count("*").alias("n"))
    spark, ranks = observations.sparkSession, list(enumerate(values, 1))
    grid = spark.createDataFrame([(a, b, i, j) for i, a in ranks for j, b in ranks], "support_threshold double, contradiction_threshold double, i int, j int")
    needed = F.when(F.col("winner") == "supported", F.col("i")).when(F.col("winner") == "contradicted", F.col("j"))
    label = F.when(F.col("reached") >= needed, F.col("winner")).otherwise("unknown")
    cells = _cells(F.broadcast(grid).crossJoin(counts).withColumn("predicted", label), ["support_threshold", "contradiction_threshold"], "gold_label", "predicted", LABELS)
    m = _Matrix(len(LABELS))
    return cells.select("support_threshold", "contradiction_threshold", m.accuracy().alias("accuracy"), m.mean_f1(gold_only=True).alias("macro_f1"), m.mean_recall().alias("balanced_accuracy"), m.total.alias("sample_size"), (1 - m.columns[LABELS.index("unknown")] / m.total).alias("coverage"))


def _cells(rows: DataFrame, by: list[str], gold: str, predicted: str, labels: tuple[str, ...]) -> DataFrame:
    """A row per group with the whole confusion matrix as columns ``c_i_j``; ``n`` counts what a row stands for."""
    cell = lambda a, b: F.sum(F.when((F.col(gold) == a) & (F.col(predicted) == b), F.col("n")).otherwise(0))
    return rows.groupBy(*by).agg(*(cell(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(labels) for j, b in enumerate(labels)))


class _Matrix:
    """Column expressions on the confusion matrix ``c_i_j`` of a row (gold i, predicted j)."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.cell = [[F.col(f"c_{i}_{j}") for j in range(size)] for i in range(size)]
        add = lambda xs: reduce(lambda a, b: a + b, xs)
        self.rows = [add(row) for row in self.cell]
        self.columns = [add([row[j] for row in self.cell]) for j in range(size)]
        self.total = add(self.rows)
        self.add = add

    def accuracy(self) -> Column:
        return self.add([self.cell[i][i] for i in range(self.size)]) / self.total

    def _mean(self, value, used) -> Column:
        on = [used(i) for i in range(self.size)]
        return F.try_divide(self.add([F.when(o, value(i)).otherwise(0.0) for i, o in enumerate(on)]), self.add([o.cast("int") for o in on]))

    def mean_f1(self, gold_only: bool) -> Column:
        both = lambda i: self.rows[i] + self.columns[i]
        return self._mean(lambda i: 2 * self.cell[i][i] / F.nullif(both(i), F.lit(0)), lambda i: (self.rows[i] if gold_only else both(i)) > 0)

    def mean_recall(self) -> Column:
        return self._mean(lambda i: self.cell[i][i] / F.nullif(self.rows[i], F.lit(0)), lambda i: self.rows[i] > 0)

    def quadratic_kappa(self) -> Column:
        """Null where no disagreement is expected."""
        pairs = [(i, j) for i in range(self.size) for j in range(self.size) if i != j]
        weight = lambda i, j: ((i - j) / (self.size - 1)) ** 2
        observed = self.add([weight(i, j) * self.cell[i][j] for i, j in pairs])
        expected = self.add([weight(i, j) * self.rows[i] * self.columns[j] for i, j in pairs])
        return F.when(expected != 0, 1 - observed * self.total / F.nullif(expected, F.lit(0.0)))


def best_verification_thresholds(grid: DataFrame, objective: str = "macro_f1") -> DataFrame:
    """The best row: objective, accuracy, coverage, nearness to the defaults; then the smaller thresholds."""
    if objective not in ("macro_f1", "balanced_accuracy"):
        raise ValueError("objective must be 'macro_f1' or 'balanced_accuracy'")
    away = F.abs(F.col("support_threshold") - S.SUPPORT_THRESHOLD) + F.abs(F.col("contradiction_threshold") - S.CONTRADICTION_THRESHOLD)
    exact = lambda c: F.desc(F.round(c, 12))
    return grid.orderBy(exact(objective), exact("accuracy"), exact("coverage"), F.round(away, 12), "support_threshold", "contradiction_threshold").limit(1)


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``by, gold, predicted, n`` for all 16 cells of every group that occurs."""
    flat = _cells(pairs.withColumn("n", F.lit(1)), by, "gold", "predicted", SEVERITIES)
    cells = F.array(*(F.struct(F.lit(a).alias("gold"), F.lit(b).alias("predicted"), F.col(f"c_{i}_{j}").alias("n")) for i, a in enumerate(SEVERITIES) for j, b in enumerate(SEVERITIES)))
    return flat.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def severity_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, macro-F1 over labels in gold or predictions, quadratic-weighted kappa and sample size.

    ``pairs`` has ``gold, predicted``, and ``n`` where a row stands for several claims.
    """
    m = _Matrix(len(SEVERITIES))
    counted = pairs if "n" in pairs.columns else pairs.withColumn("n", F.lit(1))
    flat = _cells(counted, by, "gold", "predicted", SEVERITIES)
    return flat.where(m.total > 0).select(*by, m.accuracy().alias("accuracy"), m.mean_f1(gold_only=False).alias("macro_f1"), m.total.alias("sample_size"), m.quadratic_kappa().alias("quadratic_weighted_kappa"))


def severity_pairs(facts: DataFrame, gold: DataFrame, key: list[str], strict: bool = True) -> DataFrame:
    """Gold and predicted severity of claims with a gold severity.

    A labelled claim without a prediction is an error; ``strict=False`` leaves it out.
    """
    pairs = gold.where(F.col("gold_severity").isNotNull()).select(*key, F.col("gold_severity").alias("gold")).join(facts.select(*key, F.col("severity").alias("predicted")), key, "left")
    if not strict:
        return pairs.where(F.col("predicted").isNotNull())
    message = F.concat(F.lit("no predicted severity for labelled claim "), F.concat_ws("/", *key))
    return pairs.withColumn("predicted", F.coalesce("predicted", F.raise_error(message).cast("string")))


def severity_grid(observations: DataFrame, values: list[float] | None = None) -> DataFrame:
    """Severity metrics for every cutoff; observations have ``claim_text, label, contradiction_score, gold_severity``.

    Only the cutoff differs between candidates: claims are counted once by
    label, candidates reached, domains and advice, and those counts are judged.
    """
    values = _checked(values)
    rows = observations.where(F.col("gold_severity").isNotNull() & (F.col("label") != "supported"))
    ruled = rows.select("label", _passed(F.col("contradiction_score"), values).alias("reached"), F.col("gold_severity").alias("gold"), S.risk_domains(F.col("claim_text")).alias("domains"), S.gives_advice(F.col("claim_text")).alias("advice"))
    counts = ruled.groupBy("label", "reached", "gold", "domains", "advice").agg(F.count("*").alias("n"))
    cutoffs = observations.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values, 1)], "threshold double, k int")
    level, _ = S.severity(F.col("label"), F.col("reached"), F.col("domains"), F.col("advice"), 0.0, F.col("k"))
    return severity_metrics(F.broadcast(cutoffs).crossJoin(counts).select("threshold", "gold", "n", level.alias("predicted")), ["threshold"])


def best_severity_threshold(grid: DataFrame) -> DataFrame:
    """The best row: macro-F1, accuracy, kappa (null last), nearness to the default; then the smaller cutoff."""
    exact = lambda c: F.desc(F.round(c, 12))
    return grid.orderBy(exact("macro_f1"), exact("accuracy"), exact(F.coalesce("quadratic_weighted_kappa", F.lit(-1.0))), F.round(F.abs(F.col("threshold") - S.HIGH_CONTRADICTION), 12), "threshold").limit(1)


def split_sizes(n: int, development: float, test: float) -> tuple[int, int]:
    """Topics for development and test, at least one each, rounded half to even."""
    for fraction in (development, test):
        if not 0 < fraction < 1:
            raise ValueError("fractions must be in (0, 1)")
    if development + test >= 1:
        raise ValueError("fractions must sum to less than 1")
    if n < 3:
        raise ValueError("at least three topics are needed")
    dev, tst = max(1, round(n * development)), max(1, round(n * test))
    if dev + tst >= n:
        raise ValueError("fractions leave no topic for training")
    return dev, tst


def topic_split(items: DataFrame, development: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Each item's split; topics stay whole and are shuffled by Python's seeded generator.

    The distinct topics (few by nature) are listed on the driver.
    """
    if items.where(F.coalesce(F.trim("topic") == "", F.lit(True)) | F.coalesce(F.trim("dataset_item_id") == "", F.lit(True))).limit(1).count():
        raise ValueError("item ids and topics must not be blank")
    topics = sorted(r.topic for r in items.select("topic").distinct().collect())
    dev, tst = split_sizes(len(topics), development, test)
    random.Random(seed).shuffle(topics)
    named = [(t, "test" if k < tst else "dev" if k < tst + dev else "train") for k, t in enumerate(topics)]
    return items.join(F.broadcast(items.sparkSession.createDataFrame(named, "topic string, split string")), "topic")


def topic_split_hash(items: DataFrame, development: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """The same sizes with topics ordered by md5 of seed and topic: another assignment, all in the plan."""
    topics = items.select("topic").distinct().withColumn("drawn", F.md5(F.concat(F.lit(f"{seed}|"), F.col("topic"))))
    topics = numbered(topics, ["drawn", "topic"]).withColumn("k", F.col("k") + 1)
    n = items.agg(F.count_distinct("topic").alias("n"))
    size = lambda f: F.greatest(F.lit(1), F.bround(F.col("n") * f)).cast("int")
    split = F.when(F.col("k") <= size(test), "test").when(F.col("k") <= size(test) + size(development), "dev").otherwise("train")
    return items.join(F.broadcast(topics.crossJoin(n).select("topic", split.alias("split"))), "topic")
