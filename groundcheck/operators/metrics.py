"""Per-model quality: rates, severity, agreement with gold labels, retrieval recall and confidence calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.functions import scores as S
from groundcheck.operators.trust import trust_formula
from groundcheck.schema import CLAIM_KEY, LABELS, RESPONSE_KEY, SEVERITIES

BUCKETS = 10


def label_rates(facts: DataFrame, responses: DataFrame) -> DataFrame:
    """Counts and rates of every model, those without claims too (rates are null then)."""
    of = lambda k: F.count_if(F.col("label") == k)
    claims = facts.groupBy("model_name").agg(
        F.count("*").alias("claim_count"),
        *(of(k).alias(f"{k}_count") for k in LABELS),
        *(F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES),
        F.sum(F.coalesce(S.by_severity(F.col("severity"), S.ERROR_WEIGHTS), F.lit(0))).alias("weight"),
    )
    counts = [f"{k}_count" for k in (*LABELS, *SEVERITIES)]
    models = responses.groupBy("model_name").agg(F.count("*").alias("response_count"), F.count_distinct("dataset_item_id").alias("dataset_item_count"))
    out = models.join(claims, "model_name", "left").fillna(0, ["claim_count", "weight", *counts])
    rate = lambda c: F.try_divide(F.col(c), F.col("claim_count"))
    return out.withColumns({f"{k}_rate": rate(f"{k}_count") for k in LABELS} | {"hallucination_rate": rate("contradicted_count"), "severity_weighted_error_rate": F.try_divide(F.col("weight"), 8 * F.col("claim_count"))}).drop("weight")


def severity_distribution(facts: DataFrame) -> DataFrame:
    """``model_name`` and a count for each of the four levels."""
    counts = facts.groupBy("model_name").pivot("severity", list(SEVERITIES)).count()
    return counts.fillna(0, list(SEVERITIES))


def gold_pairs(facts: DataFrame, gold: DataFrame) -> DataFrame:
    """``CLAIM_KEY, predicted, gold_label`` of claims that have a gold label."""
    return facts.select(*CLAIM_KEY, F.col("label").alias("predicted")).join(gold.select(*CLAIM_KEY, "gold_label"), CLAIM_KEY)


def class_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of every label; 0 where a denominator is 0.  One aggregation."""
    hit = lambda x: (F.col("predicted") == x, F.col("gold_label") == x)
    count = lambda x: F.struct(F.lit(x).alias("label"), F.count_if(hit(x)[0] & hit(x)[1]).alias("tp"), F.count_if(hit(x)[0] & ~hit(x)[1]).alias("fp"), F.count_if(~hit(x)[0] & hit(x)[1]).alias("fn"))
    counts = pairs.groupBy(*by).agg(F.array(*(count(x) for x in LABELS)).alias("all")).select(*by, F.explode("all").alias("c")).select(*by, "c.*")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide("tp", F.col("tp") + F.col("fp"))), zero(F.try_divide("tp", F.col("tp") + F.col("fn")))
    out = counts.withColumns({"precision": precision, "recall": recall, "support": F.col("tp") + F.col("fn")})
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).drop("tp", "fp", "fn")


def accuracy(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("*").alias("gold_claims"), F.avg((F.col("predicted") == F.col("gold_label")).cast("double")).alias("verification_accuracy"))


def macro_f1(classes: DataFrame, by: list[str]) -> DataFrame:
    """Mean F1 of labels with support."""
    return classes.where("support > 0").groupBy(*by).agg(F.avg("f1").alias("verification_macro_f1"))


def retrieval_recall(facts: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Mean recall of retrieved passages over claims with gold passages."""
    rows = facts.select(*CLAIM_KEY, F.col("hits.evidence_id").alias("found")).join(gold.where(F.size("evidence_ids") > 0).select(*CLAIM_KEY, F.array_distinct("evidence_ids").alias("relevant")), CLAIM_KEY)
    return rows.groupBy(*by).agg(F.avg(F.size(F.array_intersect("found", "relevant")) / F.size("relevant")).alias("retrieval_recall_at_k"))


def bucket(confidence: Column) -> Column:
    """The bucket [i/10, (i+1)/10), the last one closed, found by comparison with the bounds."""
    return sum(((confidence >= i / BUCKETS).cast("int") for i in range(1, BUCKETS)), F.lit(0))


def confidence_calibration(facts: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Brier score and expected calibration error over responses whose claims all have a gold label.

    A response is right when every label is; those without confidence or claims are left out.
    """
    rows = facts.where(F.col("confidence").isNotNull()).select(*CLAIM_KEY, "label", "confidence").join(gold.select(*CLAIM_KEY, "gold_label"), CLAIM_KEY, "left")
    whole = rows.groupBy(*RESPONSE_KEY).agg(F.first("confidence").alias("confidence"), F.bool_and(F.col("gold_label").isNotNull()).alias("complete"), F.coalesce(F.bool_and(F.col("label") == F.col("gold_label")), F.lit(False)).alias("right"))
    whole = whole.where("complete").select(*by, "confidence", F.col("right").cast("double").alias("outcome")).withColumn("bucket", bucket(F.col("confidence")))
    buckets = whole.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg("outcome").alias("o"), F.sum((F.col("confidence") - F.col("outcome")) ** 2).alias("b"))
    total = F.sum("n")
    return buckets.groupBy(*by).agg((F.sum("b") / total).alias("confidence_brier_score"), (F.sum(F.col("n") * F.abs(F.col("c") - F.col("o"))) / total).alias("confidence_ece"), total.alias("calibrated_responses"))


def model_metrics(facts: DataFrame, responses: DataFrame, gold: DataFrame | None = None, consistency: DataFrame | None = None, k: int = 5, severity: S.SeverityPolicy = S.SeverityPolicy(), trust: S.TrustPolicy = S.TrustPolicy()) -> DataFrame:
    """One row per model with every metric; those whose input is missing are null.

    One pass: claims meet their gold labels once, are summed up per response and
    then per model.  Models and responses without claims stay.
    """
    c = F.col
    claims = facts.select(*CLAIM_KEY, "label", "severity", "similarity", "confidence", c("hits.evidence_id").alias("found"))
    if gold is not None:
        claims = claims.join(gold.select(*CLAIM_KEY, "gold_label", F.array_distinct("evidence_ids").alias("relevant")), CLAIM_KEY, "left")
    else:
        claims = claims.withColumns({"gold_label": F.lit(None).cast("string"), "relevant": F.lit(None).cast("array<string>")})
    right = (c("label") == "supported").cast("double")
    hundredths = {s: round(100 * v) for s, v in trust.penalties.items()}
    pairs = [(a, b) for a in LABELS for b in LABELS]
    cell = lambda a, b: f"{a}_{b}"
    sums = {f"{x}_count": F.count_if(c("label") == x) for x in LABELS} | {f"{x}_count": F.count_if(c("severity") == x) for x in SEVERITIES}
    sums |= {cell(a, b): F.count_if((c("label") == a) & (c("gold_label") == b)) for a, b in pairs}
    sums |= {
        "claim_count": F.count("*"), "weight": F.coalesce(F.sum(S.by_severity(c("severity"), dict(severity.error_weights))), F.lit(0)), "penalty": F.coalesce(F.sum(S.by_severity(c("severity"), hundredths)), F.lit(0)),
        "recalls": F.sum(F.when(F.size("relevant") > 0, F.size(F.array_intersect("found", "relevant")) / F.size("relevant"))), "recall_n": F.count_if(F.size("relevant") > 0),
    }
    parts = claims.groupBy(*RESPONSE_KEY).agg(
        *(v.alias(n) for n, v in sums.items()), F.avg(right).alias("factual_score"), F.avg("similarity").alias("semantic_alignment"), F.avg(1 - F.abs(c("confidence") - right)).alias("confidence_calibration"),
        F.first("confidence").alias("sure"), F.bool_and(c("gold_label").isNotNull()).alias("complete"), F.coalesce(F.bool_and(c("label") == c("gold_label")), F.lit(False)).cast("double").alias("outcome"),
    )
    rows = responses.select(*RESPONSE_KEY).join(parts, RESPONSE_KEY, "left")
    if consistency is not None:
        rows = rows.join(consistency.select(*RESPONSE_KEY, "consistency_score"), RESPONSE_KEY, "left")
    else:
        rows = rows.withColumn("consistency_score", F.lit(None).cast("double"))
    rows = rows.withColumn("severity_penalty", F.least(F.lit(1.0), c("penalty") / (100 * c("claim_count"))))
    judged = c("complete") & c("sure").isNotNull()
    rows = rows.withColumns({"trust": F.when(c("consistency_score").isNotNull() & c("claim_count").isNotNull(), trust_formula(trust.weights)), "off": F.when(judged, c("sure") - c("outcome")), "bucket": bucket(c("sure"))})
    totals = rows.groupBy("model_name").agg(
        F.count("*").alias("response_count"), F.count_distinct("dataset_item_id").alias("dataset_item_count"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums if n != "recalls"), F.sum("recalls").alias("recalls"),
        F.avg("trust").alias("average_trust_score"), F.avg(c("off") ** 2).alias("confidence_brier_score"), F.count("off").alias("judged"),
        *(F.coalesce(F.abs(F.sum(F.when(c("bucket") == i, c("off")))), F.lit(0.0)).alias(f"off_{i}") for i in range(BUCKETS)),
    )
    rate = lambda n: F.try_divide(c(n), c("claim_count"))
    gold_n = sum((c(cell(a, b)) for a, b in pairs), F.lit(0))
    f1, support = [], []
    for x in LABELS:
        tp, said, is_ = c(cell(x, x)), sum((c(cell(x, b)) for b in LABELS), F.lit(0)), sum((c(cell(a, x)) for a in LABELS), F.lit(0))
        f1.append(F.when(is_ > 0, 2 * tp / F.nullif(said + is_, F.lit(0))).otherwise(0.0))
        support.append((is_ > 0).cast("int"))
    return totals.select(
        "model_name", "response_count", "dataset_item_count", "claim_count", *(f"{x}_count" for x in (*LABELS, *SEVERITIES)), *(rate(f"{x}_count").alias(f"{x}_rate") for x in LABELS), rate("contradicted_count").alias("hallucination_rate"),
        F.try_divide(c("weight"), max(severity.error_weights.values()) * c("claim_count")).alias("severity_weighted_error_rate"), F.lit(k).alias("retrieval_k"), "average_trust_score",
        F.try_divide(sum((c(cell(x, x)) for x in LABELS), F.lit(0)), gold_n).alias("verification_accuracy"), F.try_divide(sum(f1, F.lit(0.0)), sum(support, F.lit(0))).alias("verification_macro_f1"),
        F.try_divide(c("recalls"), c("recall_n")).alias("retrieval_recall_at_k"), "confidence_brier_score", F.try_divide(sum((c(f"off_{i}") for i in range(BUCKETS)), F.lit(0.0)), c("judged")).alias("confidence_ece"),
    )
