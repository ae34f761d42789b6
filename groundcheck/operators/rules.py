"""Constraint checks as data: every rule is a condition, and what breaks it is a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.functions.scores import in_unit
from groundcheck.functions.text import is_blank


class RuleError(ValueError):
    """Raised in strict mode, with the first broken rule."""


@dataclass(frozen=True)
class Rule:
    """A name and the condition of rows that break it."""

    name: str
    broken: Column


def violations(rows: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """``key, rule`` for every rule that a row breaks; one pass over the rows."""
    names = F.array_compact(F.array(*(F.when(r.broken, r.name) for r in rules)))
    return rows.select(*key, F.explode(names).alias("rule"))


def require(found: DataFrame, order: list[str] | None = None) -> None:
    """Raise :class:`RuleError` with the first row of ``found``, if there is one."""
    first = found.orderBy(*(order or found.columns)).limit(1).collect()
    if first:
        raise RuleError(", ".join(f"{k}={v}" for k, v in first[0].asDict().items()))


def repeated(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``key, rule`` of keys that occur more than once."""
    return rows.groupBy(*key).count().where("count > 1").select(*key, F.lit(name).alias("rule"))


def benchmark_violations(prompts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``table, id, rule`` for prompts and passages: texts, uniqueness, references and topics."""
    c = F.col
    texts = lambda names: [Rule(f"{n} is blank", is_blank(c(n))) for n in names]
    p, e = prompts.withColumnRenamed("dataset_item_id", "id"), evidence.withColumnRenamed("evidence_id", "id")
    tag = lambda df, table: df.select(F.lit(table).alias("table"), c("id"), c("rule"))
    parts = [
        tag(violations(p, [*texts(["id", "prompt", "topic"]), Rule("no reference", F.coalesce(F.size("reference_evidence_ids") < 1, F.lit(True)))], ["id"]), "prompts"),
        tag(violations(e, texts(["id", "text", "source", "topic"]), ["id"]), "evidence"),
        tag(repeated(p, ["id"], "repeated id"), "prompts"),
        tag(repeated(e, ["id"], "repeated id"), "evidence"),
        tag(reference_violations(prompts, evidence).withColumnRenamed("dataset_item_id", "id"), "prompts"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reference_violations(prompts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``dataset_item_id, evidence_id, rule``: references that do not exist or are of another topic."""
    refs = prompts.select("dataset_item_id", F.col("topic").alias("prompt_topic"), F.explode("reference_evidence_ids").alias("evidence_id"))
    known = evidence.select("evidence_id", F.col("topic").alias("evidence_topic"), F.lit(True).alias("known"))
    rows = refs.join(known, "evidence_id", "left")
    return violations(rows, [Rule("unknown evidence", F.col("known").isNull()), Rule("topics differ", F.col("known").isNotNull() & ~F.col("prompt_topic").eqNullSafe(F.col("evidence_topic")))], ["dataset_item_id", "evidence_id"])


def missing_pairs(responses: DataFrame, models: DataFrame, items: DataFrame) -> DataFrame:
    """Model and item pairs without a response.

    An item's models meet in one row, and only those that it lacks become rows:
    pairs that are there are never made.  All models' names are in one row.
    """
    have = responses.groupBy("dataset_item_id").agg(F.collect_set("model_name").alias("have"))
    names = models.agg(F.collect_set("model_name").alias("names"))  # one row
    rows = items.select("dataset_item_id").distinct().join(have, "dataset_item_id", "left").crossJoin(F.broadcast(names))
    lacking = F.array_except("names", F.coalesce("have", F.array().cast("array<string>")))
    return rows.select("dataset_item_id", F.explode(lacking).alias("model_name"))


def pending_pairs(asked: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of ``asked`` whose model and item have no response; pairs that were never asked for are not made."""
    key = ["model_name", "dataset_item_id"]
    return asked.join(done.select(*key), key, "left_anti")


def response_violations(responses: DataFrame) -> DataFrame:
    """``model_name, dataset_item_id, rule`` of blank texts, confidences out of range and repeated pairs."""
    key = ["model_name", "dataset_item_id"]
    rules = [Rule("blank text", is_blank(F.col("text"))), Rule("confidence out of range", F.col("confidence").isNotNull() & ~in_unit(F.col("confidence"))), Rule("blank key", is_blank(F.col("model_name")) | is_blank(F.col("dataset_item_id")))]
    return violations(responses, rules, key).unionByName(repeated(responses, key, "repeated pair"))


# Fixed values of the benchmark's domain.
TASK_TYPES, RISK_LEVELS = ("factual", "explanation", "advice"), ("moderate", "high")


def freeze_violations(prompts: DataFrame, evidence: DataFrame, domain: str, hosts: dict[str, tuple[str, ...]], counts: tuple[int, int] = (300, 30), per_topic: int = 10) -> DataFrame:
    """``table, id, rule`` of the stricter checks before a benchmark is frozen.

    ``hosts`` names the web hosts of every source; a passage's https url must be
    on one of them or below it, and not the bare host.
    """
    c = F.col
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*(F.lit(h) for h in x)) for kv in hosts.items() for x in kv))
    host = F.lower(F.call_function("try_parse_url", c("source_url"), F.lit("HOST")))
    path = F.coalesce(F.call_function("try_parse_url", c("source_url"), F.lit("PATH")), F.lit(""))
    on = F.exists(table[c("source")], lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
    p_rules = [Rule("domain", ~c("domain").eqNullSafe(domain)), Rule("task_type", ~F.coalesce(c("task_type").isin(*TASK_TYPES), F.lit(False))), Rule("risk_level", ~F.coalesce(c("risk_level").isin(*RISK_LEVELS), F.lit(False)))]
    e_rules = [
        Rule("url is not https", ~F.coalesce(F.call_function("try_parse_url", c("source_url"), F.lit("PROTOCOL")) == "https", F.lit(False))),
        Rule("url host is not the source's", ~F.coalesce(on, F.lit(False))),
        Rule("url is generic", path.isin("", "/")),
        Rule("publication_date", F.try_to_date(c("publication_date"), "yyyy-MM-dd").isNull()),
    ]
    tag = lambda df, name, key: df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("id"), "rule")
    count = lambda df, n, name: df.agg(F.count("*").alias("n")).where(F.col("n") != n).select(F.lit(name).alias("table"), F.col("n").cast("string").alias("id"), F.lit("row count").alias("rule"))
    topics = prompts.groupBy("topic").count().where(F.col("count") != per_topic).withColumn("rule", F.lit("prompts per topic"))
    return (
        benchmark_violations(prompts, evidence).unionByName(tag(violations(prompts, p_rules, ["dataset_item_id"]), "prompts", "dataset_item_id")).unionByName(tag(violations(evidence, e_rules, ["evidence_id"]), "evidence", "evidence_id"))
        .unionByName(tag(topics, "prompts", "topic")).unionByName(count(prompts, counts[0], "prompts")).unionByName(count(evidence, counts[1], "evidence"))
    )
