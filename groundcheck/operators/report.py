"""Report views: highlighted responses, flat claims, filters, totals and long forms."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.functions import scores as S, text as X
from groundcheck.operators import trust as trust_op
from groundcheck.schema import RESPONSE_KEY

SUMMARY = (
    "model_name", "response_count", "claim_count", "supported_rate", "contradicted_rate", "unknown_rate", "hallucination_rate", "severity_weighted_error_rate",
    "average_trust_score", "verification_accuracy", "verification_macro_f1", "retrieval_k", "retrieval_recall_at_k", "confidence_brier_score", "confidence_ece",
)


def span_violations(claims: DataFrame, responses: DataFrame, key: list[str] = RESPONSE_KEY) -> DataFrame:
    """``key, claim_id, rule``: spans that are not the claim's text, repeat an id or overlap the one before.

    A response's spans are gathered and meet its text in one row, so that the text
    is shuffled once and not with every claim.
    """
    fields = ["claim_start", "claim_end", "claim_id", "claim_text"]
    found = claims.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("line"))
    rows = found.withColumn("repeats", F.size(F.array_distinct("line.claim_id")) < F.size("line")).join(responses.select(*key, "text"), key)

    def judged(c, i):
        before = F.get("line", i - 1)["claim_end"]
        valid = F.coalesce((c["claim_start"] >= 0) & (c["claim_start"] < c["claim_end"]) & (c["claim_end"] <= F.length("text")), F.lit(False))
        copies = F.when(F.col("repeats"), F.size(F.filter("line", lambda x: x["claim_id"].eqNullSafe(c["claim_id"])))).otherwise(1)
        rules = {
            "invalid span": ~valid,
            "span is not the claim": valid & (X.span(F.col("text"), c["claim_start"], c["claim_end"]) != c["claim_text"]),
            "repeated claim id": copies > 1,
            "spans overlap": c["claim_start"] < before,
        }
        return F.struct(c["claim_id"].alias("claim_id"), F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items()))).alias("rules"))

    broken = F.filter(F.transform("line", judged), lambda x: F.size(x["rules"]) > 0)
    return rows.select(*key, F.explode(broken).alias("b")).select(*key, "b.claim_id", F.explode("b.rules").alias("rule"))


def highlight_digests(facts: DataFrame, responses: DataFrame, key: list[str] = RESPONSE_KEY) -> DataFrame:
    """``key, claim_id, html_sha256``: the digest of the response's page with the claim marked, null where its span is not the claim.

    A response's claims are gathered and meet its text in one row, so that the text
    is neither shuffled nor escaped for every claim.
    """
    fields = ["claim_id", "claim_text", "claim_start", "claim_end", "label"]
    claims = facts.groupBy(*key).agg(F.collect_list(F.struct(*fields)).alias("line"))
    rows = responses.select(*key, "text").join(claims, key)
    return rows.select(*key, F.explode(X.highlight_digests(F.col("text"), F.col("line"))).alias("d")).select(*key, "d.*")


def explain_html(facts: DataFrame, responses: DataFrame, key: list[str] = RESPONSE_KEY) -> DataFrame:
    """Each response as escaped HTML with a mark around every claim; those without claims too.

    A response's claims are gathered by response only, bounded by its text.
    """
    fields = ["claim_start", "claim_end", "claim_id", "label", "severity"]
    claims = facts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("claims"))
    rows = responses.select(*key, "text").join(claims, key, "left")
    attribute = lambda name, value: F.concat(F.lit(f' data-{name}="'), X.escape_html(value), F.lit('"'))

    def mark(state, c):
        head = F.concat(attribute("claim-id", c["claim_id"]), attribute("verification", c["label"]), F.coalesce(attribute("severity", c["severity"]), F.lit("")))
        gap = X.escape_html(X.span(F.col("text"), state["at"], c["claim_start"]))
        own = X.escape_html(X.span(F.col("text"), c["claim_start"], c["claim_end"]))
        return F.struct(c["claim_end"].alias("at"), F.concat(state["out"], F.array(F.concat(gap, F.lit("<mark"), head, F.lit(">"), own, F.lit("</mark>")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    html = F.aggregate(
        F.coalesce("claims", F.array().cast("array<struct<claim_start:int,claim_end:int,claim_id:string,label:string,severity:string>>")), start, mark,
        lambda s: F.concat(F.array_join(s["out"], ""), X.escape_html(X.span(F.col("text"), s["at"], F.length("text")))),
    )
    return rows.select(*key, html.alias("html"))


def flatten_claims(report: DataFrame, of_text: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """One row per claim of a nested report; missing fields take their defaults.

    ``response_text`` is ``of_text`` of the response's text, taken once for all
    its claims, which otherwise carry the whole text each.
    """
    # outer: an inner one is given a filter on the array, in which Spark would make it, and parse a JSON report, once more
    rows = report.select(F.explode_outer("responses").alias("r"))
    rows = rows.select("r.response.model_name", "r.response.dataset_item_id", of_text(F.coalesce("r.response.text", F.lit(""))).alias("response_text"), "r.trust_score", "r.claims")
    rows = rows.select("model_name", "dataset_item_id", "response_text", "trust_score", F.explode("claims").alias("c"))
    v = F.col("c.verification")
    or_ = lambda c, d: F.coalesce(c, F.lit(d))
    return rows.select(
        or_(F.col("model_name"), "").alias("model_name"), or_(F.col("dataset_item_id"), "").alias("dataset_item_id"), or_(v["claim"]["id"], "").alias("claim_id"),
        v["claim"]["start"].alias("claim_start"), v["claim"]["end"].alias("claim_end"), "response_text", or_(v["claim"]["text"], "").alias("claim_text"),
        or_(v["label"], "unknown").alias("verification_label"), F.col("c.severity.severity").alias("severity"), v["similarity"].alias("similarity"), v["support_score"].alias("support_score"),
        v["contradiction_score"].alias("contradiction_score"), or_(v["explanation"], "").alias("verification_reason"), or_(F.col("c.severity.rationale"), "").alias("severity_reason"),
        F.transform(F.coalesce("c.retrieved_evidence", F.array().cast(report.schema["responses"].dataType.elementType["claims"].dataType.elementType["retrieved_evidence"].dataType)), lambda x: F.coalesce(x["evidence"]["id"], F.lit(""))).alias("evidence_ids"),
        F.col("c.retrieved_evidence").alias("evidence"), v["evidence_scores"].alias("evidence_scores"), F.col("trust_score").alias("trust_score"),
    )


# What a report holds of a claim's facts, and of each of its passages.
OF_CLAIM = (
    "claim_id", "claim_text", "claim_start", "claim_end", "label", "similarity", "support_score", "contradiction_score", "verification_reason", "severity", "risk_domains", "severity_reason",
)
OF_HIT = ("evidence_id", "bm25_score", "embedding_score", "combined_score", "rank")
OF_SCORE = ("evidence_id", "retrieval_score", "similarity", "support_score", "contradiction_score")


def nested_report(facts: DataFrame, responses: DataFrame, trust: DataFrame | None = None, consistency: DataFrame | None = None, only: Collection[str] | None = None) -> DataFrame:
    """One row per response in the report's nested form; only a report file needs it.

    Without a table of trust, ``consistency`` scores give it: its signals are summed
    up where claims are gathered, so that facts are made once.  Facts are gathered
    flat and nested where they meet the response.  A reader of some columns alone
    names them (``only``; of passages by field, as ``hits.evidence_id``; of the response
    ``text`` and ``trust_score``): the others are null in its report and not shuffled.
    """
    every = ["text", "trust_score", *OF_CLAIM, *(f"hits.{f}" for f in OF_HIT), *(f"evidence_scores.{f}" for f in OF_SCORE)]
    wanted = set(every if only is None else only)
    if unknown := wanted - set(every):
        raise ValueError(f"a report has no {sorted(unknown)}")
    trusted = "trust_score" in wanted
    gathered = trusted and trust is None and consistency is not None
    # of passages an array a field: they are taken without a lambda and take less room
    line = F.struct("ordinal", *(F.col(c).alias(c.replace(".", "_")) for c in every[2:] if c in wanted))
    rows = (trust_op.checked(facts) if gathered else facts).groupBy(*RESPONSE_KEY).agg(F.sort_array(F.collect_list(line)).alias("claims"), *(trust_op.signals() if gathered else []))
    text = F.col("text") if "text" in wanted else F.lit(None).cast("string")
    out = responses.select(*RESPONSE_KEY, text.alias("text"), "confidence").join(rows, RESPONSE_KEY, "left")
    score = F.lit(None).cast("double")
    if trusted and trust is not None:
        out, score = out.join(trust.select(*RESPONSE_KEY, "trust_score"), RESPONSE_KEY, "left"), F.col("trust_score")
    elif gathered:
        own = S.checked_unit(F.col("consistency_score"), "consistency_score").alias("consistency_score")
        out = out.join(consistency.select(*RESPONSE_KEY, own), RESPONSE_KEY, "left")
        score = F.when(F.col("claim_count").isNotNull() & F.col("consistency_score").isNotNull(), trust_op.trust_formula())

    def nested(c: Column) -> Column:
        of = lambda f: c[f] if f in wanted else F.lit(None).cast(facts.schema[f].dataType)

        def of_passages(name: str, fields: tuple[str, ...]) -> Column:
            kind, held = facts.schema[name].dataType, [f for f in fields if f"{name}.{f}" in wanted]
            field = lambda k, f: F.get(c[f"{name}_{f}"], k) if f in held else F.lit(None).cast(kind.elementType[f].dataType)
            first = c[f"{name}_{held[0]}"] if held else F.lit(None).cast("array<string>")
            return F.transform(first, lambda _, k: F.struct(F.struct(field(k, "evidence_id").alias("id")).alias("evidence"), *(field(k, f).alias(f) for f in fields[1:])))

        claim = F.struct(of("claim_id").alias("id"), of("claim_text").alias("text"), of("claim_start").alias("start"), of("claim_end").alias("end")).alias("claim")
        scores = [of(f).alias(f) for f in ("label", "similarity", "support_score", "contradiction_score")]
        return F.struct(
            F.struct(claim, *scores, of("verification_reason").alias("explanation"), of_passages("evidence_scores", OF_SCORE).alias("evidence_scores")).alias("verification"),
            F.struct(of("severity").alias("severity"), of("risk_domains").alias("risk_domains"), of("severity_reason").alias("rationale")).alias("severity"), of_passages("hits", OF_HIT).alias("retrieved_evidence"),
        )

    return out.select(F.struct(*RESPONSE_KEY, "text", "confidence").alias("response"), F.transform("claims", nested).alias("claims"), score.alias("trust_score"))


def kpis(flat: DataFrame) -> DataFrame:
    """Claims, contradicted, unknown, severe or critical, and items that have claims."""
    label = F.col("verification_label")
    return flat.agg(F.count("*").alias("claims"), F.count_if(label == "contradicted").alias("contradicted"), F.count_if(label == "unknown").alias("unknown"), F.count_if(F.col("severity").isin("severe", "critical")).alias("severe_or_critical"), F.count_distinct("dataset_item_id").alias("dataset_items"))


def melt(rows: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Long form of some columns."""
    return rows.unpivot(ids, values, name, value)


def research_summary(metrics: DataFrame) -> DataFrame:
    """The columns of a release's model table."""
    return metrics.select(*SUMMARY)


def totals(metrics: DataFrame) -> DataFrame:
    """Sums over models; missing counts are 0."""
    return metrics.agg(F.count("*").alias("model_count"), *(F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(f"total_{c}") for c in ("response_count", "claim_count", "supported_count", "contradicted_count", "unknown_count")))


def picker(flat: DataFrame) -> DataFrame:
    """A label for each claim: model / item and the first 72 characters."""
    return flat.select("model_name", "dataset_item_id", "claim_id", F.concat("model_name", F.lit(" / "), "dataset_item_id", F.lit(" · "), F.substring("claim_text", 1, 72)).alias("caption"))


def flat_facts(facts: DataFrame) -> DataFrame:
    """What :func:`flatten_claims` gives of a report of ``facts``, but for text and trust of the responses: these alone need claims to be gathered, so no report is made."""
    of_passages = lambda c, fields: F.transform(c, lambda h: F.struct(F.struct(h["evidence_id"].alias("id")).alias("evidence"), *(h[f].alias(f) for f in fields[1:]))).alias(c)
    same = ("model_name", "dataset_item_id", "claim_id", "claim_start", "claim_end", "claim_text", "severity", "similarity", "support_score", "contradiction_score", "verification_reason", "severity_reason")
    return facts.select(*same, F.col("label").alias("verification_label"), F.col("hits.evidence_id").alias("evidence_ids"), of_passages("hits", OF_HIT).alias("evidence"), of_passages("evidence_scores", OF_SCORE))


def evidence_detail(flat: DataFrame) -> DataFrame:
    """Retrieved passages of each claim with their scores, by id; a passage without scores keeps nulls, of repeats the last counts.

    A claim's passages and scores lie in its own row and meet there, so nothing is shuffled.
    """
    last = lambda x: F.try_element_at(x, F.lit(-1))
    scores = lambda e: last(F.filter("evidence_scores", lambda s: s["evidence"]["id"] == e["evidence"]["id"]))
    lines = F.transform("evidence", lambda e: F.struct(e["evidence"]["id"].alias("evidence_id"), e["combined_score"].alias("combined_score"), scores(e).alias("s")))
    rows = flat.select("model_name", "dataset_item_id", "claim_id", F.posexplode(lines).alias("place", "e"))
    return rows.select("model_name", "dataset_item_id", "claim_id", "place", "e.evidence_id", "e.combined_score", "e.s.similarity", "e.s.support_score", "e.s.contradiction_score")
