"""DuckDB SQL for the queries, put together from common table expressions.

Written from the definitions alone, apart from the Spark plans, so that the two
check each other.
"""

from __future__ import annotations

import re

# Fixed values, as in the engine's own rules: words that cut claims, mark a domain, or mark advice.
_WORDS = "and|but|however|although|though|while|whereas|because|so|yet|or|nor"
_CUT = rf"([.!?])\s+|\s*[;:]\s*|\s+(?:{_WORDS})\s+|\s*(?:--|—)\s*"
_DOMAINS = {
    "medical": r"health|medical|medicine|medication|drug|dose|dosage|prescription|diagnos\w*|treatment|surgery|vaccine|insulin|symptom|doctor|patient",
    "safety": r"safety|unsafe|dangerous|weapon|poison|toxic|chemical\w*|explosive|flammable|fire|electrocute|enclosed space|self[- ]harm|suicid\w*|injur\w*|death|fatal",
    "legal": r"legal|law|court|lawsuit|contract|criminal|arrest|sue|attorney|lawyer|rights?",
    "finance": r"financ\w*|invest\w*|stock|shares|loan|debt|mortgage|interest rate|bankruptcy|tax(?:es|ation)?|retirement fund",
}
_ADVICE = (
    r"should|must|need to|have to|recommend(?:s|ed|ing)?|advise(?:s|d|ing)?|instruct(?:s|ed|ing)?|take|stop|start|increase|decrease|double|halve|mix|consume|"
    r"sign|transfer|invest|pay|disclose|avoid|use|do not|don''t"
)
_K = "model_name, dataset_item_id, claim_id"
_R = "model_name, dataset_item_id"
_LEVELS = "['mild', 'moderate', 'severe', 'critical']"
_LABELS = "['supported', 'contradicted', 'unknown']"


def _hex(text: str, start: int = 1) -> str:
    return f"CAST(('0x' || substr(md5({text}), {start}, 8)) AS BIGINT)"


def _folded(text: str) -> str:
    """Accented letters as plain ones, for word boundaries."""
    return f"regexp_replace({text}, '[À-ÖØ-öø-ÿŒœ]', 'a', 'g')"


def _domains(text: str) -> str:
    parts = ", ".join(rf"CASE WHEN regexp_matches({_folded(text)}, '(?i)\b(?:{w})\b') THEN '{d}' END" for d, w in _DOMAINS.items())
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def _advice(text: str) -> str:
    return rf"regexp_matches({_folded(text)}, '(?i)\b(?:{_ADVICE})\b')"


def _padded(number: str, width: int) -> str:
    """Zeros before a number of fewer digits; one of more is kept whole."""
    return f"lpad(CAST({number} AS VARCHAR), CAST(greatest({width}, length(CAST({number} AS VARCHAR))) AS INTEGER), '0')"


def _label(s: str, c: str, ts: str = "0.2", tc: str = "0.2") -> str:
    return f"CASE WHEN {s} >= {ts} AND {s} > {c} THEN 'supported' WHEN {c} >= {tc} AND {c} > {s} THEN 'contradicted' ELSE 'unknown' END"


def _level(label: str, contradiction: str, centrality: str, cut: str, domains: str = "domains", advice: str = "advice") -> str:
    base = f"(CASE WHEN {label} = 'contradicted' THEN 1 ELSE 0 END)"
    strong = f"(CASE WHEN {label} = 'contradicted' AND {contradiction} >= {cut} THEN 1 ELSE 0 END)"
    again = f"least(2, least(2, {base} + {strong}) + (CASE WHEN {centrality} >= 0.75 THEN 1 ELSE 0 END))"
    return f"CASE WHEN len({domains}) > 0 AND {advice} THEN 3 WHEN len({domains}) > 0 AND {centrality} >= 0.5 AND {again} < 2 THEN 2 ELSE {again} END"


def _kappa(by: str) -> str:
    """Severity metrics from ``cells`` (by, gold, predicted, n); ``by`` ends in a comma or is empty."""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    on = "".join(f"a.{c.strip()} = b.{c.strip()} AND " for c in by.split(",") if c.strip())
    cols = lambda t: "".join(f"{t}.{c.strip()}, " for c in by.split(",") if c.strip())
    final = f"JOIN k USING ({by.rstrip(', ')})" if by else "CROSS JOIN k"
    return f"""
        , r AS (SELECT {by} gold AS label, sum(n) AS g, sum(CASE WHEN gold = predicted THEN n ELSE 0 END) AS tp FROM cells GROUP BY ALL),
        c AS (SELECT {by} predicted AS label, sum(n) AS p FROM cells GROUP BY ALL),
        f AS (SELECT {cols("a")} sum(tp) / sum(g) AS accuracy, avg(CASE WHEN g + p > 0 THEN 2 * tp / (g + p) END) AS macro_f1, CAST(sum(g) AS BIGINT) AS sample_size FROM r a JOIN c b ON {on} a.label = b.label {group.replace("GROUP BY ", "GROUP BY a.") if by else ""}),
        m AS (SELECT {cols("x")} x.n, r.g, c.p, pow((list_position({_LEVELS}, x.gold) - list_position({_LEVELS}, x.predicted)) / 3.0, 2) AS w
              FROM cells x JOIN r ON {"".join(f"x.{z.strip()} = r.{z.strip()} AND " for z in by.split(",") if z.strip())} x.gold = r.label JOIN c ON {"".join(f"x.{z.strip()} = c.{z.strip()} AND " for z in by.split(",") if z.strip())} x.predicted = c.label),
        k AS (SELECT {by} CASE WHEN sum(w * g * p) <> 0 THEN 1 - sum(w * n) * sum(n) / sum(w * g * p) END AS q FROM m {group})
        SELECT {by} round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, sample_size, round(q, 9) AS quadratic_weighted_kappa FROM f {final}"""


#: Named parts; a part may use any other.
PARTS: dict[str, str] = {
    "resp": f"SELECT doc_id, 'model-' || (doc_id % 20) AS model_name, 'item-' || {_padded('(doc_id // 20)', 6)} AS dataset_item_id, text, CASE WHEN doc_id % 7 <> 0 THEN ((doc_id * 37) % 101) / 100 END AS confidence FROM documents",
    "items": "SELECT DISTINCT dataset_item_id, 'topic-' || (CAST(substr(dataset_item_id, 6) AS BIGINT) % 10) AS topic FROM resp",
    "evi": f"SELECT item_id AS pos, 'ev-' || {_padded('item_id', 4)} AS evidence_id, text, 'topic-' || (item_id % 10) AS topic FROM benchmark",
    "nevi": "SELECT count(*) AS n FROM evi",
    "parts": rf"SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '{_CUT}', '\1' || chr(30), 'gi'), chr(30)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM resp",
    "walk": """SELECT doc_id, 1 AS ordinal, p[1] AS claim_text, CAST(instr(text, p[1]) - 1 AS BIGINT) AS claim_start, length(p[1]) AS size FROM parts WHERE len(p) > 0
        UNION ALL
        SELECT w.doc_id, w.ordinal + 1, q.p[w.ordinal + 1], w.claim_start + w.size + instr(substr(q.text, w.claim_start + w.size + 1), q.p[w.ordinal + 1]) - 1, length(q.p[w.ordinal + 1])
        FROM walk w JOIN parts q ON w.doc_id = q.doc_id WHERE w.ordinal < len(q.p)""",
    "claims": "SELECT r.doc_id, model_name, dataset_item_id, confidence, ordinal, 'claim-' || ordinal AS claim_id, claim_text, claim_start, claim_start + size AS claim_end FROM walk JOIN resp r USING (doc_id)",
    "ctok": f"SELECT {_K}, lower(t) AS token FROM (SELECT {_K}, unnest(regexp_extract_all(claim_text, '(?i)[a-z0-9]+(?:''[a-z0-9]+)?')) AS t FROM claims)",
    "etok": "SELECT pos, lower(t) AS token, count(*) AS tf FROM (SELECT pos, unnest(regexp_extract_all(text, '(?i)[a-z0-9]+(?:''[a-z0-9]+)?')) AS t FROM evi) GROUP BY ALL",
    "elen": "SELECT pos, len(regexp_extract_all(text, '(?i)[a-z0-9]+(?:''[a-z0-9]+)?')) AS dl FROM evi",
    "stats": "SELECT count(*) AS documents, avg(dl) AS average_length FROM elen",
    "dfreq": "SELECT token, count(*) AS df FROM etok GROUP BY token",
    "post": "SELECT pos, token, ln(1 + (documents - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / average_length))) AS weight FROM etok JOIN dfreq USING (token) JOIN elen USING (pos) CROSS JOIN stats",
    "bm25": f"SELECT {_K}, pos, sum(weight) AS s FROM ctok JOIN post USING (token) GROUP BY ALL",
    "nvec": "SELECT count(*) AS n FROM embeddings",
    "cvec": f"SELECT {_K}, CAST(embedding AS DOUBLE[]) AS v FROM claims CROSS JOIN nvec JOIN embeddings ON vec_id = (doc_id * 31 + ordinal) % n",
    "evec": "SELECT pos, CAST(embedding AS DOUBLE[]) AS v FROM evi JOIN embeddings ON vec_id = pos",
    "pairs": f"""SELECT {_K}, e.pos, least(1, greatest(0, (list_cosine_similarity(c.v, e.v) + 1) / 2)) AS emb, coalesce(s, 0) AS s
        FROM cvec c CROSS JOIN evec e LEFT JOIN bm25 b USING ({_K}, pos)""",
    "comb": f"SELECT *, 0.5 * (CASE WHEN max(s) OVER k > 0 THEN s / max(s) OVER k ELSE 0 END) + 0.5 * emb AS combined FROM pairs WINDOW k AS (PARTITION BY {_K})",
    "hits": f"""SELECT {_K}, pos, 'ev-' || {_padded("pos", 4)} AS evidence_id, s, emb, combined, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY round(combined, 12) DESC, pos) AS rank FROM comb) WHERE rank <= 5""",
    "nli": f"SELECT *, {_hex('d')} + 1 AS e, {_hex('d', 9)} + 1 AS c, {_hex('d', 17)} + 1 AS u FROM (SELECT *, model_name || '|' || dataset_item_id || '|' || claim_id || '|' || evidence_id AS d FROM hits)",
    "scores": f"SELECT {_K}, evidence_id, rank, combined, emb, e / (e + c + u) AS pe, c / (e + c + u) AS pc, u / (e + c + u) AS pn FROM nli",
    "best": f"""SELECT {_K}, max(emb) AS similarity, max(pe * combined * emb) AS support_score, max(pc * combined * emb) AS contradiction_score, max(pn * combined * emb) AS neutral_score,
        arg_max(evidence_id, [pe * combined * emb, -rank]) AS support_id, arg_max(evidence_id, [pc * combined * emb, -rank]) AS contradiction_id FROM scores GROUP BY ALL""",
    "labelled": f"SELECT c.*, b.* EXCLUDE ({_K}), {_label('support_score', 'contradiction_score')} AS label FROM claims c JOIN best b USING ({_K})",
    "ruled": f"SELECT *, CASE WHEN label <> 'supported' THEN {_domains('claim_text')} ELSE [] END AS domains, {_advice('claim_text')} AS advice FROM labelled",
    "facts": f"SELECT *, CASE WHEN label <> 'supported' THEN {_LEVELS}[1 + {_level('label', 'contradiction_score', '0', '0.3')}] END AS severity FROM ruled",
    "cenw": "SELECT * EXCLUDE (claim_text), trim(claim_text || ' ' || ['', 'insulin dose', 'you should sign', 'loan', 'take the medicine'][1 + ordinal % 5]) AS claim_text, (ordinal % 11) / 10 AS centrality FROM labelled",
    "cenr": f"SELECT *, CASE WHEN label <> 'supported' THEN {_domains('claim_text')} ELSE [] END AS domains, {_advice('claim_text')} AS advice FROM cenw",
    "central": f"SELECT *, CASE WHEN label <> 'supported' THEN {_LEVELS}[1 + {_level('label', 'contradiction_score', 'centrality', '0.3')}] END AS severity FROM cenr",
    "cons": "SELECT model_name, dataset_item_id, ((doc_id * 13) % 101) / 100 AS consistency_score FROM resp WHERE doc_id % 5 <> 0",
    "trusts": f"""SELECT {_R}, factual_score, semantic_alignment, confidence_calibration, severity_penalty, claim_count, consistency_score,
        greatest(0, least(1, 0.45 * factual_score + 0.2 * semantic_alignment + 0.2 * consistency_score + 0.15 * coalesce(confidence_calibration, 0) - severity_penalty)) AS trust_score FROM (
        SELECT {_R}, avg(CASE WHEN label = 'supported' THEN 1.0 ELSE 0 END) AS factual_score, avg(similarity) AS semantic_alignment,
        avg(1 - abs(confidence - CASE WHEN label = 'supported' THEN 1 ELSE 0 END)) AS confidence_calibration,
        least(1, coalesce(sum(CASE severity WHEN 'mild' THEN 5 WHEN 'moderate' THEN 15 WHEN 'severe' THEN 30 WHEN 'critical' THEN 60 END), 0) / (100 * count(*))) AS severity_penalty, count(*) AS claim_count
        FROM facts GROUP BY ALL) JOIN cons USING ({_R})""",
    "gold": f"""SELECT {_K}, CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'supported' ELSE 'unknown' END AS gold_label,
        CASE WHEN toxic = 1 OR quality <> 1 THEN {_LEVELS}[1 + {_hex("model_name || '|' || dataset_item_id || '|' || claim_id")} % 4] END AS gold_severity,
        ['ev-' || {_padded("(doc_id % n)", 4)}, 'ev-' || {_padded("((doc_id * 3 + ordinal) % n)", 4)}] AS ids FROM claims JOIN labels USING (doc_id) CROSS JOIN nevi""",
    "gids": f"SELECT DISTINCT {_K}, unnest(ids) AS evidence_id FROM gold",
    "gpairs": f"SELECT {_K}, label AS predicted, gold_label FROM facts JOIN gold USING ({_K})",
    "rel": f"SELECT h.*, g.evidence_id IS NOT NULL AS hit FROM hits h SEMI JOIN gold USING ({_K}) LEFT JOIN gids g USING ({_K}, evidence_id)",
    "relq": f"""SELECT {_K}, coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0) AS rr, n,
        {", ".join(f"count(*) FILTER (hit AND rank <= {k}) AS h{k}" for k in (1, 3, 5))} FROM rel JOIN (SELECT {_K}, count(*) AS n FROM gids GROUP BY ALL) USING ({_K}) GROUP BY ALL""",
    "outc": f"SELECT {_R}, avg(CASE WHEN label = 'supported' THEN 1.0 WHEN label IS NOT NULL THEN 0 END) AS rate, coalesce(bool_or(label = 'contradicted'), false) AS error FROM resp LEFT JOIN facts f USING ({_R}) GROUP BY ALL",
    "mpairs": "SELECT a.model_name AS model_a, b.model_name AS model_b, dataset_item_id, a.rate AS ra, b.rate AS rb, a.error AS ea, b.error AS eb FROM outc a JOIN outc b USING (dataset_item_id) WHERE a.model_name < b.model_name",
    "disc": "SELECT model_a, model_b, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS paired_item_count, avg(ra - rb) AS mean_difference, count(*) FILTER (ea AND NOT eb) AS a, count(*) FILTER (eb AND NOT ea) AS b FROM mpairs GROUP BY ALL",
    "bplace": "SELECT model_a, model_b, ra - rb AS d, row_number() OVER (PARTITION BY model_a, model_b ORDER BY dataset_item_id) - 1 AS place, count(*) OVER (PARTITION BY model_a, model_b) AS n FROM mpairs WHERE ra IS NOT NULL AND rb IS NOT NULL",
    "obs": f"SELECT {_K}, claim_text, label, support_score, contradiction_score, gold_label, gold_severity, domains, advice FROM ruled JOIN gold USING ({_K})",
    "cand": "SELECT i / 20 AS t FROM range(21) r(i)",
    "gcnt": f"SELECT s.t AS support_threshold, c.t AS contradiction_threshold, gold_label, {_label('support_score', 'contradiction_score', 's.t', 'c.t')} AS predicted, count(*) AS n FROM obs CROSS JOIN cand s CROSS JOIN cand c GROUP BY ALL",
    "grid": """SELECT * FROM (SELECT support_threshold, contradiction_threshold, sum(tp) / sum(g) AS accuracy, avg(2 * tp / (g + coalesce(p, 0))) AS macro_f1, avg(tp / g) AS balanced_accuracy, CAST(sum(g) AS BIGINT) AS sample_size
        FROM (SELECT support_threshold, contradiction_threshold, gold_label AS l, sum(n) AS g, sum(CASE WHEN gold_label = predicted THEN n ELSE 0 END) AS tp FROM gcnt GROUP BY ALL)
        LEFT JOIN (SELECT support_threshold, contradiction_threshold, predicted AS l, sum(n) AS p FROM gcnt GROUP BY ALL) USING (support_threshold, contradiction_threshold, l) GROUP BY ALL)
        JOIN (SELECT support_threshold, contradiction_threshold, sum(CASE WHEN predicted <> 'unknown' THEN n ELSE 0 END) / sum(n) AS coverage FROM gcnt GROUP BY ALL) USING (support_threshold, contradiction_threshold)""",
    "levels": f"SELECT unnest({_LEVELS}) AS l",
    "spairs": f"SELECT model_name, gold_severity AS gold, severity AS predicted FROM facts JOIN gold USING ({_K}) WHERE gold_severity IS NOT NULL AND severity IS NOT NULL",
    "mcells": "SELECT m.model_name, g.l AS gold, p.l AS predicted, count(s.gold) AS n FROM (SELECT DISTINCT model_name FROM spairs) m CROSS JOIN levels g CROSS JOIN levels p LEFT JOIN spairs s ON s.model_name = m.model_name AND s.gold = g.l AND s.predicted = p.l GROUP BY ALL",
    "tpairs": f"SELECT t AS threshold, gold_severity AS gold, {_LEVELS}[1 + {_level('label', 'contradiction_score', '0', 't')}] AS predicted FROM obs CROSS JOIN cand WHERE gold_severity IS NOT NULL AND label <> 'supported'",
    "tcells": "SELECT c.t AS threshold, g.l AS gold, p.l AS predicted, count(s.gold) AS n FROM cand c CROSS JOIN levels g CROSS JOIN levels p LEFT JOIN tpairs s ON s.threshold = c.t AND s.gold = g.l AND s.predicted = p.l GROUP BY ALL",
    "tops": "SELECT topic, row_number() OVER (ORDER BY md5('42|' || topic), topic) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT topic FROM items)",
    "split": "SELECT i.dataset_item_id, topic, CASE WHEN k <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' WHEN k <= 2 * greatest(1, round_even(n * 0.2, 0)) THEN 'dev' ELSE 'train' END AS split FROM items i JOIN tops USING (topic)",
    "prompts": f"""SELECT dataset_item_id, topic, 'Question ' || k AS prompt, ['ev-' || {_padded("(k % n)", 4)}, 'ev-' || CASE WHEN k % 11 = 0 THEN CAST(greatest(9999, n) AS VARCHAR) ELSE {_padded("((k * 7) % n)", 4)} END] AS refs
        FROM (SELECT *, CAST(substr(dataset_item_id, 6) AS BIGINT) AS k FROM items) CROSS JOIN nevi""",
    "prefs": "SELECT dataset_item_id, topic, r.ref AS evidence_id, r.k FROM prompts, LATERAL (SELECT unnest(refs) AS ref, generate_subscripts(refs, 1) AS k) r",
    "fk": "SELECT p.dataset_item_id, p.evidence_id, CASE WHEN e.pos IS NULL THEN 'unknown evidence' ELSE 'topics differ' END AS rule FROM prefs p LEFT JOIN evi e USING (evidence_id) WHERE e.pos IS NULL OR p.topic <> e.topic",
    "annb": f"SELECT {_K}, gold_label AS first_label, CASE WHEN {_hex("'b|' || model_name || '|' || dataset_item_id || '|' || claim_id")} % 5 = 0 THEN {_LABELS}[1 + list_position({_LABELS}, gold_label) % 3] ELSE gold_label END AS second_label FROM gold",
}

_RECURSIVE = {"walk"}


def oracle(final: str) -> str:
    """The statement with the parts that it needs, in order."""
    need: list[str] = []

    def visit(sql: str) -> None:
        for name in PARTS:
            if name not in need and name not in waiting and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                waiting.append(name)
                visit(PARTS[name])
                need.append(name)

    waiting: list[str] = []
    visit(final)
    if not need:
        return final
    ctes = ",\n".join(f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({PARTS[n]})" for n in need)
    return f"WITH RECURSIVE {ctes}\n{final.strip()}"


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


_RATES = f"""SELECT model_name, count(DISTINCT dataset_item_id) AS response_count, count(DISTINCT dataset_item_id) AS dataset_item_count, count(f.label) AS claim_count,
    {", ".join(f"count(*) FILTER (f.label = '{k}') AS {k}_count" for k in ("supported", "contradicted", "unknown"))},
    {", ".join(f"count(*) FILTER (f.severity = '{k}') AS {k}_count" for k in ("mild", "moderate", "severe", "critical"))},
    {", ".join(f"round(count(*) FILTER (f.label = '{k}') / nullif(count(f.label), 0), 9) AS {k}_rate" for k in ("supported", "contradicted", "unknown"))},
    round(count(*) FILTER (f.label = 'contradicted') / nullif(count(f.label), 0), 9) AS hallucination_rate,
    round(coalesce(sum(CASE f.severity WHEN 'mild' THEN 1 WHEN 'moderate' THEN 2 WHEN 'severe' THEN 4 WHEN 'critical' THEN 8 END), 0) / nullif(8 * count(f.label), 0), 9) AS severity_weighted_error_rate
    FROM resp LEFT JOIN facts f USING ({_R}) GROUP BY model_name"""
PARTS["rates"] = _RATES.replace(f"USING ({_R})", f"USING ({_R})")
PARTS["classes"] = """SELECT model_name, l AS label, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, tp + fn AS support FROM (
    SELECT model_name, l, count(*) FILTER (predicted = l AND gold_label = l) AS tp, count(*) FILTER (predicted = l AND gold_label <> l) AS fp, count(*) FILTER (predicted <> l AND gold_label = l) AS fn
    FROM gpairs CROSS JOIN (SELECT unnest(['supported', 'contradicted', 'unknown']) AS l) GROUP BY ALL)"""
PARTS["classf"] = "SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM classes"
PARTS["calr"] = f"SELECT {_R}, any_value(f.confidence) AS confidence, CASE WHEN bool_and(label = gold_label) THEN 1.0 ELSE 0 END AS o FROM facts f LEFT JOIN gold USING ({_K}) WHERE f.confidence IS NOT NULL GROUP BY ALL HAVING count(*) = count(gold_label)"
PARTS["calb"] = f"SELECT model_name, (SELECT count(*) FROM range(1, 10) r(i) WHERE confidence >= i / 10) AS bucket, count(*) AS n, avg(confidence) AS c, avg(o) AS o, sum(pow(confidence - o, 2)) AS b FROM calr GROUP BY ALL"
PARTS["cal"] = "SELECT model_name, sum(b) / sum(n) AS confidence_brier_score, sum(n * abs(c - o)) / sum(n) AS confidence_ece, CAST(sum(n) AS BIGINT) AS calibrated_responses FROM calb GROUP BY model_name"
PARTS["rec"] = f"SELECT model_name, avg(h5 / n) AS retrieval_recall_at_k FROM relq GROUP BY model_name"
PARTS["mm"] = """SELECT r.*, 5 AS retrieval_k, round(t.a, 9) AS average_trust_score, round(v.a, 9) AS verification_accuracy, round(f.a, 9) AS verification_macro_f1, round(retrieval_recall_at_k, 9) AS retrieval_recall_at_k,
    round(confidence_brier_score, 9) AS confidence_brier_score, round(confidence_ece, 9) AS confidence_ece FROM rates r
    LEFT JOIN (SELECT model_name, avg(trust_score) AS a FROM trusts GROUP BY 1) t USING (model_name)
    LEFT JOIN (SELECT model_name, avg(CASE WHEN predicted = gold_label THEN 1.0 ELSE 0 END) AS a FROM gpairs GROUP BY 1) v USING (model_name)
    LEFT JOIN (SELECT model_name, avg(f1) AS a FROM classf WHERE support > 0 GROUP BY 1) f USING (model_name) LEFT JOIN rec USING (model_name) LEFT JOIN cal USING (model_name)"""

_SIGNALS = ("trust_score", "factual_score", "semantic_alignment", "consistency_score", "confidence_calibration", "severity_penalty")
_ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')".format
_PAIRP = f"list_aggregate(list_transform(range(0, least(a, b) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))), 'sum')"
_MCNEMAR = f"CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2 * {_PAIRP}) END"
_KEYTEXT = "model_name || '|' || dataset_item_id || '|' || claim_id"

ORACLES: dict[str, str] = {
    "extract_claims": f"SELECT {_K}, claim_text, claim_start, claim_end FROM claims",
    "custom_claims": f"""WITH l AS (SELECT {_R}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM resp),
        s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY {_R} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) - length(ltrim(line, ' ')) AS st, trim(line, ' ') AS c FROM l)
        SELECT {_R}, 'claim-' || row_number() OVER (PARTITION BY {_R} ORDER BY k) AS claim_id, c AS claim_text, CAST(st AS INTEGER) AS claim_start, CAST(st + length(c) AS INTEGER) AS claim_end FROM s WHERE c <> ''""",
    "tokenize": f"SELECT {_K}, array_to_string(t, ' ') AS tokens, len(t) AS token_count FROM (SELECT {_K}, list_transform(regexp_extract_all(claim_text, '(?i)[a-z0-9]+(?:''[a-z0-9]+)?'), lambda x: lower(x)) AS t FROM claims)",
    "lexical_similarity": f"""SELECT {_K}, evidence_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS similarity
        FROM (SELECT {_K}, evidence_id, list_distinct(regexp_extract_all(lower(claim_text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(e.text), '[a-z0-9]+')) AS b FROM claims CROSS JOIN nevi JOIN evi e ON e.pos = ordinal % n)""",
    "corpus_stats": "SELECT documents, round(average_length, 9) AS average_length FROM stats",
    "document_frequency": "SELECT token, df FROM dfreq",
    "bm25_scores": f"SELECT {_K}, 'ev-' || {_padded('pos', 4)} AS evidence_id, round(s, 9) AS bm25_score FROM bm25",
    "embedding_similarity": f"SELECT {_K}, evidence_id, round(least(1, greatest(0, (list_cosine_similarity(c.v, e.v) + 1) / 2)), 9) AS similarity FROM cvec c JOIN claims USING ({_K}) CROSS JOIN nevi JOIN evec e ON e.pos = ordinal % n JOIN evi USING (pos)",
    "hybrid_retrieval": f"SELECT {_K}, evidence_id, round(s, 9) AS bm25_score, round(emb, 9) AS embedding_score, round(combined, 9) AS combined_score, rank FROM hits",
    "recall_at_k": f"SELECT model_name, {', '.join(f'round(avg(h{k} / n), 9) AS recall_at_{k}' for k in (1, 3, 5))} FROM relq GROUP BY model_name",
    "precision_at_k": f"SELECT model_name, {', '.join(f'round(avg(h{k} / {k}), 9) AS precision_at_{k}' for k in (1, 3, 5))} FROM relq GROUP BY model_name",
    "mrr": "SELECT model_name, count(*) AS queries, round(avg(rr), 9) AS mean_reciprocal_rank FROM relq GROUP BY model_name",
    "evidence_scores": f"""SELECT {_K}, evidence_id, rank, round(combined, 9) AS retrieval_score, round(emb, 9) AS similarity, round(pe, 9) AS entailment_probability, round(pc, 9) AS contradiction_probability, round(pn, 9) AS neutral_probability,
        round(pe * combined * emb, 9) AS support_score, round(pc * combined * emb, 9) AS contradiction_score, round(pn * combined * emb, 9) AS neutral_score FROM scores""",
    "verification_labels": f"SELECT {_K}, label, {_round('similarity', 'support_score', 'contradiction_score', 'neutral_score')} FROM facts",
    "verification_explanations": f"""SELECT {_K}, CASE label WHEN 'supported' THEN format('Evidence ''{{}}'' most strongly entails the claim (adjusted support score {{:.3f}}).', support_id, support_score)
        WHEN 'contradicted' THEN format('Evidence ''{{}}'' most strongly contradicts the claim (adjusted contradiction score {{:.3f}}).', contradiction_id, contradiction_score)
        ELSE format('Retrieved evidence did not produce a decisive entailment or contradiction score (support {{:.3f}}; contradiction {{:.3f}}).', support_score, contradiction_score) END AS verification_reason FROM facts""",
    "risk_domains": f"SELECT {_K}, array_to_string({_domains('claim_text')}, ',') AS risk_domains, {_advice('claim_text')} AS advice FROM claims",
    "severity_classification": f"SELECT {_K}, severity, array_to_string(domains, ',') AS risk_domains FROM central",
    "severity_rationale": f"""SELECT {_K}, CASE WHEN label = 'supported' THEN 'The claim is supported; no error severity is assigned.' ELSE concat_ws(' ',
        CASE WHEN label = 'contradicted' THEN 'Contradicted claims start at moderate severity.' ELSE 'Unknown claims start at mild severity.' END,
        CASE WHEN strong THEN format('Strong contradiction score ({{:.2f}}) raises severity.', contradiction_score) END,
        CASE WHEN centrality >= 0.75 AND first >= 2 THEN format('High response centrality ({{:.2f}}) was considered; severity escalation is capped at severe unless the claim contains actionable high-impact advice.', centrality)
             WHEN centrality >= 0.75 THEN format('High response centrality ({{:.2f}}) raises severity.', centrality) END,
        CASE WHEN len(domains) > 0 AND centrality >= 0.5 AND least(2, first + CASE WHEN centrality >= 0.75 THEN 1 ELSE 0 END) < 2 THEN 'A high-impact domain is central to the response, raising severity to severe.' END,
        CASE WHEN len(domains) > 0 AND advice THEN 'Unsupported actionable advice in a high-impact domain is critical.' END,
        CASE WHEN len(domains) > 0 THEN 'Detected high-impact domain(s): ' || array_to_string(domains, ', ') || '.' END) END AS severity_reason
        FROM (SELECT *, label = 'contradicted' AND contradiction_score >= 0.3 AS strong, CASE WHEN label = 'contradicted' THEN CASE WHEN contradiction_score >= 0.3 THEN 2 ELSE 1 END ELSE 0 END AS first FROM central)""",
    "trust_scores": f"SELECT {_R}, {_round(*_SIGNALS)}, claim_count FROM trusts",
    "trust_rationale": f"SELECT {_R}, format('Factual={{:.3f}}; semantic={{:.3f}}; consistency={{:.3f}}; confidence calibration={{}}; severity penalty={{:.3f}}.', round(factual_score, 12), round(semantic_alignment, 12), round(consistency_score, 12), CASE WHEN confidence_calibration IS NULL THEN 'unavailable' ELSE format('{{:.3f}}', round(confidence_calibration, 12)) END, round(severity_penalty, 12)) AS trust_rationale FROM trusts",
    "model_metrics": "SELECT * FROM mm",
    "severity_distribution": f"SELECT model_name, {', '.join(f'count(*) FILTER (severity = {chr(39)}{k}{chr(39)}) AS {k}' for k in ('mild', 'moderate', 'severe', 'critical'))} FROM facts GROUP BY model_name",
    "class_metrics": f"SELECT model_name, label, {_round('precision', 'recall', 'f1')}, support FROM classf",
    "gold_join_accuracy": "SELECT model_name, count(*) AS gold_claims, round(avg(CASE WHEN predicted = gold_label THEN 1.0 ELSE 0 END), 9) AS verification_accuracy FROM gpairs GROUP BY model_name",
    "retrieval_recall_at_k": "SELECT model_name, round(retrieval_recall_at_k, 9) AS retrieval_recall_at_k FROM rec",
    "confidence_calibration": f"SELECT model_name, {_round('confidence_brier_score', 'confidence_ece')}, calibrated_responses FROM cal",
    "paired_comparison": "SELECT model_a, model_b, paired_item_count, round(mean_difference, 9) AS mean_difference, a AS model_a_error_only_items, b AS model_b_error_only_items FROM disc",
    "mcnemar": f"SELECT model_a, model_b, round({_MCNEMAR}, 9) AS mcnemar_exact_p_value FROM disc",
    "bootstrap_hash": f"""SELECT model_a, model_b, round(any_value(mean_difference), 9) AS mean_difference, any_value(n) AS sample_size, round(quantile_cont(m, 0.025), 9) AS lower, round(quantile_cont(m, 0.975), 9) AS upper, count(*) AS repetitions
        FROM (SELECT model_a, model_b, rep, sum(d * times) / any_value(n) AS m, any_value(n) AS n FROM bplace JOIN (
            SELECT n, rep, {_hex("'0|' || rep || '|' || draw")} % n AS place, count(*) AS times FROM (SELECT n, unnest(range(n)) AS draw FROM (SELECT DISTINCT n FROM bplace)) CROSS JOIN range(2000) r(rep) GROUP BY ALL) USING (n, place)
        GROUP BY ALL) JOIN disc USING (model_a, model_b) GROUP BY model_a, model_b""",
    "threshold_grid": f"SELECT support_threshold, contradiction_threshold, {_round('accuracy', 'macro_f1', 'balanced_accuracy', 'coverage')}, sample_size FROM grid",
    "threshold_best": f"SELECT support_threshold, contradiction_threshold, {_round('accuracy', 'macro_f1', 'balanced_accuracy', 'coverage')}, sample_size FROM grid ORDER BY round(grid.macro_f1, 12) DESC, round(grid.accuracy, 12) DESC, round(grid.coverage, 12) DESC, round(abs(support_threshold - 0.55) + abs(contradiction_threshold - 0.55), 12), support_threshold, contradiction_threshold LIMIT 1",
    "severity_threshold_grid": "WITH cells AS (SELECT * FROM tcells)" + _kappa("threshold,"),
    "severity_threshold_best": "WITH cells AS (SELECT * FROM tcells)" + _kappa("threshold,") + " ORDER BY round(macro_f1, 12) DESC, round(accuracy, 12) DESC, round(coalesce(q, -1), 12) DESC, round(abs(threshold - 0.8), 12), threshold LIMIT 1",
    "severity_pairs_strict": "SELECT gold, predicted, count(*) AS claims FROM spairs GROUP BY ALL",
    "severity_confusion": "SELECT model_name, gold, predicted, n FROM mcells",
    "quadratic_kappa": "WITH cells AS (SELECT gold, predicted, sum(n) AS n FROM mcells GROUP BY ALL)" + _kappa(""),
    "severity_metrics_by_model": "WITH cells AS (SELECT * FROM mcells)" + _kappa("model_name,"),
    "topic_split_hash": "SELECT dataset_item_id, topic, split FROM split",
    "split_counts": "SELECT split, count(*) AS items, count(DISTINCT topic) AS topics FROM split GROUP BY split",
    "split_filter": f"SELECT {_R}, confidence FROM resp JOIN split USING (dataset_item_id) WHERE split = 'dev'",
    "dev_test_overlap": "SELECT count(*) AS shared_topics FROM (SELECT topic FROM split WHERE split = 'dev' INTERSECT SELECT topic FROM split WHERE split = 'test')",
    "benchmark_validation": "SELECT 'prompts' AS \"table\", dataset_item_id AS id, rule FROM fk UNION ALL SELECT 'evidence', evidence_id, 'source is blank' FROM evi",
    "fk_violations": "SELECT dataset_item_id, evidence_id, rule FROM fk",
    "matrix_missing_pairs": f"SELECT m.model_name, i.dataset_item_id FROM (SELECT DISTINCT model_name FROM resp) m CROSS JOIN (SELECT DISTINCT dataset_item_id FROM resp) i ANTI JOIN (SELECT {_R} FROM resp WHERE doc_id % 9 <> 0) d ON d.model_name = m.model_name AND d.dataset_item_id = i.dataset_item_id",
    "response_validation": f"""WITH o AS (SELECT {_R}, doc_id % 13 = 0 AS blank, doc_id % 8 = 0 AS wild FROM resp UNION ALL SELECT {_R}, doc_id % 13 = 0, doc_id % 8 = 0 FROM resp WHERE doc_id % 40 = 1)
        SELECT {_R}, 'blank text' AS rule FROM o WHERE blank UNION ALL SELECT {_R}, 'confidence out of range' FROM o WHERE wild UNION ALL SELECT {_R}, 'repeated pair' FROM o GROUP BY ALL HAVING count(*) > 1""",
    "annotation_validation": f"""WITH a AS (SELECT {_K}, ordinal AS o, gold_label, gold_severity FROM claims JOIN gold USING ({_K})),
        b AS (SELECT *, CASE WHEN o % 23 = 0 THEN 'maybe' ELSE gold_label END AS l, CASE WHEN o % 29 = 0 THEN 'mild' ELSE gold_severity END AS s FROM a)
        SELECT {_K}, unnest(list_filter([CASE WHEN o % 37 = 0 THEN 'rationale is blank' END, CASE WHEN o % 17 = 0 THEN 'claim not reviewed' END, CASE WHEN l = 'maybe' THEN 'invalid label' END,
            CASE WHEN l = 'supported' AND s IS NOT NULL THEN 'severity on supported claim' END, CASE WHEN l IN ('contradicted', 'unknown') AND s IS NULL THEN 'severity missing' END,
            CASE WHEN o % 31 = 0 THEN 'evidence ids repeat' END, CASE WHEN o % 31 = 0 THEN 'unknown evidence id' END, CASE WHEN o % 19 = 0 THEN 'claim text or offsets differ' END], lambda x: x IS NOT NULL)) AS rule FROM b""",
    "annotator_agreement": "SELECT first_label, second_label, count(*) AS claims FROM annb GROUP BY ALL",
    "cohen_kappa": """SELECT n AS claim_count, round(same / n, 9) AS exact_agreement, round(CASE WHEN chance / (n * n) <> 1 THEN (same / n - chance / (n * n)) / (1 - chance / (n * n)) END, 9) AS cohen_kappa FROM (
        SELECT count(*) AS n, count(*) FILTER (first_label = second_label) AS same FROM annb) CROSS JOIN (SELECT coalesce(sum(a * b), 0) AS chance FROM (SELECT first_label AS l, count(*) AS a FROM annb GROUP BY 1) JOIN (SELECT second_label AS l, count(*) AS b FROM annb GROUP BY 1) USING (l))""",
    "unmatched_annotations": f"""WITH d AS (SELECT {_K}, {_hex(_KEYTEXT, 9)} AS h FROM gold) SELECT {_K}, 'first' AS "only" FROM d WHERE h % 5 <> 0 AND h % 7 = 0 UNION ALL SELECT {_K}, 'second' FROM d WHERE h % 7 <> 0 AND h % 5 = 0""",
    "annotation_worksheet": f"""SELECT {_K}, claim_text, claim_start, claim_end, p.topic, prompt, 'pending' AS claim_review_status, refs AS evidence_candidates FROM claims JOIN prompts p USING (dataset_item_id)
        LEFT JOIN (SELECT dataset_item_id, string_agg(evidence_id, ',' ORDER BY k) AS refs FROM prefs SEMI JOIN evi USING (evidence_id) GROUP BY 1) g USING (dataset_item_id)""".replace("prompt, 'pending' AS claim_review_status, refs AS", "prompt, 'pending' AS claim_review_status, g.refs AS"),
    "resume_pending": f"SELECT {_R} FROM resp WHERE doc_id % 6 = 0",
    "url_rules": r"""SELECT page_id, starts_with(url, 'https://') AS is_https, h AS host, h = 'example.org' OR h LIKE '%.example.org' AS known_host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') AS generic
        FROM (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS h FROM pages)""",
    "date_rules": "SELECT doc_id, s AS publication_date, try_strptime(s, '%Y-%m-%d') IS NOT NULL AS valid FROM (SELECT doc_id, '20' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') AS s FROM documents)",
    "explain_html": f"""WITH m AS (SELECT {_R}, ordinal, claim_end, {_ESCAPE("substr(r.text, coalesce(lag(claim_end) OVER w, 0) + 1, claim_start - coalesce(lag(claim_end) OVER w, 0))")} || '<mark data-claim-id="' || claim_id || '" data-verification="' || label || '"' || coalesce(' data-severity="' || severity || '"', '') || '>' || {_ESCAPE("substr(r.text, claim_start + 1, claim_end - claim_start)")} || '</mark>' AS piece
        FROM facts JOIN (SELECT {_R}, text FROM resp) r USING ({_R}) WINDOW w AS (PARTITION BY {_R} ORDER BY claim_start, claim_end)),
        g AS (SELECT {_R}, string_agg(piece, '' ORDER BY ordinal) AS body, max(claim_end) AS last FROM m GROUP BY ALL),
        h AS (SELECT {_R}, coalesce(body, '') || {_ESCAPE("substr(text, coalesce(last, 0) + 1)")} AS html FROM resp LEFT JOIN g USING ({_R}))
        SELECT {_R}, sha256(html) AS html_sha256, length(html) AS html_length FROM h""",
    "span_overlaps": f"""WITH s AS (SELECT c.*, r.text, claim_start - CASE WHEN ordinal % 10 = 0 THEN 5 ELSE 0 END AS st FROM claims c JOIN (SELECT {_R}, text FROM resp) r USING ({_R})),
        t AS (SELECT *, lag(claim_end) OVER (PARTITION BY {_R} ORDER BY st, claim_end, claim_id) AS before FROM s)
        SELECT {_K}, unnest(list_filter([CASE WHEN st < 0 THEN 'invalid span' END, CASE WHEN st >= 0 AND substr(text, st + 1, claim_end - st) <> claim_text THEN 'span is not the claim' END, CASE WHEN st < before THEN 'spans overlap' END], lambda x: x IS NOT NULL)) AS rule FROM t""",
    "dashboard_highlight": f"""SELECT {_K}, sha256(CASE WHEN s < claim_end AND substr(r.text, s + 1, claim_end - s) = claim_text THEN {_ESCAPE("substr(r.text, 1, s)")} || '<mark style="background:' || CASE label WHEN 'supported' THEN '#d7f5e8' WHEN 'contradicted' THEN '#ffe0e0' WHEN 'unknown' THEN '#fff0ce' ELSE '#e8eef5' END || ';padding:.12rem .22rem;border-radius:.25rem">' || {_ESCAPE("substr(r.text, s + 1, claim_end - s)")} || '</mark>' || {_ESCAPE("substr(r.text, claim_end + 1)")} END) AS html_sha256
        FROM (SELECT *, claim_start + CASE WHEN ordinal = 4 THEN 1 ELSE 0 END AS s FROM facts) JOIN (SELECT {_R}, text FROM resp) r USING ({_R})""",
    "flatten_claims": f"SELECT {_K}, claim_start, claim_end, claim_text, label AS verification_label, severity, round(support_score, 9) AS support_score, round(trust_score, 9) AS trust_score, e AS evidence_ids FROM facts LEFT JOIN (SELECT {_R}, trust_score FROM trusts) USING ({_R}) JOIN (SELECT {_K}, string_agg(evidence_id, ',' ORDER BY rank) AS e FROM hits GROUP BY ALL) USING ({_K})",
    "evidence_detail": f"SELECT {_K}, rank - 1 AS place, evidence_id, round(combined, 9) AS combined_score, round(emb, 9) AS similarity, round(pe * combined * emb, 9) AS support_score, round(pc * combined * emb, 9) AS contradiction_score FROM scores",
    "filter_claims": f"SELECT {_K}, label, severity FROM facts WHERE model_name IN ('model-0', 'model-2') AND CAST(substr(dataset_item_id, 6) AS BIGINT) < 40 AND CAST(substr(dataset_item_id, 6) AS BIGINT) % 3 = 0",
    "critical_claims": f"SELECT {_K}, claim_text, label FROM central WHERE severity = 'critical'",
    "claim_picker": f"SELECT {_K}, model_name || ' / ' || dataset_item_id || ' · ' || substr(claim_text, 1, 72) AS caption FROM claims",
    "dashboard_kpis": "SELECT count(*) AS claims, count(*) FILTER (label = 'contradicted') AS contradicted, count(*) FILTER (label = 'unknown') AS unknown, count(*) FILTER (severity IN ('severe', 'critical')) AS severe_or_critical, count(DISTINCT dataset_item_id) AS dataset_items FROM facts",
    "severity_by_model": "SELECT model_name, severity, count(*) AS claims FROM facts WHERE severity IS NOT NULL GROUP BY ALL",
    "rates_unpivot": "SELECT model_name, unnest(['supported_rate', 'contradicted_rate', 'unknown_rate']) AS metric, unnest([supported_rate, contradicted_rate, unknown_rate]) AS rate FROM rates",
    "trust_components": f"SELECT {_R}, {_round(*_SIGNALS)} FROM trusts",
    "trust_unpivot": f"SELECT {_R}, unnest({list(_SIGNALS)}) AS signal, round(unnest([{', '.join(_SIGNALS)}]), 9) AS \"value\" FROM trusts",
    "research_summary": "SELECT model_name, response_count, claim_count, supported_rate, contradicted_rate, unknown_rate, hallucination_rate, severity_weighted_error_rate, average_trust_score, verification_accuracy, verification_macro_f1, retrieval_k, retrieval_recall_at_k, confidence_brier_score, confidence_ece FROM mm",
    "summary_totals": "SELECT count(*) AS model_count, CAST(sum(response_count) AS BIGINT) AS total_response_count, CAST(sum(claim_count) AS BIGINT) AS total_claim_count, CAST(sum(supported_count) AS BIGINT) AS total_supported_count, CAST(sum(contradicted_count) AS BIGINT) AS total_contradicted_count, CAST(sum(unknown_count) AS BIGINT) AS total_unknown_count FROM rates",
    "percentages": "SELECT model_name, format('{:.1f}%', 100 * count(*) FILTER (label = 'supported') / count(*)) AS supported, '—' AS missing FROM facts GROUP BY model_name",
    "responses_scan": "SELECT doc_id AS line, CASE WHEN ok THEN model_name END AS model_name, CASE WHEN ok THEN dataset_item_id END AS dataset_item_id, CASE WHEN ok THEN length(text) END AS characters, CASE WHEN ok THEN confidence END AS confidence, ok AS valid FROM (SELECT *, doc_id % 60 NOT IN (1, 2) AS ok FROM resp)",
    "scan_jsonl": "SELECT conv_id || '-' || turn AS file, unnest([1, 3]) AS line, unnest([1, 2]) AS record, unnest([NULL, CASE turn WHEN 1 THEN 'not an object' WHEN 2 THEN 'invalid JSON' END]) AS error, unnest([NULL, CASE WHEN turn NOT IN (1, 2) THEN md5(text) END]) AS text_md5 FROM conversations",
    "content_sha256": "SELECT item_id, sha256(text) AS sha256 FROM benchmark",
    "static_generation": "SELECT 'static' AS model_name, dataset_item_id, sha256(text) AS text_sha256, confidence FROM resp JOIN items USING (dataset_item_id) WHERE model_name = 'model-1' AND topic <> 'topic-3'",
    "report_claims": f"SELECT {_K}, count(*) AS copies FROM claims GROUP BY ALL",
}
PARTS["bhit"] = f"""SELECT {_K}, pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY score DESC, pos) AS rank FROM (SELECT {_K}, pos, coalesce(sum(q.n * t.n), 0) AS score
    FROM (SELECT {_K}, pos FROM claims CROSS JOIN evi) x LEFT JOIN (SELECT {_K}, unnest(regexp_extract_all(lower(claim_text), '[a-z0-9]+')) AS token, 1 AS n FROM claims) q USING ({_K}) LEFT JOIN (SELECT pos, token, count(*) AS n FROM (SELECT pos, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM evi) GROUP BY ALL) t USING (pos, token) GROUP BY ALL)) WHERE rank <= 3"""
PARTS["bsim"] = f"""SELECT {_K}, max(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END) AS similarity FROM (
    SELECT {_K}, list_distinct(regexp_extract_all(lower(claim_text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(e.text), '[a-z0-9]+')) AS b FROM claims JOIN bhit USING ({_K}) JOIN evi e USING (pos)) GROUP BY ALL"""
_MODEL_TABLE = "model_name, claim_count, supported_rate, contradicted_rate, unknown_rate, severity_weighted_error_rate, average_trust_score, verification_macro_f1, confidence_ece"
ORACLES |= {
    "filter_responses": f"SELECT {_R}, confidence FROM resp WHERE model_name IN ('model-1', 'model-2') AND dataset_item_id BETWEEN 'item-000003' AND 'item-000020'",
    "filter_comparisons": "SELECT model_a, model_b, paired_item_count, round(mean_difference, 9) AS mean_difference, a AS model_a_error_only_items, b AS model_b_error_only_items FROM disc WHERE model_a = 'model-0' AND model_b = 'model-2'",
    "model_table": f"SELECT {_MODEL_TABLE}, retrieval_recall_at_k AS recall_at_5 FROM mm",
    "gold_tallies": "SELECT gold_label AS value, count(*) AS claims, 'label' AS kind FROM gold GROUP BY 1 UNION ALL SELECT gold_severity, count(*), 'severity' FROM gold WHERE gold_severity IS NOT NULL GROUP BY 1",
    "topic_counts": "SELECT topic, count(*) AS prompts, count(*) = 5 AS expected FROM prompts GROUP BY topic",
    "repeated_ids": "SELECT 'ev-' || (pos % 30) AS evidence_id, 'repeated id' AS rule FROM evi GROUP BY 1 HAVING count(*) > 1",
    "first_seen": "SELECT model_name, row_number() OVER (ORDER BY min((doc_id * 7919) % 10007), model_name) - 1 AS k FROM resp GROUP BY model_name",
    "response_confidence": f"SELECT {_K}, confidence FROM claims WHERE confidence IS NOT NULL",
    "retrieval_on_dev": f"SELECT count(*) AS claims, {', '.join(f'round(avg(h{k} / n), 9) AS recall_at_{k}' for k in (1, 3, 5))} FROM relq JOIN split USING (dataset_item_id) WHERE split = 'dev'",
    "candidate_thresholds": "SELECT t AS threshold FROM cand",
}
ORACLES["comparison_counts"] = f"SELECT model_a, model_b, paired_item_count, round(mean_difference, 9) AS supported_rate_difference, a AS model_a_error_only_items, b AS model_b_error_only_items, round({_MCNEMAR}, 9) AS mcnemar_exact_p_value FROM disc"
ORACLES["report_roundtrip"] = f"""SELECT {_K}, claim_start, claim_end, claim_text, label AS verification_label, severity, verification_reason, e AS evidence_ids, md5(text) AS response_md5, {_round("similarity", "support_score", "contradiction_score", "trust_score")}
    FROM facts JOIN ({ORACLES["verification_explanations"]}) USING ({_K}) JOIN (SELECT {_R}, text FROM resp) USING ({_R}) LEFT JOIN (SELECT {_R}, trust_score FROM trusts) USING ({_R}) JOIN (SELECT {_K}, string_agg(evidence_id, ',' ORDER BY rank) AS e FROM hits GROUP BY ALL) USING ({_K})"""
ORACLES["baseline_retrieval"] = f"SELECT {_K}, evidence_id, rank, CAST(score AS DOUBLE) AS score FROM bhit JOIN evi USING (pos)"
ORACLES["baseline_verification"] = f"SELECT {_K}, round(similarity, 9) AS similarity, CASE WHEN similarity > 0.25 THEN 'supported' ELSE 'unknown' END AS label FROM bsim"

_TOKENS = "list_distinct(list_transform(regexp_extract_all({}, '(?i)[a-z0-9]+(?:''[a-z0-9]+)?'), lambda x: lower(x)))"
PARTS["bids"] = f"SELECT {_K}, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY rank) AS evidence_ids FROM bhit GROUP BY ALL"
PARTS["jhit"] = f"""SELECT {_K}, pos FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY round(CASE WHEN top > 0 THEN s / top ELSE 0 END, 12) DESC, pos) AS rank FROM (
    SELECT {_K}, pos, coalesce(s, 0) AS s, max(coalesce(s, 0)) OVER (PARTITION BY {_K}) AS top FROM (SELECT {_K}, pos FROM claims CROSS JOIN evi) x LEFT JOIN bm25 USING ({_K}, pos))) WHERE rank <= 5"""
PARTS["jsim"] = f"""SELECT {_K}, any_value(claim_text) AS claim_text, max(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END) AS similarity FROM (
    SELECT {_K}, claim_text, {_TOKENS.format("claim_text")} AS a, {_TOKENS.format("e.text")} AS b FROM claims JOIN jhit USING ({_K}) JOIN evi e USING (pos)) GROUP BY {_K}"""
PARTS["jlab"] = "SELECT *, CASE WHEN similarity > 0.25 THEN 'supported' ELSE 'unknown' END AS label FROM jsim"
PARTS["jrul"] = f"SELECT *, CASE WHEN label <> 'supported' THEN {_domains('claim_text')} ELSE [] END AS domains, {_advice('claim_text')} AS advice FROM jlab"
PARTS["jfact"] = f"SELECT *, CASE WHEN label <> 'supported' THEN {_LEVELS}[1 + {_level('label', '0', '0', '1')}] END AS severity FROM jrul"
PARTS["jout"] = f"SELECT {_R}, avg(CASE WHEN label = 'supported' THEN 1.0 WHEN label IS NOT NULL THEN 0 END) AS rate FROM resp LEFT JOIN jfact USING ({_R}) GROUP BY ALL"
PARTS["jduel"] = "SELECT a.model_name, b.model_name AS other, round(avg(a.rate - b.rate), 9) AS d FROM jout a JOIN jout b USING (dataset_item_id) WHERE a.model_name <> b.model_name GROUP BY ALL"
PARTS["jgold"] = f"SELECT model_name, avg(CASE WHEN label = CASE quality WHEN 1 THEN 'supported' ELSE 'unknown' END THEN 1.0 ELSE 0 END) AS gold_accuracy FROM jfact JOIN resp USING ({_R}) JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY model_name"
ORACLES["job1_claim_ledger"] = f"""SELECT coalesce(nullif(source, ''), 'unknown') AS model_name, CAST(doc_id AS VARCHAR) AS dataset_item_id, claim_id, claim_text, claim_start, claim_end, evidence_ids, round(similarity, 9) AS similarity,
    CASE WHEN similarity > 0.25 THEN 'supported' ELSE 'unknown' END AS label FROM claims JOIN bsim USING ({_K}) JOIN bids USING ({_K}) JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)"""
ORACLES["job2_model_scorecards"] = f"""SELECT r.model_name, r.responses, coalesce(f.claims, 0) AS claims, coalesce(f.supported, 0) AS supported, {", ".join(f"coalesce(f.{k}, 0) AS {k}" for k in ("mild", "moderate", "severe", "critical"))},
    coalesce(d.better_than, 0) AS better_than, coalesce(d.worse_than, 0) AS worse_than, round(f.supported / f.claims, 9) AS supported_rate, round(f.mean_similarity, 9) AS mean_similarity, round(g.gold_accuracy, 9) AS gold_accuracy
    FROM (SELECT model_name, count(*) AS responses FROM resp GROUP BY model_name) r
    LEFT JOIN (SELECT model_name, count(*) AS claims, count(*) FILTER (label = 'supported') AS supported, avg(similarity) AS mean_similarity, {", ".join(f"count(*) FILTER (severity = '{k}') AS {k}" for k in ("mild", "moderate", "severe", "critical"))} FROM jfact GROUP BY model_name) f USING (model_name)
    LEFT JOIN (SELECT model_name, count(*) FILTER (d > 0) AS better_than, count(*) FILTER (d < 0) AS worse_than FROM jduel GROUP BY model_name) d USING (model_name)
    LEFT JOIN jgold g USING (model_name)"""


def _final(sql: str) -> str:
    """A statement with its own WITH becomes the end of the parts' list."""
    if not sql.lstrip().startswith("WITH "):
        return oracle(sql)
    whole = oracle(sql)
    return re.sub(r"\)\s*\nWITH ", "),\n", whole, count=1) if whole.startswith("WITH RECURSIVE") else whole


ORACLES = {name: _final(sql) for name, sql in ORACLES.items()}
