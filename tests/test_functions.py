import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from groundcheck.functions import scores as S, text as X
from groundcheck.functions.models import DEFAULT_OUTPUTS, ClassifierNLI, checked_probabilities, checked_vectors, distributions, output_places
from groundcheck.operators.calibration import threshold_grid


def claims_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.claims(F.col("t")).alias("c")).collect()
    return {r.k: [(c.claim_text, c.claim_start, c.claim_end) for c in r.c or []] for r in rows}


def model(text):
    """The same by Python's own regular expressions and forward search."""
    cut = re.compile(r"(?<=[.!?])\s+|\s*[;:]\s*|\s+(?:" + "|".join(X.CONJUNCTIONS) + r")\s+|\s*(?:--|—)\s*", re.I)
    out, at = [], 0
    for part in (p.strip() for p in cut.split(text)):
        if part:
            start = text.find(part, at)
            at = start + len(part)
            out.append((part, start, at))
    return out


def test_claims(spark):
    texts = ["Water freezes at 0 C. The moon is a planet!", "Canberra is the capital of Australia and Sydney is the capital of New South Wales.", "b and a", "", " \t", "x; y: z -- w — v", "A BUT b\nAND c", "é — ö. Ü", None]
    found = claims_of(spark, texts)
    for k, t in enumerate(texts):
        assert found[k] == (model(t) if t else [])
    assert found[2] == [("b", 0, 1), ("a", 2, 3)]  # found by search, inside the conjunction
    assert len(found[0]) == len(found[1]) == 2 and found[0][0][1] == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?;:-—\n\tandorANDé", max_size=60), min_size=20, max_size=20))
def test_claims_property(spark, texts):
    for k, got in claims_of(spark, texts).items():
        assert got == model(texts[k])
        assert all(texts[k][a:b] == c for c, a, b in got)


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_tokens_and_similarity(spark):
    lit = F.lit
    assert one(spark, X.tokens(lit("It's A 3-way 'test' O'Neil's"))) == (["it's", "a", "3", "way", "test", "o'neil", "s"],)
    assert one(spark, X.plain_tokens(lit("It's A"))) == (["it", "s", "a"],)
    jac = lambda a, b: X.jaccard(F.array_distinct(X.plain_tokens(lit(a))), F.array_distinct(X.plain_tokens(lit(b))))
    assert one(spark, jac("cats", "quantum mechanics"), jac("", "x"), jac("a b", "b c")) == (0.0, 0.0, pytest.approx(1 / 3))
    vec = lambda *v: F.array(*(lit(float(x)) for x in v))
    assert one(spark, S.cosine_unit(vec(1, 0), vec(2, 0)), S.cosine_unit(vec(1, 0), vec(0, 1)), S.cosine_unit(vec(0, 0), vec(0, 1)), S.cosine_unit(vec(1, 0), vec(-1, 0))) == (1.0, 0.5, 0.0, 0.0)


def test_labels(spark):
    l = lambda s, c: S.label(F.lit(s), F.lit(c))  # noqa: E741, E731
    assert one(spark, l(0.97 * 0.95 * 0.96, 0.0), l(0.0, 0.96 * 0.95 * 0.98), l(0.6, 0.6), l(0.55, 0.1), l(0.54, 0.1)) == ("supported", "contradicted", "unknown", "supported", "unknown")


CASES = [
    ("x", "unknown", 0.0, 0.0, "mild"), ("x", "contradicted", 0.0, 0.0, "moderate"), ("x", "contradicted", 0.9, 0.0, "severe"), ("x", "contradicted", 0.5, 0.8, "severe"), ("x", "contradicted", 0.95, 1.0, "severe"),
    ("Take the medicine", "unknown", 0.0, 0.0, "critical"), ("You should invest in stock", "unknown", 0.0, 0.0, "critical"), ("You must sign the contract", "unknown", 0.0, 0.0, "critical"), ("Mix the chemicals", "unknown", 0.0, 0.0, "critical"),
    ("The court met", "unknown", 0.0, 0.5, "severe"), ("The court met", "unknown", 0.0, 0.0, "mild"), ("Take insulin", "supported", 0.0, 1.0, None), ("ädose", "unknown", 0.0, 0.6, "mild"),
]


def test_severity(spark):
    rows = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CASES)], "k int, t string, l string, c double, z double")
    domains, advice = S.risk_domains(F.col("t")), S.gives_advice(F.col("t"))
    level, reason = S.severity(F.col("l"), F.col("c"), domains, advice, F.col("z"))
    found = {r.k: (r.s, r.r) for r in rows.select("k", level.alias("s"), reason.alias("r")).collect()}
    for k, c in enumerate(CASES):
        assert found[k][0] == c[4], c
    assert found[4][1].endswith("High response centrality (1.00) was considered; severity escalation is capped at severe unless the claim contains actionable high-impact advice.")
    assert found[5][1] == "Unknown claims start at mild severity. Unsupported actionable advice in a high-impact domain is critical. Detected high-impact domain(s): medical."


def test_mcnemar(spark):
    p = lambda a, b: S.mcnemar_p(F.lit(a).cast("long"), F.lit(b).cast("long"))
    assert one(spark, p(0, 0), p(0, 1), p(0, 5), p(1, 7)) == (1.0, 1.0, pytest.approx(0.0625), pytest.approx(0.0703125))
    (big,) = one(spark, p(900, 1000))
    from math import comb

    assert big == pytest.approx(2 * sum(comb(1900, i) for i in range(901)) / 2**1900)


def test_markup(spark):
    assert one(spark, X.escape_html(F.lit("""<a & "b" 'c'>"""))) == ("&lt;a &amp; &quot;b&quot; &#x27;c&#x27;&gt;",)
    h = lambda s, e, l="contradicted": X.highlight(F.lit("a <b> c"), F.lit("<b>"), F.lit(s), F.lit(e), F.lit(l))  # noqa: E741, E731
    mark = '<mark style="background:{};padding:.12rem .22rem;border-radius:.25rem">&lt;b&gt;</mark>'
    assert one(spark, h(2, 5), h(2, 4), h(-1, 5), h(5, 2), h(2, 99), h(2, 5, "other")) == (f"a {mark.format('#ffe0e0')} c", None, None, None, None, f"a {mark.format('#e8eef5')} c")
    assert one(spark, X.three(F.lit(0.0625)), X.percent(F.lit(0.1234)), X.percent(F.lit(None).cast("double"))) == ("0.062", "12.3%", "—")


def test_threshold_grid():
    assert len(threshold_grid()) == 21 and threshold_grid(0.3) == [0.0, 0.3, 0.6, 0.9, 1.0]
    with pytest.raises(ValueError):
        threshold_grid(0)


def test_model_checks():
    with pytest.raises(ValueError):
        checked_vectors([[1.0], [1.0, 2.0]], 2)
    with pytest.raises(ValueError):
        checked_vectors([[float("nan")]], 1)
    with pytest.raises(ValueError):
        checked_probabilities([(0.5, 0.5, 0.5)], 1)


def test_classifier_outputs():
    assert output_places({0: "CONTRADICTION", 1: "neutral", 2: "entailment"}) == (2, 0, 1)
    assert output_places({"0": "LABEL_0", "1": "LABEL_1", "2": "LABEL_2"}, {"label_0": "Entailment", "label_1": "neutral", "label_2": "contradiction"}) == (0, 2, 1)
    assert output_places({0: "LABEL_0"}, fallback=DEFAULT_OUTPUTS) == (2, 0, 1)
    for bad in ({0: "a"}, {0: "neutral", 1: "neutral", 2: "entailment"}, {0: "entailment", 1: "not_entailment", 2: "neutral"}):
        with pytest.raises(ValueError):
            output_places(bad)
    with pytest.raises(ValueError):
        output_places({0: "neutral", 1: "b", 2: "c"}, fallback=DEFAULT_OUTPUTS)
    assert distributions(np.array([[0.0, np.log(3), -1000.0]]), (1, 0, 2)).tolist() == [pytest.approx([0.75, 0.25, 0.0])]
    for narrow in (np.zeros((2, 2)), np.zeros(3)):
        with pytest.raises(ValueError, match="output 2"):
            distributions(narrow, (2, 0, 1))


def test_classifier_in_batches():
    asked = []

    def load(name):
        def logits(premises, hypotheses):
            asked.append(len(premises))
            return np.array([[len(p), len(h), 0.0] for p, h in zip(premises, hypotheses)])

        return {0: "entailment", 1: "contradiction", 2: "neutral"}, logits

    pairs = [("a" * k, "b") for k in range(7)]
    found = ClassifierNLI("any", batch=3, load=load).predict_many(pairs)
    assert asked == [3, 3, 1] and checked_probabilities(found, 7).shape == (7, 3)
    assert (np.diff(found[:, 0]) > 0).all()
    assert len(ClassifierNLI("any", load=load).predict_many([])) == 0
    with pytest.raises(ValueError):
        ClassifierNLI("any", load=lambda name: ({0: "x"}, None))


def test_digests_of_highlights(spark):
    """The hashes are those of the pages, which are not made."""
    text = "a <b> & é \"c\" 😀 'd'"
    spans = [("<b>", 2, 5, "supported"), ("é", 8, 9, "contradicted"), ("😀 'd'", 14, 19, "unknown"), ("a", 0, 1, "other"), ("<b> &", 2, 7, "unknown"), ("x", 0, 1, "unknown"), ("", 3, 3, "unknown"), ("'d'", 16, 20, "unknown"), ("a", -1, 1, "unknown")]
    rows = spark.createDataFrame([(f"c{k}", *s, text) for k, s in enumerate(spans)], "claim_id string, claim_text string, claim_start int, claim_end int, label string, text string")
    wanted = {r[0]: r[1] for r in rows.select("claim_id", F.sha2(X.highlight(*(F.col(c) for c in ("text", "claim_text", "claim_start", "claim_end", "label"))), 256)).collect()}
    line = rows.groupBy("text").agg(F.collect_list(F.struct("claim_id", "claim_text", "claim_start", "claim_end", "label")).alias("line"))
    assert dict(line.select(F.explode(X.highlight_digests(F.col("text"), F.col("line"))).alias("d")).select("d.*").collect()) == wanted
    assert sum(d is not None for d in wanted.values()) == 5


def test_words_begin_behind_no_letter(spark):
    """The faster pattern for words that begin with letters finds what a word boundary finds; others keep the plain one."""
    assert S._word("tax(?:es|ation)?|loan").startswith("(?<!") and not S._word("-x|loan").startswith("(?<!") and not S._word("x?-y").startswith("(?<!")
    rows = spark.createDataFrame([(t,) for t in ("loan", "a loan.", "aloan", "1loan", "_loan loan", "éloan", "ſtock", "LOAN-x", "")], "t string")
    plain = F.regexp_like("t", F.lit(r"(?iuU)\b(?:loan|stock)\b"))
    assert [a for a, in rows.select(F.regexp_like("t", F.lit(S._word("loan|stock")))).collect()] == [a for a, in rows.select(plain).collect()]


def test_claims_of_odd_letters(spark):
    """Letters that fold to a conjunction's cut, separators that Unicode does not count as white space do not."""
    found = claims_of(spark, ["x ſo y", "a whİle b whıle c", "a\x1c;\x1cb", "a;　b", "\x1f and \x1f"])
    assert [[c for c, _, _ in found[k]] for k in range(5)] == [["x", "y"], ["a", "b", "c"], ["a\x1c", "\x1cb"], ["a", "b"], ["\x1f", "\x1f"]]
