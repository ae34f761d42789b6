import random
import warnings

import numpy as np
import pyarrow as pa

from groundcheck.llm import _shared
from groundcheck.llm.language_id import CORE, EDGE, TRAIN, ByteGRU, _sampled_pieces, _tokens, fit_language_id, has_letter, held_out, pooled, predict_language, train
from groundcheck.llm.quality import TERMS, WORDS, fit, fit_quality, quality_scores, term_frequencies


def test_gradients():
    net = ByteGRU.fresh(["a", "b", "c"], hidden=4)
    x, size = _tokens([b"hello", b"a", b"xyzzy!!"])
    y = np.array([0, 1, 2])
    _, grads = net.gradients(x, size, y)
    for w, g in zip(net.weights(), grads):
        at = np.unravel_index(np.argmax(np.abs(g)), w.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = net.gradients(x, size, y)[0]
        w[at] = old - step
        down = net.gradients(x, size, y)[0]
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-2 * abs(g[at]) + 1e-4


def naive_positions(net, text):
    """The network's log-probabilities at every byte, written out gate by gate."""
    sigmoid, hidden = lambda v: 1 / (1 + np.exp(-v)), net.recurrent[0].shape[0]
    sides = []
    for d, line in enumerate((text, text[::-1])):
        h, states = np.zeros(hidden), []
        for byte in line:
            a, r = net.tables[d][byte].astype(float), h @ net.recurrent[d].astype(float)
            z, g = sigmoid(a[:hidden] + r[:hidden]), sigmoid(a[hidden : 2 * hidden] + r[hidden : 2 * hidden])
            h = z * h + (1 - z) * np.tanh(a[2 * hidden :] + g * r[2 * hidden :])
            states.append(h)
        sides.append(states if d == 0 else states[::-1])
    score = np.array([np.concatenate(x) @ net.out + net.bias for x in zip(*sides)])
    return score - np.log(np.exp(score).sum(axis=1, keepdims=True))


def test_every_position_counts():
    """Pooling over a batch equals reading each text, or stretch of a long one, byte by byte."""
    net = ByteGRU.fresh(["a", "b", "c"], hidden=4, seed=3)
    texts = [b"One two\ttwo", b"", b"\xc3\xa4b " * 200, b"x", b"long line " * 90, b"y" * CORE]
    at = np.cumsum([0, *map(len, texts)])
    total, n = pooled(net, np.frombuffer(b"".join(texts), np.uint8), at)
    for k, t in enumerate(texts):
        t, want = t.lower().replace(b"\t", b" "), np.zeros(3)
        for c in range(0, len(t), CORE):
            a = max(0, c - EDGE)
            want += naive_positions(net, t[a : c + CORE + EDGE])[c - a : c - a + CORE].sum(axis=0)
        assert np.allclose(total[k], want, rtol=1e-4, atol=1e-3)
        assert n[k] == len(t)


def test_state_crosses_words():
    net = ByteGRU.fresh(["a", "b"], hidden=4, seed=3)
    one, other = (naive_positions(net, t) for t in (b"first word", b"other word"))
    assert abs(one[6:] - other[6:]).max() > 1e-3
    x, size = _tokens([b"first word", b"other word"])
    part = net.log_probabilities(x, size, np.array([6, 6]), size)
    assert np.allclose(part, [one[6:].sum(axis=0), other[6:].sum(axis=0)], atol=1e-3)


def odd_rows(net):
    """Rows in no order of size, the positions that count of each, and what they should give."""
    rows = [b"some longer row " * 3, b"ab", b"one more of middle size", b"x"]
    lo, hi = np.array([6, 0, 6, 0]), np.array([40, 2, 20, 1])
    return *_tokens(rows), lo, hi, [naive_positions(net, t)[a:b].sum(axis=0) for t, a, b in zip(rows, lo, hi)]


def test_rows_of_any_order_and_part():
    net = ByteGRU.fresh(["a", "b", "c"], hidden=4, seed=3)
    *given, want = odd_rows(net)
    assert np.allclose(net.log_probabilities(*given), want, rtol=1e-4, atol=1e-3)


def test_no_state_beyond_what_counts(monkeypatch):
    """Neither what lies behind a row or the last position that counts is read, nor, from behind, what lies before the first."""
    net, states, count = ByteGRU.fresh(["a", "b"], hidden=4, seed=3), ByteGRU._states, []

    def spy(self, *args):
        for step in states(self, *args):
            count.append(step[-1].size // 4)
            yield step

    monkeypatch.setattr(ByteGRU, "_states", spy)
    x, size = _tokens([b"12345678", b"1234567890", b"123"])
    net.log_probabilities(x, size, np.array([2, 2, 2]), np.array([7, 6, 3]))
    assert sum(count) == (7 + 7 + 3) + (6 + 8 + 1)


def test_shut_gates():
    """Weights so large that exponentials overflow give what they should, without a warning."""
    net = ByteGRU.fresh(["a", "b", "c"], hidden=4, seed=3)
    for w in (*net.tables, *net.recurrent):
        w *= 400
    *given, want = odd_rows(net)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        found = net.log_probabilities(*given)
    assert np.allclose(found, want, rtol=1e-3, atol=1e-2)


def language_rows(seed=0):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "to", "ri", "mo"], "bb": ["str", "sch", "ing", "eln"]}
    rows = []
    for k in range(200):
        lang = "aa" if k % 2 else "bb"
        rows.append((k, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), lang))
    return [*rows, (200, None, "aa"), (201, "", "bb"), (202, "12 !! 34", "aa"), (203, "katori " * 20000, None), (None, "mokari tori", None)]


def test_language_id(spark):
    rows = language_rows()
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, row string, score double").repartition(3)
    net = fit_language_id(docs.where(~held_out()), steps=150)
    out = predict_language(docs, net).select("row.doc_id", "row.lang", held_out("row.doc_id").alias("held"), "lang_pred", "score").collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held and r.doc_id < 200]
    assert len(held) > 40 and np.mean([r.lang_pred == r.lang for r in held]) >= 0.97
    by = {r.doc_id: r for r in out}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (200, 201, 202))
    assert by[203].lang_pred == by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    net = fit_language_id(none)
    assert predict_language(none, net).collect() == []
    some = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in predict_language(some, net).collect()] == ["und"]
    one = train([b"abc"], [0], ["aa"])
    assert predict_language(some, one).first().lang_pred == "aa"


def quality_rows():
    rng, rows = random.Random(1), []
    for k in range(240):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(10, 60))]
        if k % 3 == 0:
            words = [w + "***" for w in words] if k % 2 else [words[0]] * len(words)
        rows.append((k, " ".join(words), int(k % 3 != 0)))
    return rows


def test_quality(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t, 5.0) for i, t, _ in rows] + [(300, None, 1.0), (301, "", 1.0), (302, "ok " * 30000, 1.0), (None, "fine words here", 1.0)], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, None), (999, 1), (7, 1)], "doc_id long, quality int")
    model = fit_quality(docs, labels.where(~held_out()))
    out = {r.row.doc_id: r.score for r in quality_scores(docs, model).collect()}
    assert len(out) == len(rows) + 4 and all(0 <= s <= 1 for s in out.values())
    tested = [(out[i], q) for i, _, q in rows if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert len(tested) > 50 and np.mean([(s >= 0.5) == q for s, q in tested]) >= 0.95
    assert out[300] == out[301] == model.prior


def test_quality_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    assert quality_scores(docs, model).collect() == []
    some = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert quality_scores(some, model).first().score == 0.5


def test_votes_are_exact():
    """Blocked products give the same neighbours as one full sort."""
    texts = [t.encode() for _, t, _ in quality_rows()]
    at = np.cumsum([0, *map(len, texts)])
    terms = term_frequencies(np.frombuffer(b"".join(texts), np.uint8), at)
    y = np.array([q for _, _, q in quality_rows()], float)
    model = fit(terms[:150], y[:150])
    cosine = model.vectors_of(terms[150:]) @ model.vectors.T
    for k, score in enumerate(model.scores(terms[150:])):
        near = np.argsort(-cosine[k])[:25]
        w = np.maximum(cosine[k][near], 0)
        assert abs(score - (w * model.labels[near]).sum() / w.sum()) < 1e-4


def test_letters():
    assert [has_letter(t) for t in (None, "", "12 ²½ _!", "²é", "日", "ª", "٣", "x")] == [False, False, False, True, True, True, False, True]


def test_training_reads_all_pieces():
    """Pieces are drawn from a whole text at even steps, white space as blanks."""
    text = "".join(chr(0x4E00 + k) for k in range(400))  # one word of 1,200 bytes
    batch = pa.RecordBatch.from_arrays([pa.array(["zh", "en", "en"]), pa.array([text, "One\n two", None])], names=["lang", "text"])
    pieces = [text.encode()[k : k + TRAIN] for k in range(0, 1200, TRAIN)]
    (all_,), (some,) = (list(_sampled_pieces(most)([batch])) for most in (100, 5))
    assert all_.to_pydict() == {"lang": ["zh"] * 19 + ["en"], "piece": [*pieces, b"one  two"]}
    assert some.to_pydict() == {"lang": ["zh"] * 5 + ["en"], "piece": [*pieces[::4], b"one  two"]}


def test_repeated_ids_keep_the_sample_bounded(spark):
    """However many rows share the ids that are drawn, one a language counts."""
    docs = spark.createDataFrame([(k % 3, f"text {k}", "en") for k in range(3000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, quality int")
    assert len(fit_quality(docs, labels).labels) == 3
    assert fit_language_id(docs, steps=1).langs == ["en"]


def test_names_that_differ_in_case(spark):
    docs = spark.createDataFrame([(1, "some text", 5, "no")], "doc_id long, text string, Text_ int, more string").toDF("doc_id", "text", "DOC_ID", "Text")
    assert _shared.only(docs, "text", "doc_id").collect() == [("some text", 1)]
    row = quality_scores(docs, fit(np.zeros((0, TERMS), np.float32), np.zeros(0))).first().row
    assert tuple(row) == (1, "some text", 5, "no")


def test_ties_of_neighbours_go_by_id():
    """More equally similar neighbours than have a vote: the first of the sample vote."""
    texts = [b"same words here"] * 60 + [b"other things | entirely"] * 10
    terms = term_frequencies(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    y = np.array([1.0] * 20 + [0.0] * 40 + [1.0] * 10)
    assert abs(fit(terms, y).scores(terms[:1])[0] - 20 / 25) < 1e-9


def test_scores_against_plain_arithmetic():
    """Weights, projection and vote equal a full decomposition and a plain sort."""
    rows = quality_rows()[:90]
    texts = [t.encode() for _, t, _ in rows]
    terms = term_frequencies(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    y = np.array([q for _, _, q in rows], float)
    model = fit(terms[:60], y[:60], rank=8)
    weight = np.log(61 / (1 + (terms[:60] > 0).sum(axis=0))) + 1
    first, last = TERMS - WORDS - 3 * 16, TERMS - WORDS
    weight[first:last] = 0.5
    x = terms * weight
    for part, length in ((slice(0, first), 1), (slice(last, None), 0.5)):
        x[:, part] *= length / np.linalg.norm(x[:, part], axis=1, keepdims=True)
    basis = np.linalg.svd(x[:60], full_matrices=False)[2][:8]
    v = x @ basis.T
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = model.scores(terms[60:])
    for k, row in enumerate(v[60:] @ v[:60].T):
        near = sorted(range(60), key=lambda j: (-row[j], j))[:25]
        w = [max(row[j], 0) for j in near]
        assert abs(found[k] - sum(a * y[j] for a, j in zip(w, near)) / sum(w)) < 0.02


def test_quality_by_words():
    """Texts of one shape are told apart by their words, with and without spaces."""
    rng, rows = random.Random(2), []
    vocabularies = {1: ("river stone maple cloud".split(), "山川草木"), 0: ("click prize bonus cheap".split(), "金赌奖券")}
    for k in range(200):
        spaced, dense = vocabularies[k % 2]
        rows.append((" ".join(rng.choices(spaced, k=30)) if k % 4 < 2 else "".join(rng.choices(dense, k=30)), k % 2))
    texts = [t.encode() for t, _ in rows]
    terms = term_frequencies(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    y = np.array([q for _, q in rows], float)
    assert np.mean((fit(terms[:100], y[:100]).scores(terms[100:]) >= 0.5) == y[100:]) >= 0.95
