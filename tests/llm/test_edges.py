"""What every operator on documents does with very long texts, repeated rows, ties, nulls and clashing names."""

import hashlib

import pytest

from groundcheck.llm.chat_format import chat_format
from groundcheck.llm.decontaminate import find_contamination
from groundcheck.llm.exact_dedup import exact_dedup
from groundcheck.llm.language_id import fit_language_id, predict_language
from groundcheck.llm.quality import fit_quality, quality_scores
from groundcheck.llm.sentencepiece_codec import sentencepiece_encode
from groundcheck.llm.sharding import shard_by_bytes
from groundcheck.llm.simhash import simhash_components
from groundcheck.llm.substring_dedup import substring_dedup
from groundcheck.llm.warc import look_up, write_archives

WORDS = 1_700_000
LONG = "tick tock " * (WORDS // 2)  # 8.5 MB: more than a batch and than a chunk
ROWS = [(1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, "tick tock " * 30, "en"), (3, "another text under one id", "de"), (None, None, None), (None, "x", "de"), (4, "", "en")]
#: Names that operators use themselves, and some that differ from the text's or id's only in case.
NAMES = ["doc_id", "text", "lang", "Doc_Id", "TEXT", "id", "row", "score", "spans", "items", "win", "digest"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "no", 5, 7, "r", 0.5, "s", "i", 1, "d") for r in ROWS], ", ".join(f"c{k} {t}" for k, t in enumerate("long string string string int long string double string string int string".split()))).toDF(*NAMES).repartition(3)


def by_id(rows, *names):
    return sorted(((-1 if r[0] is None else r[0], *(r[n] for n in names)) for r in rows), key=str)


def test_substring(odd):
    # of the two windows that there are, the first of each starts within the first two words
    found = by_id(substring_dedup(odd).collect(), "n_words", "n_removed")
    assert found == by_id([(-1, 0, 0), (-1, 1, 0), (1, WORDS, WORDS - 2), (2, WORDS, WORDS), (2, WORDS, WORDS), (3, 5, 0), (3, 60, 60), (4, 0, 0)], 1, 2)


def test_sentencepiece(odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    from pyspark.sql import types as T

    short = lambda e: (len(e.ids), hashlib.sha256(e.ids.astype("<u4").tobytes()).hexdigest(), e.decoded == LONG.strip() or e.decoded == LONG, len(e.decoded))
    kinds = T.StructType.fromDDL("n long, sha string, same boolean, size long")
    out = sentencepiece_encode(odd, path, derive=short, schema=kinds).collect()
    assert len(out) == len(ROWS)
    import numpy as np

    ids = np.array(library.encode(LONG, add_bos=True, add_eos=True), "<u4")
    long = [r for r in out if r.n > 10**5]
    assert len(long) == 3 and all((r.n, r.sha) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()) and r["size"] == len(library.decode(ids.tolist())) for r in long)
    assert sorted(r.n for r in out)[:2] == [2, 2]


def test_exact(odd):
    found = by_id(exact_dedup(odd).collect(), "group_size", "kept")
    assert found == by_id([(-1, 2, False), (-1, 1, True), (1, 3, False), (2, 3, True), (2, 3, True), (3, 1, True), (3, 1, True), (4, 2, True)], 1, 2)


def test_simhash(odd):
    out = simhash_components(odd).collect()
    assert len(out) == len(ROWS)
    long = {(r.fp, r.component_id) for r in out if r.id in (1, 2)}
    assert len(long) == 1 and long.pop()[1] in (1, None)
    assert {r.fp for r in out if r.id == 4} == {0} and len({r.text_hash for r in out if r.id == 3}) == 2


def test_sharding(odd):
    out = shard_by_bytes(odd, shards=3).collect()
    assert len(out) == len(ROWS) and len({r.shard for r in out if r["size"] == len(LONG) + 8}) == 1
    assert sorted((r.shard, r.slot) for r in out) == sorted((s, k) for s in range(3) for k in range(sum(r.shard == s for r in out)))


def test_contamination(spark, odd):
    bench = spark.createDataFrame([(1, "tick tock tick", "x"), (1, "tick tock tick", "x"), (2, None, "x"), (3, "one id", "x")], "item_id long, text string, Item_Id string")
    found = by_id(((r.row[0], r.n_words, r.n_hit, r["items"]) for r in find_contamination(odd, bench).collect()), 1, 2, 3)
    assert found == by_id([(-1, 0, 0, []), (-1, 1, 0, []), *[(k, WORDS, WORDS - 1, ["1"]) for k in (1, 2, 2)], (3, 60, 59, ["1"]), (3, 5, 2, ["3"]), (4, 0, 0, [])], 1, 2, 3)


def test_language(odd):
    out = predict_language(odd, fit_language_id(odd, steps=30)).collect()
    assert len(out) == len(ROWS) and [r.lang_pred for r in out if r.row[1] in (None, "")] == ["und", "und"]
    assert len({(r.lang_pred, r.score) for r in out if r.row[0] in (1, 2)}) == 1  # equal texts are told alike
    assert [tuple(r.row)[3:5] for r in out] == [("no", 5)] * len(ROWS)


def test_quality(spark, odd):
    labels = spark.createDataFrame([(1, 0, "x"), (3, 1, "x"), (3, 1, "x"), (4, 1, "x")], "doc_id long, quality int, Quality_ string").toDF("doc_id", "quality", "QUALITY")
    out = quality_scores(odd, fit_quality(odd, labels)).collect()
    assert len(out) == len(ROWS) and len({r.score for r in out if r.row[0] in (1, 2)}) == 1 and all(0 <= r.score <= 1 for r in out)


def test_chat(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "user", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, t string, p int").toDF("conv_id", "turn", "role", "text", "Text", "part")
    out = chat_format(df).collect()
    assert sorted((r.conv or 0, r.position, r.action) for r in out) == [(0, 0, "keep"), (1, 0, "keep"), (1, 1, "keep"), (1, 2, "merge")]
    assert max(len(r.rendered) for r in out) > len(LONG)


def test_warc(spark):
    rows = [(1, "http://a.org/", LONG), (2, "http://a.org/", LONG), (2, "http://a.org/", LONG), (3, None, None), (None, "http://a.org/", "x")]
    df = spark.createDataFrame([(*r, "x", "k") for r in rows], "page_id long, url string, html string, h string, k string").toDF("page_id", "url", "html", "HTML", "key").repartition(2)
    out = look_up(write_archives(df), df).collect()
    digest = hashlib.sha256(LONG.encode()).hexdigest()
    assert sorted((r.page or 0, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest == digest) for r in out) == [(0, 1, "response", None, False), (1, len(LONG), "response", None, True), *[(2, len(LONG), "revisit", 1, True)] * 2, (3, 0, "response", None, False)]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for found in (substring_dedup(none), exact_dedup(none), simhash_components(none), shard_by_bytes(none), find_contamination(none, spark.createDataFrame([], "item_id long, text string")), predict_language(none, fit_language_id(none)), quality_scores(none, fit_quality(none, spark.createDataFrame([], "doc_id long, quality int")))):
        assert found.collect() == []
