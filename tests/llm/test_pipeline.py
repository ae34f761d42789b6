import importlib.util

import pytest
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline

from tests.llm.conftest import small_docs
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_dedup import brute_components, brute_exact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, lang, "s", len(t or "")) for i, t, lang in small_docs()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"shared{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    """Each stage does what brute force says on its own input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: (r.doc_id, r.text, r.lang) for r in docs.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    docs = stages[0](spark, docs, folder)
    assert docs.columns == COLUMNS
    kept = ids(docs)
    assert set(rows) - set(kept) == {92, 93, 94, 95}
    docs = stages[1](spark, docs, folder)
    assert docs.columns == COLUMNS
    kept = sorted(i for i, _, _, stays, _ in brute_exact([rows[i] for i in kept]) if stays)
    assert ids(docs) == kept
    docs = stages[2](spark, docs, folder)
    assert docs.columns == COLUMNS
    kept = sorted(i for i, (_, c) in brute_components([rows[i] for i in kept]).items() if i == c)
    assert ids(docs) == kept
    docs = stages[3](spark, docs, folder)
    assert docs.columns == COLUMNS
    kept = [i for i, _, hit, _ in leaks([rows[i] for i in kept], [(1, " ".join(f"shared{k}" for k in range(20)))]) if not hit]
    assert ids(docs) == kept and not set(kept) & set(range(85, 92))
    docs = stages[4](spark, docs, folder)
    assert docs.columns == [*COLUMNS, "n_tokens", "ids", "begin", "end", "decoded"] and ids(docs) == kept and len(stages) == 5
    assert ids(corpus_pipeline.run(spark, folder)) == kept


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_decoded(spark, folder):
    """The pipeline ends with ids, spans and the text that the library decodes from the ids."""
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == [*COLUMNS, "n_tokens", "ids", "begin", "end", "decoded"]
    rows = found.collect()
    assert rows and all(r.decoded == library.decode(r.ids) and r.ids == library.encode(r.text, add_bos=True, add_eos=True) for r in rows)


def test_without_labelled_rows(spark, folder):
    """Without a language to learn from, texts with letters stay as they do with one."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    left = corpus_pipeline.language_id(spark, docs, folder)
    assert left.columns == COLUMNS
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()} == {92, 93, 94, 95}


def test_odd_rows(spark, folder, tmp_path):
    """Null ids, repeated rows, ids of several texts and columns of clashing names pass every stage."""
    a, b = "alpha beta gamma delta " * 5, "one two three four five six " * 4
    rows = [(1, a), (1, a), (2, b), (2, "quite another text than those, of some length"), (None, a), (None, None), (3, "12"), (4, b.upper())]
    kinds = "doc_id long, text string, lang string, id int, row string, ids string, n_hit int, gone int, text_hash int, kept int"
    docs = spark.createDataFrame([(*r, "en", 1, "r", "x", 2, 3, 4, 5) for r in rows], kinds)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "pieces"]
    # a: rows 1 (repeated whole) stay, the null id goes; b: 4 stays, its copy under 2 goes, the other text of 2 stays
    assert sorted((r.doc_id, r.text[:5]) for r in out.collect()) == [(1, "alpha"), (1, "alpha"), (2, "quite"), (4, "ONE T")]
    assert all(r.pieces.decoded == r.text.strip(" ") or r.pieces.decoded == r.text for r in out.collect())
