"""The ``opN_*`` queries, each a thin digest of its operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from groundcheck.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message's repair and piece of the rendered chat."""
    from groundcheck.llm.chat_format import chat_format

    found = chat_format(_table(spark, sf_dir, "conversations"))
    joined = {c: F.array_join(c, ",") for c in ("inserted", "inserted_after")}
    return found.withColumns(joined).withColumnRenamed("conv", "conv_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that repeat a window of an earlier place."""
    from groundcheck.llm.substring_dedup import substring_dedup

    found = substring_dedup(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _token_digest(e) -> tuple:
    import hashlib

    spans = e.begin.astype("<u4").tobytes() + e.end.astype("<u4").tobytes()
    return len(e.ids), hashlib.sha256(e.ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(e.decoded.encode()).hexdigest(), hashlib.sha256(spans).hexdigest()


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, their spans and the decoded text, as digests."""
    import public_tokenizers
    from groundcheck.llm.sentencepiece_codec import sentencepiece_encode

    kinds = T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    docs = _documents(spark, sf_dir)
    found = sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"), derive=_token_digest, schema=kinds)
    return found.select("row.doc_id", *kinds.names)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group."""
    from groundcheck.llm.exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    from groundcheck.llm.simhash import simhash_components

    found = simhash_components(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards of near equal bytes."""
    from groundcheck.llm.sharding import shard_by_bytes

    found = shard_by_bytes(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that occurrences of benchmark windows cover."""
    from groundcheck.llm.decontaminate import find_contamination

    docs = _documents(spark, sf_dir)
    found = find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that are not held out."""
    from groundcheck.llm.language_id import fit_language_id, held_out, predict_language

    docs = _documents(spark, sf_dir, "lang")
    net = fit_language_id(docs.where(~held_out()))
    found = predict_language(docs.select("doc_id", "text"), net)
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and read back through their index."""
    from groundcheck.llm.warc import look_up, write_archives

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = look_up(write_archives(pages), pages)
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labels that are not held out."""
    from groundcheck.llm.language_id import held_out
    from groundcheck.llm.quality import fit_quality, quality_scores

    docs = _documents(spark, sf_dir)
    labels = _table(spark, sf_dir, "labels").where(~held_out())
    found = quality_scores(docs, fit_quality(docs, labels))
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best products of every fiftieth vector with all others."""
    from groundcheck.llm.topk_search import exact_top_k

    return exact_top_k(spread(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), lambda c: c % 50 == 0)


def _planted(doc_id: int | None, n: int):
    """Places of the words that stand in for those of a tenth of the documents, so that these repeat from somewhere on."""
    import zlib

    import numpy as np

    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, as digests, and the strongest of them."""
    from groundcheck.llm.periodic_runs import DIGEST, digest, periodic_runs

    found = periodic_runs(_documents(spark, sf_dir), derive=digest, schema=DIGEST, order=_planted)
    return found.select("row.doc_id", *DIGEST.names)


_LOWER_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _windows(table: str, key: str, pattern: str, lower: bool, size: int, short: bool) -> str:
    """Words and windows of a table: ``key, w`` and ``key, i, win`` (words joined by a space)."""
    text = _LOWER_ASCII if lower else "coalesce(text, '')"
    count = f"greatest(len(w) - {size - 1}, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END)" if short else f"greatest(len(w) - {size - 1}, 0)"
    return f"""{table}_w AS MATERIALIZED (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS w FROM {table}),
        {table}_n AS MATERIALIZED (SELECT {key}, i, array_to_string(w[i:i + {size - 1}], ' ') AS win, len(w[i:i + {size - 1}]) AS size FROM (SELECT {key}, w, unnest(range(1, {count} + 1)) AS i FROM {table}_w))"""


SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
        WITH {_windows("documents", "doc_id", _SPACED, False, 20, False)},
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM documents_n) WHERE k > 1),
        c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r) GROUP BY doc_id),
        o AS (SELECT doc_id, w, gone, len(w) AS n FROM documents_w LEFT JOIN c USING (doc_id)),
        u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM documents_w),
        g AS (SELECT DISTINCT doc_id, unnest(gone) AS p FROM c),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM u ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, n AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM o LEFT JOIN k USING (doc_id)""",
    "op7_decontaminate": f"""
        WITH {_windows("documents", "doc_id", _ALNUM, True, 10, False)}, {_windows("benchmark", "item_id", _ALNUM, True, 10, True)},
        q AS (SELECT DISTINCT win, size, item_id FROM benchmark_n),
        s AS (SELECT DISTINCT size FROM q WHERE size < 10),
        a AS (SELECT doc_id, i, win FROM documents_n UNION ALL SELECT doc_id, i, array_to_string(w[i:i + size - 1], ' ') FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS i FROM documents_w CROSS JOIN s)),
        h AS (SELECT doc_id, i, size, item_id FROM a JOIN q USING (win)),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM documents_w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER_ASCII} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
        f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
        SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM p JOIN f ON p.html = f.html""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All operator queries by name."""
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express."""
    return dict(SQL)
