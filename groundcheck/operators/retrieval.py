"""Evidence retrieval: corpus statistics, BM25, dense similarity, hybrid top-k and its metrics.

BM25 weights of every (passage, token) are relational.  Ranking is one pass over
the claims: passages are a stated, bounded side that is broadcast in groups of
at most ``GROUP_BYTES``; within a group a batch of claims is scored against all
passages by matrix products, and only k hits a claim leave the task.  With one
group there is no shuffle, whatever the number of claims, and every passage takes
part, those that score zero too.

With several groups claims are written once and meet every group in one pass of
its own, a task holding one group: what leaves it are the passages that can be
among the k best for any other group's scores (:mod:`.contenders`).  These meet
by claim, in the only shuffle, and are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from groundcheck.functions import scores as S, text as X
from groundcheck.operators.contenders import contenders
from groundcheck.schema import HIT
from groundcheck.session import cut

GROUP_BYTES = 64 << 20  # of passages' tokens and vectors in one broadcast
BLOCK = 256  # passages whose scores are taken at once
VECTOR = 1024  # numbers that a vector is taken to have when groups are cut
CELLS = 1 << 16  # numbers of a product at most, which a core's cache holds


def evidence_tokens(evidence: DataFrame, tokenise=X.tokens) -> DataFrame:
    """``pos, token, tf, length`` for every distinct token of every passage."""
    rows = evidence.select("pos", tokenise(F.col("text")).alias("tokens"))
    rows = rows.select("pos", F.size("tokens").cast("long").alias("length"), F.explode("tokens").alias("token"))
    return rows.groupBy("pos", "length", "token").agg(F.count("*").alias("tf"))


def corpus_stats(evidence: DataFrame) -> DataFrame:
    """``documents, average_length`` over all passages, those without tokens too."""
    return evidence.agg(F.count("*").alias("documents"), F.coalesce(F.avg(F.size(X.tokens(F.col("text")))), F.lit(0.0)).alias("average_length"))


def document_frequency(evidence: DataFrame) -> DataFrame:
    """``token, df``."""
    return evidence_tokens(evidence).groupBy("token").agg(F.count("*").alias("df"))


def bm25_postings(evidence: DataFrame, k1: float = S.K1, b: float = S.B) -> DataFrame:
    """``pos, token, weight``: what one occurrence of the token in a query adds to the passage's score."""
    if not 0 < k1 < float("inf") or not 0 <= b <= 1:
        raise ValueError("k1 must be above 0 and b in [0, 1]")
    tokens = evidence_tokens(evidence)
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    stats = corpus_stats(evidence)
    rows = tokens.join(df, "token").join(F.broadcast(stats))  # one row
    return rows.select("pos", "token", S.bm25_weight(F.col("tf"), F.col("df"), F.col("documents"), F.col("length"), F.col("average_length"), k1, b).alias("weight"))


def overlap_postings(evidence: DataFrame) -> DataFrame:
    """``pos, token, weight`` of the plain baseline: the token's frequency."""
    return evidence_tokens(evidence, X.plain_tokens).select("pos", "token", F.col("tf").cast("double").alias("weight"))


@dataclass
class PassageGroup:
    """Some passages: positions, ids, their token weights by block, and unit vectors."""

    pos: np.ndarray
    ids: list[str]
    vocabulary: pa.Array
    token: np.ndarray
    row: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray | None

    def sets(self) -> list[frozenset[int]]:
        """The numbers of each passage's different tokens."""
        at = np.searchsorted(self.row, np.arange(len(self.pos) + 1))
        return [frozenset(self.token[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Passages a to b with their tokens' weights as a dense matrix over the block's own vocabulary."""
        for a in range(0, len(self.pos), BLOCK):
            b = min(a + BLOCK, len(self.pos))
            lo, hi = np.searchsorted(self.row, [a, b])
            own, place = np.unique(self.token[lo:hi], return_inverse=True)
            dense = np.zeros((len(own) + 1, b - a))  # the last row is for all other tokens
            dense[place, self.row[lo:hi] - a] = self.weight[lo:hi]
            where = np.full(len(self.vocabulary) + 1, len(own), np.int64)
            where[own] = np.arange(len(own))
            yield a, b, dense, where


def _groups(evidence: DataFrame, postings: DataFrame, vectors: DataFrame | None) -> Iterator[PassageGroup]:
    """Passages in groups of positions; the driver holds one group at a time."""
    total = evidence.agg(F.count("*"), F.min("pos"), F.max("pos"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_distinct("evidence_id"), F.count_distinct("pos")).first()
    if total[4] < total[0] or total[5] < total[0]:
        raise ValueError("passages need ids and positions of their own")
    size = 12 * total[3] + (8 * VECTOR * total[0] if vectors is not None else 0)
    if not total[0]:
        return
    groups = -(-size // GROUP_BYTES) or 1
    step = -(-(total[2] - total[1] + 1) // groups)
    for low in range(total[1], total[2] + 1, step):
        part = F.col("pos").between(low, low + step - 1)
        rows = sorted((r.pos, r.evidence_id) for r in evidence.where(part).select("pos", "evidence_id").collect())
        if not rows:
            continue
        at = {p: k for k, (p, _) in enumerate(rows)}
        held = postings.where(part).select("pos", "token", "weight").toArrow()
        tokens = held.column("token").combine_chunks()
        tokens = tokens if isinstance(tokens, pa.Array) else pa.concat_arrays(tokens.chunks)
        vocabulary = pc.unique(tokens)
        row = np.array([at[p] for p in held.column("pos").to_pylist()], np.int64)
        order = np.argsort(row, kind="stable")
        found = None
        if vectors is not None:
            by = {r.pos: r.vector for r in vectors.where(part).select("pos", "vector").collect()}
            found = np.array([by[p] for p, _ in rows], np.float64)
            size = np.linalg.norm(found, axis=1, keepdims=True)
            found = np.where(size > 0, found / np.where(size > 0, size, 1), 0)
        yield PassageGroup(np.array([p for p, _ in rows]), [i for _, i in rows], vocabulary, pc.index_in(tokens, vocabulary).to_numpy(zero_copy_only=False)[order].astype(np.int64), row[order], held.column("weight").to_numpy()[order], found)


def _lexical_scores(own: PassageGroup, token: np.ndarray, edge: np.ndarray, n: int, block) -> np.ndarray:
    """Sums of the weights of each claim's tokens in each passage of a block."""
    a, b, weights, where = block
    out = np.zeros((n, b - a))
    place = where[token]
    use = np.flatnonzero(place < len(weights) - 1)
    if len(use):
        claim = np.searchsorted(edge, use, "right") - 1
        step = max(1, CELLS // (b - a))
        for lo in range(0, len(use), step):
            part = slice(lo, lo + step)
            head = np.flatnonzero(np.append(True, claim[part][1:] != claim[part][:-1]))
            out[claim[part][head]] += np.add.reduceat(weights[place[use[part]]], head, axis=0)
    return out


def _numbers(own: PassageGroup, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's number in the group's vocabulary, and where each claim's tokens begin."""
    token = pc.index_in(lists.flatten(), own.vocabulary).fill_null(len(own.vocabulary)).to_numpy(zero_copy_only=False).astype(np.int64)
    return token, np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])


def _pairs(group, names: list[str], kind: pa.DataType):
    """Of every claim, for each block, the passages whose score is above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: PassageGroup = group.value
        blocks, ids = list(own.blocks()), pa.array(own.ids, pa.string())
        rows = max(1, CELLS // max(b - a for a, b, *_ in blocks))  # whose scores a core's cache holds
        for batch in batches:
            token, edge = _numbers(own, batch.column(1))
            for lo in range(0, len(batch), rows):
                part = batch.slice(lo, rows)
                ends = edge[lo : lo + len(part) + 1]
                for block in blocks:
                    s = _lexical_scores(own, token[ends[0] : ends[-1]], ends - ends[0], len(part), block)
                    claim, passage = np.nonzero(s)
                    fields = {"pos": pa.array(own.pos[block[0] + passage]), "evidence_id": ids.take(pa.array(block[0] + passage)), "bm25_score": pa.array(s[claim, passage])}
                    values = pa.StructArray.from_arrays([fields[f.name] for f in kind.value_type], fields=list(kind.value_type))
                    edges = np.searchsorted(claim, np.arange(len(part) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(edges), values, type=kind)], names=names)

    return run


def bm25_scores(claims: DataFrame, evidence: DataFrame, key: list[str], text: str = "claim_text") -> DataFrame:
    """``key, pos, evidence_id, bm25_score`` for every claim and passage that share a token (any other pair scores 0).

    One pass over the claims for each group of passages, without a shuffle: a
    claim's scores are taken where it lies, and only pairs above 0 leave, as one
    list a claim and block, so that a claim's key passes through Python once and
    not with each of its passages.
    """
    rows = claims.select(F.struct(*key).alias("row"), X.tokens(F.col(text)).alias("tokens"))
    out, context = None, claims.sparkSession.sparkContext
    pair = T.StructType([T.StructField("pos", T.LongType()), T.StructField("evidence_id", T.StringType()), T.StructField("bm25_score", T.DoubleType())])
    kinds = T.StructType([rows.schema["row"], T.StructField("found", T.ArrayType(pair))])
    pairs = lambda group: _pairs(context.broadcast(group), kinds.names, to_arrow_schema(kinds).field("found").type)
    groups = _groups(evidence, bm25_postings(evidence), None)
    single, others = next(groups, None), next(groups, None) is not None
    if single is None:
        out = claims.sparkSession.createDataFrame([], kinds)
    elif not others:
        out = rows.mapInArrow(pairs(single), kinds)
    else:
        del single, groups
        rows = cut(rows)
        for group in _groups(evidence, bm25_postings(evidence), None):
            part = rows.mapInArrow(pairs(group), kinds)
            out = part if out is None else out.union(part)
    return out.select("row.*", F.inline("found"))


def _add_overlap(own: PassageGroup, sets: list[frozenset[int]], lists: pa.ListArray, token: np.ndarray, edge: np.ndarray, best: dict[str, np.ndarray]) -> None:
    """Jaccard similarity of each claim's different tokens with those of its hits in this group."""
    words = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    place = np.searchsorted(own.pos, best["pos"])
    mine = (best["combined_score"] > -np.inf) & (own.pos[np.minimum(place, len(own.pos) - 1)] == best["pos"])
    for r in np.flatnonzero(mine.any(axis=1)):
        lo, hi = edge[r], edge[r + 1]
        known, count = set(token[lo:hi].tolist()), len(set(words[lo:hi].tolist()))
        for c in np.flatnonzero(mine[r]):
            other = sets[place[r, c]]
            both = len(known & other)
            best["overlap"][r, c] = both / (count + len(other) - both) if count and other else 0.0


def _nearest(both: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, at 12 decimals; of equal ones the first."""
    value = np.round(both, 12)
    if value.shape[1] <= 2 * k or np.isnan(value).any():
        return np.argsort(-value, axis=1, kind="stable")[:, :k]
    least = np.partition(value, -k, axis=1)[:, -k]
    row, place = np.nonzero(value >= least[:, None])  # by row, then place; k of a row, and more that equal its k-th
    order = np.lexsort((place, -value[row, place], row))
    row, place = row[order], place[order]
    first = np.searchsorted(row, np.arange(len(value)))
    return place[first[:, None] + np.arange(k)]


def _score(group, k: int, lexical: float, dense: float, normalise: bool, names: list[str], overlap: bool):
    """The k best hits of claims among all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: PassageGroup = group.value
        blocks, ids = list(own.blocks()), np.array(own.ids, object)
        sets = own.sets() if overlap else []
        rows = max(1, CELLS // max(b - a for a, b, *_ in blocks))  # whose scores a core's cache holds

        def hits_of(batch: pa.RecordBatch, token: np.ndarray, edge: np.ndarray) -> pa.Array:
            n, lists = len(batch), batch.column(1)
            top, kind = np.zeros(n), batch.column(3).type
            lexical_of = lambda block: _lexical_scores(own, token, edge, n, block)
            held = [lexical_of(blocks[0])] if len(blocks) == 1 else None  # one block is scored once
            if normalise:
                for s in held or map(lexical_of, blocks):
                    top = np.maximum(top, s.max(axis=1, initial=0.0))
            best = _no_hits(n, k, kind)
            unit = _unit_rows(batch.column(2), own.vectors.shape[1]) if own.vectors is not None else None
            for block, s in zip(blocks, held or map(lexical_of, blocks)):
                a = block[0]
                emb = _similarities(own, unit, block) if unit is not None else np.zeros_like(s)
                both = _combined(s, emb, top[:, None], lexical, dense, normalise)
                near = _nearest(both, k)
                take = lambda x: np.take_along_axis(x, near, axis=1)  # noqa: B023, E731
                new = {"pos": own.pos[a + near], "evidence_id": ids[a + near], "bm25_score": take(s), "embedding_score": take(emb), "combined_score": take(both)}
                if overlap:
                    new["overlap"] = np.zeros_like(new["combined_score"])
                best = {c: np.concatenate([best[c], new[c]], axis=1) for c in best}
                order = np.argsort(-np.round(best["combined_score"], 12), axis=1, kind="stable")[:, :k]  # earlier columns are earlier passages
                best = {c: np.take_along_axis(x, order, axis=1) for c, x in best.items()}
            if overlap:
                _add_overlap(own, sets, lists, token, edge, best)
            return _pack_hits(best, kind)

        for batch in batches:
            token, edge = _numbers(own, batch.column(1))
            starts = range(0, max(1, len(batch)), rows)
            parts = [hits_of(batch.slice(lo, rows), token[edge[lo] : edge[min(lo + rows, len(batch))]], edge[lo : lo + rows + 1] - edge[lo]) for lo in starts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.concat_arrays(parts)], names=names)

    return run


def _similarities(own: PassageGroup, unit: np.ndarray, block) -> np.ndarray:
    """Cosines of claims with a block's passages, brought to 0 to 1; 0 where either vector is zero."""
    part = own.vectors[block[0] : block[1]]
    emb = np.clip((unit @ part.T + 1) / 2, 0, 1)
    emb[~unit.any(axis=1)] = 0
    emb[:, ~part.any(axis=1)] = 0
    return emb


def _combined(s: np.ndarray, emb: np.ndarray, top: np.ndarray, lexical: float, dense: float, normalise: bool) -> np.ndarray:
    scaled = np.divide(s, top, out=np.zeros_like(s), where=top > 0) if normalise else s
    return lexical * scaled + dense * emb


def _contend(group, k: int, lexical: float, dense: float, heaviest: float, normalise: bool, kinds: pa.Schema, overlap: bool, first: bool):
    """What of a group can be among the k best of claims; the first group's lines carry the claims themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: PassageGroup = group.value
        blocks, ids = list(own.blocks()), np.array(own.ids, object)
        heavy = [block[2].max(axis=1, initial=0.0) for block in blocks]
        sets = own.sets() if overlap else []
        for batch in batches:
            n, lists = len(batch), batch.column(2)
            token, edge = _numbers(own, lists)
            claim = np.repeat(np.arange(n), np.diff(edge))
            unit = _unit_rows(batch.column(3), own.vectors.shape[1]) if own.vectors is not None else None
            most = np.diff(edge) * heaviest if normalise else np.ones(n)
            of_block = {block[0]: h for block, h in zip(blocks, heavy)}
            bound = lambda block: np.bincount(claim, weights=of_block[block[0]][block[3][token]], minlength=n)  # noqa: B023, E731
            lexical_of = lambda block: _lexical_scores(own, token, edge, n, block)  # noqa: B023, E731
            dense_of = (lambda block: _similarities(own, unit, block)) if unit is not None else None  # noqa: B023
            at, passage, s, e, _ = contenders(n, blocks, bound, lexical_of, dense_of, k, (lexical, dense), most)
            fields = {"pos": own.pos[passage], "evidence_id": ids[passage], "bm25_score": s, "embedding_score": e, "combined_score": np.zeros(len(s))}
            if overlap:
                one = {c: x[:, None] for c, x in fields.items()} | {"overlap": np.zeros((len(s), 1))}
                words = lists.take(pa.array(at))
                t, ends = _numbers(own, words)
                _add_overlap(own, sets, words, t, ends, one)
                fields["overlap"] = one["overlap"][:, 0]
            kind = kinds.field("hits").type
            fields["rank"] = np.zeros(len(s), np.int32)
            values = pa.StructArray.from_arrays([pa.array(fields[f.name], f.type) for f in kind.value_type], fields=list(kind.value_type))
            hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32)), values, type=kind)
            row = batch.column(1) if first else pa.nulls(n, kinds.field("row").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), row, hits], schema=kinds)

    return run


def _rank(k: int, lexical: float, dense: float, normalise: bool, names: list[str]):
    """The k best of all groups' contenders; the best lexical score of all passages is among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, n = batch.column(1), len(batch)
            size = hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, claim = hits.flatten(), np.repeat(np.arange(n), size)
            field = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
            top = np.zeros(n)
            np.maximum.at(top, claim, field["bm25_score"])
            field["combined_score"] = _combined(field["bm25_score"], field["embedding_score"], top[claim], lexical, dense, normalise)
            order = np.lexsort((field["pos"], -np.round(field["combined_score"], 12), claim))
            place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
            order, rank = order[place < k], place[place < k] + 1
            field = {c: x[order] for c, x in field.items()} | {"rank": rank.astype(np.int32)}
            kind = hits.type
            values = pa.StructArray.from_arrays([pa.array(field[f.name], f.type) for f in kind.value_type], fields=list(kind.value_type))
            ends = np.concatenate([[0], np.cumsum(np.minimum(size, k))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, type=kind)], names=names)

    return run


def _unit_rows(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of length one; zero or missing ones as zeros."""
    out = np.zeros((len(column), size))
    have = np.flatnonzero(np.asarray(column.is_valid()))
    out[have] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(have), size)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _fields(kind: pa.DataType) -> list[str]:
    """What is carried of a hit; its rank is its place."""
    return [f.name for f in kind.value_type if f.name != "rank"]


def _no_hits(n: int, k: int, kind: pa.DataType) -> dict[str, np.ndarray]:
    """k free places a claim, which score below all."""
    types = {"pos": np.int64, "evidence_id": object}
    return {c: np.full((n, k), -np.inf if c == "combined_score" else 0, types.get(c, np.float64)) for c in _fields(kind)}


def _pack_hits(best: dict[str, np.ndarray], kind: pa.DataType) -> pa.Array:
    used = best["combined_score"] > -np.inf
    count = used.sum(axis=1)
    fields = {c: pa.array(best[c][used], kind.value_type.field(c).type) for c in best}
    fields["rank"] = pa.array((np.cumsum(used, axis=1)[used]).astype(np.int32))
    values = pa.StructArray.from_arrays([fields[kind.value_type.field(i).name] for i in range(kind.value_type.num_fields)], fields=[kind.value_type.field(i) for i in range(kind.value_type.num_fields)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), values, type=kind)


def rank_passages(
    claims: DataFrame, evidence: DataFrame, postings: DataFrame, k: int, claim_vector: Column | None = None, vectors: DataFrame | None = None,
    lexical: float = 0.5, dense: float = 0.5, normalise: bool = True, tokenise=X.tokens, text: str = "claim_text", overlap: bool = False, without: tuple[str, ...] = (),
) -> DataFrame:
    """``claims`` with ``hits``: its k best passages by combined score, then position; arrays of :data:`HIT`.

    ``evidence`` has ``pos, evidence_id``; ``vectors`` has ``pos, vector`` for
    every passage when ``dense`` is above 0.  Scores are ranked at 12 decimals,
    so the order does not hang on the order of sums.  With ``overlap`` a hit has
    the Jaccard similarity of claim and passage too, over the tokens that
    ``tokenise`` and ``postings`` are made of.  Columns ``without``, as the claims'
    vectors, are scored by but not handed on, so they need not pass through Python.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if not all(0 <= w < float("inf") for w in (lexical, dense)) or not lexical + dense:
        raise ValueError("retrieval weights must be finite and not negative, one of them above 0")
    if dense > 0 and vectors is None:
        raise ValueError("dense ranking needs vectors")
    vectors = vectors if dense > 0 else None
    row = F.struct(*(claims[c] for c in claims.columns if c not in without)).alias("row")
    vector = claim_vector if vectors is not None else F.lit(None)
    tokens, vector = tokenise(F.col(text)).alias("tokens"), vector.cast("array<double>").alias("vector")
    hits = T.ArrayType(T.StructType([*HIT.fields, T.StructField("overlap", T.DoubleType())]) if overlap else HIT)
    context, groups = claims.sparkSession.sparkContext, _groups(evidence, postings, vectors)
    single, others = next(groups, None), next(groups, None) is not None
    if not others:
        now = claims.select(row, tokens, vector, F.array().cast(hits).alias("hits"))
        kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in now.schema if f.name in ("row", "hits")])
        if single is not None:
            now = now.mapInArrow(_score(context.broadcast(single), k, lexical, dense, normalise, kinds.names, overlap), kinds)
        return now.select("row.*", "hits")
    del single, groups
    now = cut(claims.select(F.monotonically_increasing_id().alias("claim"), row, tokens, vector))
    kinds = T.StructType([T.StructField("claim", T.LongType()), T.StructField("row", now.schema["row"].dataType), T.StructField("hits", hits)])
    heaviest, all_ = postings.agg(F.max("weight")).first()[0] or 0.0, None
    for number, group in enumerate(_groups(evidence, postings, vectors)):  # the driver holds one at a time
        part = now.mapInArrow(_contend(context.broadcast(group), k, lexical, dense, heaviest, normalise, to_arrow_schema(kinds), overlap, not number), kinds)
        all_ = part if all_ is None else all_.unionByName(part)
    met = all_.groupBy("claim").agg(F.first("row", ignorenulls=True).alias("row"), F.flatten(F.collect_list("hits")).alias("hits"))
    kinds = T.StructType([kinds["row"], kinds["hits"]])
    return met.select("row", "hits").mapInArrow(_rank(k, lexical, dense, normalise, kinds.names), kinds).select("row.*", "hits")


def baseline_ranking(claims: DataFrame, evidence: DataFrame, k: int = 3) -> DataFrame:
    """The plain baseline: hits by the number of shared word occurrences, with their overlap."""
    return rank_passages(claims, evidence, overlap_postings(evidence), k, lexical=1.0, dense=0.0, normalise=False, tokenise=X.plain_tokens, overlap=True)


def retrieved(ranked: DataFrame, key: list[str]) -> DataFrame:
    """One row per hit: ``key`` and the fields of :data:`HIT`."""
    return ranked.select(*key, F.explode("hits").alias("hit")).select(*key, "hit.*")


def ranking_metrics(ranked: DataFrame, gold: DataFrame, key: list[str], ks: tuple[int, ...]) -> DataFrame:
    """Per query: recall and precision at each of ``ks`` and reciprocal rank.

    ``ranked`` has ``key, evidence_id, rank`` (queries without hits do not
    show); ``gold`` has ``key, evidence_ids``.  Recall counts distinct relevant
    ids and is 0 without any; precision divides by k however many hits there are.
    """
    if not ks or len(set(ks)) < len(ks) or any(isinstance(k, bool) or not isinstance(k, int) or k < 1 for k in ks):
        raise ValueError("ks must be different whole numbers of at least 1")
    hits = ranked.join(gold.select(*key, F.array_distinct("evidence_ids").alias("relevant")), key, "left").withColumn("hit", F.coalesce(F.array_contains("relevant", F.col("evidence_id")), F.lit(False)))
    aggregates = [F.coalesce(F.try_divide(F.lit(1.0), F.min(F.when(F.col("hit"), F.col("rank")))), F.lit(0.0)).alias("reciprocal_rank")]
    for k in ks:
        inside = F.col("hit") & (F.col("rank") <= k)
        found = F.count_distinct(F.when(inside, F.col("evidence_id")))
        aggregates.append(F.coalesce(F.try_divide(found, F.first(F.greatest(F.size("relevant"), F.lit(0)))), F.lit(0.0)).alias(f"recall_at_{k}"))
        aggregates.append((F.count_if(inside) / k).alias(f"precision_at_{k}"))
    return hits.groupBy(*key).agg(*aggregates)


def top_k(scored: DataFrame, key: list[str], score: str, k: int) -> DataFrame:
    """The k best of each key by score, then position, with their rank; for scores that are already pairs."""
    order = Window.partitionBy(*key).orderBy(F.desc(F.round(score, 12)), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
