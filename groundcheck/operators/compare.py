"""Paired comparison of models on the items they share."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundcheck.operators.ranks import numbered
from groundcheck.session import cut

PLACES = 1 << 20  # items of a pair in one list
DRAWS = 1 << 24  # words that a task of bootstrap_hash holds, or those of one repetition


def item_outcomes(facts: DataFrame, responses: DataFrame) -> DataFrame:
    """Per model and item: supported rate (null without claims) and whether a claim is contradicted."""
    key = ["model_name", "dataset_item_id"]
    claims = facts.groupBy(*key).agg(F.avg((F.col("label") == "supported").cast("double")).alias("rate"), F.bool_or(F.col("label") == "contradicted").alias("error"))
    return responses.select(*key).join(claims, key, "left").fillna(False, ["error"])


def paired_outcomes(outcomes: DataFrame) -> DataFrame:
    """Both models' outcomes on every item, for each pair of models in order of name.

    An item's outcomes, one a model, are gathered and paired in place: no self-join.
    """
    line = outcomes.groupBy("dataset_item_id").agg(F.array_sort(F.collect_list(F.struct("model_name", "rate", "error"))).alias("line"))
    pairs = F.flatten(F.transform("line", lambda a, i: F.transform(F.slice("line", i + 2, F.size("line")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = line.select("dataset_item_id", F.explode(pairs).alias("p"))
    return rows.select(F.col("p.a.model_name").alias("model_a"), F.col("p.b.model_name").alias("model_b"), "dataset_item_id", *(F.col(f"p.{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("rate", "error")))


def paired_comparison(pairs: DataFrame) -> DataFrame:
    """Per pair: paired items, mean difference of supported rates and discordant error counts."""
    return pairs.groupBy("model_a", "model_b").agg(
        F.count_if(F.col("rate_a").isNotNull() & F.col("rate_b").isNotNull()).alias("paired_item_count"),
        F.avg(F.col("rate_a") - F.col("rate_b")).alias("mean_difference"),
        F.count_if(F.col("error_a") & ~F.col("error_b")).alias("model_a_error_only_items"),
        F.count_if(F.col("error_b") & ~F.col("error_a")).alias("model_b_error_only_items"),
    )


def _hashed_means(repetitions: int, blocks: int, seed: int):
    """Sums of drawn differences of each line (a pair's block of places), for the repetitions of the line's share."""

    def words(rep: int, n: int) -> np.ndarray:
        drawn = b"".join(hashlib.md5(f"{seed}|{rep}|{k}".encode(), usedforsecurity=False).digest()[:4] for k in range(n))
        return np.frombuffer(drawn, ">u4").astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held, size = None, {}, 0
        for batch in batches:
            for i in range(len(batch)):
                own, n, first = (batch.column(c)[i].as_py() for c in ("share", "n", "first"))
                if own != share or n > size:  # lines come by share, those of most items first
                    share, size = own, n
                    held = {rep: words(rep, n) for rep in range(own, repetitions, blocks)}
                d = batch.column("d")[i].values.to_numpy(zero_copy_only=False)
                sums = []
                for drawn in held.values():
                    place = drawn[:n] % n
                    if len(d) < n:
                        place = place[(place >= first) & (place < first + len(d))] - first
                    sums.append(d[place].sum())
                columns = [pa.array([batch.column(c)[i].as_py()] * len(sums), t) for c, t in (("model_a", pa.string()), ("model_b", pa.string()), ("n", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held), pa.int64()), pa.array(sums, pa.float64())], names=["model_a", "model_b", "n", "rep", "s"])

    return run


def bootstrap_hash(pairs: DataFrame, repetitions: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile bounds of the resampled mean difference, with draws taken from md5 of seed, repetition and place.

    Items are numbered in order within a pair, and a pair's differences lie in
    blocks of at most ``PLACES``.  Repetitions are shared out: a share's task makes
    its draws once for all pairs, as they depend on a pair by its number of items
    alone, and lets every block pass by.  A row leaves for each block and repetition.
    """
    check_bootstrap(repetitions, level)
    key = ["model_a", "model_b"]
    rows = pairs.where(F.col("rate_a").isNotNull() & F.col("rate_b").isNotNull()).select(*key, "dataset_item_id", (F.col("rate_a") - F.col("rate_b")).alias("d"))
    rows = numbered(rows, ["dataset_item_id"], key, "place")  # kept
    summary = cut(rows.groupBy(*key).agg(F.avg("d").alias("mean_difference"), F.count("*").alias("sample_size")))
    most = summary.agg(F.max("sample_size")).first()[0] or 0
    blocks = min(repetitions, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-repetitions * most // DRAWS)))
    lists = rows.groupBy(*key, F.floor(F.col("place") / PLACES).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "d"))).alias("line"))
    sized = lists.join(F.broadcast(summary.select(*key, F.col("sample_size").alias("n"))), key)  # a line for each pair
    shared = sized.select(*key, "n", F.col("line")[0]["place"].cast("long").alias("first"), F.col("line.d").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("share"))
    shared = shared.repartition(blocks, "share").sortWithinPartitions("share", F.desc("n"))
    sums = shared.mapInArrow(_hashed_means(repetitions, blocks, seed), "model_a string, model_b string, n long, rep long, s double").groupBy(*key, "n", "rep").agg(F.sum("s").alias("s"))
    means = sums.select(*key, (F.col("s") / F.col("n")).alias("m"))
    tail = (1 - level) / 2
    bounds = means.groupBy(*key).agg(F.percentile("m", tail).alias("lower"), F.percentile("m", 1 - tail).alias("upper"), F.count("*").alias("repetitions"))
    return summary.join(bounds, key)


def check_bootstrap(repetitions: int, level: float) -> None:
    if repetitions < 1:
        raise ValueError("repetitions must be at least 1")
    if not 0 < level < 1:
        raise ValueError("level must be between 0 and 1")


def _drawn_means(d: list[float], repetitions: int, seed: int) -> list[float]:
    """Mean of each repetition's ``random.Random(seed).choice``, one after another, and of Python's sum of floats.

    The generator's 32-bit words are taken in bulk: a choice is a word's upper bits,
    passed over while they are not below the length.  Python's sum carries the
    exact error of every addition; here the errors of all additions are taken at once.
    """
    n, (_, state, _) = len(d), random.Random(seed).getstate()
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    bits, values, left, out = n.bit_length(), np.array(d), np.zeros(0, np.int64), []
    if bits > 32:
        raise ValueError("a choice among this many takes more than a word")
    while len(out) < repetitions:
        while len(left) < n:
            drawn = words.random_raw(max(1 << 16, 2 * n)) >> (32 - bits)
            left = np.concatenate([left, drawn[drawn < n].astype(np.int64)])
        for lo in range(0, len(left) - n + 1, n):
            x = values[left[lo : lo + n]]
            total = np.add.accumulate(x)  # in order
            before, after = total[:-1], total[1:]
            added = after - before
            lost = (before - (after - added)) + (x[1:] - added)
            out.append(float(total[-1] + (np.add.accumulate(lost)[-1] if n > 1 else 0.0)) / n)
        left = left[len(left) - len(left) % n :]
    return out[:repetitions]


def bootstrap_exact(pairs: DataFrame, repetitions: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile bounds with the draws of Python's seeded generator, in item order.

    The differences of one pair (8 bytes an item) meet in one task, as the
    sequence of draws demands; pairs are dealt out by number, not by their bytes,
    which are few and would bring all into a task or two.
    """
    import pandas as pd

    check_bootstrap(repetitions, level)
    rows = pairs.where(F.col("rate_a").isNotNull() & F.col("rate_b").isNotNull()).select("model_a", "model_b", "dataset_item_id", (F.col("rate_a") - F.col("rate_b")).alias("d"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        d = part.sort_values("dataset_item_id")["d"].tolist()
        means = sorted(_drawn_means(d, repetitions, seed))
        lower, upper = (percentile(means, q) for q in ((1 - level) / 2, 1 - (1 - level) / 2))
        return pd.DataFrame([(part["model_a"].iloc[0], part["model_b"].iloc[0], sum(d) / len(d), lower, upper, len(d), repetitions, level)], columns=["model_a", "model_b", "mean_difference", "lower", "upper", "sample_size", "repetitions", "confidence_level"])

    dealt = rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, "model_a", "model_b")
    return dealt.groupBy("model_a", "model_b").applyInPandas(solve, "model_a string, model_b string, mean_difference double, lower double, upper double, sample_size long, repetitions long, confidence_level double")


def percentile(ordered: list[float], q: float) -> float:
    """Linear interpolation between the closest ranks."""
    place = q * (len(ordered) - 1)
    low = int(place)
    high = min(low + (place > low), len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (place - low)

