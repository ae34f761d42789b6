"""Claim extractors of a user's own, as table functions joined laterally to the responses."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

#: Of a text, its claims in order: the words and half-open code-point offsets.
Extractor = Callable[[str], Iterable[tuple[str, int, int]]]


def check_claim(text: str, claim: tuple[str, int, int], before: int) -> tuple[str, int, int]:
    """The claim, if it is what stands at its offsets, is not blank and starts where the one before ended or later."""
    words, start, end = claim
    if not 0 <= start < end <= len(text) or text[start:end] != words:
        raise ValueError(f"a claim is not the text at its offsets {start} to {end}")
    if not words.strip():
        raise ValueError(f"the claim at {start} is blank")
    if start < before:
        raise ValueError(f"the claim at {start} overlaps the one before or is out of order")
    return words, start, end


def claims_by(factory: Callable[[], Extractor]) -> Callable[[DataFrame], DataFrame]:
    """A function from responses to claims, as :func:`groundcheck.plans.fixtures.extract`, by an extractor built once a task.

    One response is held at a time; a null text has no claims.  Every claim is
    checked where it is made (:func:`check_claim`); a wrong one fails the job.
    """

    @F.udtf(returnType="ordinal int, claim_id string, claim_text string, claim_start int, claim_end int")
    class Claims:
        def __init__(self) -> None:
            self.extract = factory()

        def eval(self, text: str | None):
            before = 0
            for k, claim in enumerate(self.extract(text) if text is not None else (), 1):
                words, start, before = check_claim(text, claim, before)
                yield k, f"claim-{k}", words, start, before

    def run(rows: DataFrame) -> DataFrame:
        made = ["ordinal", "claim_id", "claim_text", "claim_start", "claim_end"]
        keep = [c for c in rows.columns if c not in ("text", *made)]
        return rows.select(*keep, "text").lateralJoin(Claims(F.col("text").outer())).select(*keep, *made)

    return run


class Lines:
    """Every line that is not blank is a claim, without the spaces at its ends."""

    def __call__(self, text: str) -> Iterable[tuple[str, int, int]]:
        at = 0
        for line in text.split("\n"):
            if words := line.strip(" "):
                start = at + line.index(words)
                yield words, start, start + len(words)
            at += len(line) + 1
