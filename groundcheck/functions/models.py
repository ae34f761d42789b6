"""Pluggable models: batch interfaces, optional adapters and the UDFs that carry them.

A model is built once per Python worker by a factory, not sent from the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from importlib import import_module
from importlib.util import find_spec
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

CATEGORIES = ("entailment", "contradiction", "neutral")


class Embedder(Protocol):
    def encode(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class NLIModel(Protocol):
    def predict_many(self, pairs: Sequence[tuple[str, str]]) -> Sequence[tuple[float, float, float]]: ...


def checked_vectors(vectors: Sequence[Sequence[float]], texts: int) -> np.ndarray:
    """One finite vector per text, all of one dimension above 0."""
    sizes = {len(v) for v in vectors}
    if len(vectors) != texts or len(sizes) > 1 or 0 in sizes:
        raise ValueError("an embedder returns one vector per text, all of one dimension above 0")
    out = np.array(vectors, np.float64).reshape(texts, -1)
    if not np.isfinite(out).all():
        raise ValueError("vectors must be finite")
    return out


def checked_probabilities(rows: Sequence[Sequence[float]], pairs: int) -> np.ndarray:
    """Three probabilities a pair, in [0, 1], summing to 1."""
    out = np.array(rows, np.float64).reshape(-1, 3) if len(rows) else np.zeros((0, 3))
    if len(out) != pairs:
        raise ValueError("a model returns one distribution per pair")
    if not (np.isfinite(out).all() and (out >= 0).all() and (out <= 1).all() and (abs(out.sum(axis=1) - 1) <= 1e-3).all()):
        raise ValueError("probabilities must be in [0, 1] and sum to 1")
    return out


def embedding_udf(factory: Callable[[], Embedder]):
    """Text to vector; null texts give null."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            have = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if have.any():
                for i, v in zip(texts.index[have], checked_vectors(model.encode(texts[have].tolist()), int(have.sum()))):
                    out.at[i] = v
            yield out

    return embed


def nli_udf(factory: Callable[[], NLIModel]):
    """Premise (passage) and hypothesis (claim) to probabilities."""

    @F.pandas_udf("entailment double, contradiction double, neutral double")
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = factory()
        for premises, claims in batches:
            pairs = list(zip(premises.tolist(), claims.tolist()))
            yield pd.DataFrame(checked_probabilities(model.predict_many(pairs) if pairs else [], len(pairs)), columns=list(CATEGORIES))

    return predict


def category_of(label: str, given: Mapping[str, str] | None = None) -> str | None:
    """The category that a classifier's label stands for: the one given for it, else the only one it names."""
    label = label.strip().casefold()
    for name, category in (given or {}).items():
        if name.strip().casefold() == label:
            return category.strip().casefold()
    named = set(re.findall("not_entailment|" + "|".join(CATEGORIES), label)) & set(CATEGORIES)
    return named.pop() if len(named) == 1 else None


def output_places(labels: Mapping[int | str, str], given: Mapping[str, str] | None = None, fallback: Sequence[str] = ()) -> tuple[int, int, int]:
    """Which outputs of a classifier are entailment, contradiction and neutral, in that order.

    Each category needs one label and one alone.  Where no label stands for any,
    ``fallback`` names the outputs in order.
    """
    found = {int(k): category_of(v, given) for k, v in labels.items()}
    if fallback and not set(found.values()) & set(CATEGORIES):
        found = dict(enumerate(fallback))
    places = [[k for k, c in found.items() if c == category] for category in CATEGORIES]
    if any(len(p) != 1 for p in places):
        raise ValueError(f"the labels {sorted(map(str, labels.values()))} do not name each of {', '.join(CATEGORIES)} once; give a mapping")
    return tuple(p[0] for p in places)


def distributions(logits: np.ndarray, places: Sequence[int]) -> np.ndarray:
    """Softmax over a classifier's outputs, and of it the columns ``places``."""
    logits = np.asarray(logits, np.float64)
    if logits.ndim != 2 or logits.shape[1] <= max(places):
        raise ValueError(f"the classifier's outputs have the shape {logits.shape}, which lacks output {max(places)}")
    share = np.exp(logits - logits.max(axis=1, keepdims=True))
    return (share / share.sum(axis=1, keepdims=True))[:, list(places)]


class SentenceEmbedder:
    """Unit vectors of a sentence-transformers model, where that package is installed."""

    def __init__(self, name: str = "sentence-transformers/all-MiniLM-L6-v2", batch: int = 64) -> None:
        if find_spec("sentence_transformers") is None:
            raise ImportError("dense retrieval by a pretrained model needs the package sentence-transformers")
        self._model, self._batch = import_module("sentence_transformers").SentenceTransformer(name), batch

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        found = np.asarray(self._model.encode(list(texts), batch_size=self._batch), np.float64).reshape(len(texts), -1)
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


# The default classifier and its outputs.
DEFAULT_CLASSIFIER = "facebook/bart-large-mnli"
DEFAULT_OUTPUTS = ("contradiction", "neutral", "entailment")

#: Labels by output, and a function from premises and hypotheses to logits, a row a pair.
Classifier = tuple[Mapping[int | str, str], Callable[[list[str], list[str]], np.ndarray]]


def pretrained_classifier(name: str, device: str | None = None) -> Classifier:
    """A sequence classifier of the transformers package, where that is installed."""
    if any(find_spec(package) is None for package in ("torch", "transformers")):
        raise ImportError("entailment by a pretrained classifier needs the packages torch and transformers")
    import torch
    import transformers

    pipe = transformers.pipeline("text-classification", model=name, device=device)

    def logits(premises: list[str], hypotheses: list[str]) -> np.ndarray:
        with torch.no_grad():
            encoded = pipe.tokenizer(premises, hypotheses, padding=True, truncation=True, return_tensors="pt")
            return pipe.model(**encoded.to(pipe.model.device)).logits.float().cpu().numpy()

    return pipe.model.config.id2label, logits


class ClassifierNLI:
    """Entailment by a three-way classifier; the longest pairs go first, ``batch`` at a time, so that padding is small."""

    def __init__(self, name: str = DEFAULT_CLASSIFIER, given: Mapping[str, str] | None = None, batch: int = 32, load: Callable[[str], Classifier] = pretrained_classifier) -> None:
        if batch < 1:
            raise ValueError("batch must be at least 1")
        labels, self._logits = load(name)
        self._places = output_places(labels, given, DEFAULT_OUTPUTS if name == DEFAULT_CLASSIFIER else ())
        self._batch = batch

    def predict_many(self, pairs: Sequence[tuple[str, str]]) -> np.ndarray:
        out = np.zeros((len(pairs), len(CATEGORIES)))
        order = sorted(range(len(pairs)), key=lambda k: -sum(map(len, pairs[k])))
        for lo in range(0, len(order), self._batch):
            part = order[lo : lo + self._batch]
            logits = self._logits(*(list(side) for side in zip(*(pairs[k] for k in part))))
            if len(logits) != len(part):
                raise ValueError("a classifier returns one row of logits a pair")
            out[part] = distributions(logits, self._places)
        return out
