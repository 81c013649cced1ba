"""Plug-ins that stand for models: embedders and pair scorers as Arrow batch functions, generators as a plain interface."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class PairScorer(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def __call__(self, prompt: str) -> Iterator[str]: ...


class HashedWords:
    """A deterministic embedder that needs no model: signed hashes of words, at length 1."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).tolist()


def _in_steps(texts: list[str], embed: Embedder, sizes: tuple[int, ...], tries: int, wait: float) -> tuple[list, list]:
    """Vectors and errors; a batch that keeps failing is cut smaller until single texts fail alone."""
    vectors, errors = [None] * len(texts), [None] * len(texts)

    def attempt(rows: list[int], level: int) -> None:
        for start in range(0, len(rows), sizes[level]):
            part, problem = rows[start : start + sizes[level]], None
            for go in range(tries):
                try:
                    got = embed([texts[i] for i in part])
                    if len(got) != len(part) and len(part) > 1:
                        raise ValueError("fewer vectors than texts")
                    for i, v in zip(part, got or [[]]):
                        vectors[i] = v
                    problem = None
                    break
                except Exception as e:  # a model's client may raise anything; it becomes the row's error
                    problem = str(e)[:500]
                    time.sleep(wait**go if wait else 0)
            if problem and level + 1 < len(sizes):
                attempt(part, level + 1)
            elif problem:
                for i in part:
                    errors[i] = problem

    attempt([i for i, t in enumerate(texts) if t], 0)
    return vectors, errors


def embed(df: DataFrame, text: str, embedder: Embedder, sizes: tuple[int, ...] = (16, 4, 1), tries: int = 3, wait: float = 0.0) -> DataFrame:
    """df with vector (NULL for blank texts and failures) and error."""

    @F.pandas_udf("vector array<double>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vectors, errors = _in_steps([(t or "").strip() for t in texts], embedder, sizes, tries, wait)
            yield pd.DataFrame({"vector": vectors, "error": errors})

    return df.withColumn("_e", run(text)).select(*df.columns, "_e.vector", "_e.error")


def backfill(chunks: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """Chunks without a vector get one; the others stay as they are."""
    missing = F.col("vector").isNull() | (F.size("vector") == 0)
    done = embed(chunks.where(missing).drop("vector"), text, embedder)
    return chunks.where(~missing).withColumn("error", F.lit(None).cast("string")).unionByName(done)


def model_scores(question: Column, text: Column, scorer: PairScorer) -> Column:
    """Scores of pairs, in Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(scorer(list(zip(a, b))), dtype=float)

    return run(question, text)


def chain(prompt: Column, generator: Callable[[str], Iterator[str]]) -> Column:
    """Whole answers of a generator."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(["".join(generator(p)) for p in prompts])

    return run(prompt)
