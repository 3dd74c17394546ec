"""Pluggable scorers and sequence decoding at the model boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import ship

#: A scorer takes a batch of token id arrays and gives a score per token and label.
Scorer = Callable[[list[np.ndarray]], list[np.ndarray]]


def stub_scorer(labels: int) -> Scorer:
    """A deterministic scorer for tests: integer arithmetic on ids and positions."""

    def score(batch: list[np.ndarray]) -> list[np.ndarray]:
        return [((np.add.outer(ids * 7, np.arange(labels) * 13) + np.arange(len(ids))[:, None] * 3) % 17).astype(float) for ids in batch]

    return score


def score_tokens(df: DataFrame, ids: str, make: Callable[[], Scorer], keep: str = "doc_id") -> DataFrame:
    """``(keep, logits)``: the scorer is made once per worker and fed Arrow batches."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for b in batches:
            scored = scorer([np.asarray(x, dtype=np.int64) for x in b[ids]])
            yield pd.DataFrame({keep: b[keep], "logits": [s.tolist() for s in scored]})

    ship(df.sparkSession)
    return df.select(keep, ids).mapInPandas(scan, f"{keep} bigint, logits array<array<double>>")


def best_labels(logits):
    """Label id of every token: the largest score, the first of equals."""
    return F.transform(logits, lambda row: (F.array_position(row, F.array_max(row)) - 1).cast("int"))


def _decoded(e: np.ndarray, transitions: np.ndarray, start: int | None, end: int | None) -> list[int]:
    v = e[0] + (transitions[start] if start is not None else 0)
    back = []
    for row in e[1:]:
        m = v[:, None] + transitions
        back.append(m.argmax(axis=0))
        v = m.max(axis=0) + row
    if end is not None:
        v = v + transitions[:, end]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def viterbi(transitions: np.ndarray, start: int | None = None, end: int | None = None):
    """A column function: best label path of an array of emission rows.

    Maximum sums with back-pointers; ``start`` and ``end`` are label ids whose
    transitions frame the sequence, if given. Ties go to the smaller label."""

    def one(rows) -> list[int]:
        if rows is None or not len(rows):
            return []
        return _decoded(np.array([np.asarray(r, dtype=float) for r in rows]), transitions, start, end)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def decode(emissions: pd.Series) -> pd.Series:
        return emissions.map(one)

    return decode


def masked_viterbi(transitions: np.ndarray, skip: int = 1):
    """A column function ``(emissions, length)``: best path of the rows from ``skip`` (the mark
    of beginning stands before them) up to ``length``; padding behind is not decoded.
    The path begins by emission alone and needs no end label."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def decode(emissions: pd.Series, length: pd.Series) -> pd.Series:
        def one(rows, n):
            if rows is None or n is None or pd.isna(n) or int(n) <= skip or len(rows) <= skip:
                return []
            return _decoded(np.array([np.asarray(r, dtype=float) for r in rows[skip : int(n)]]), transitions, None, None)

        return pd.Series([one(r, n) for r, n in zip(emissions, length)], dtype=object)

    return decode


def _log_likelihood(e: np.ndarray, y: np.ndarray, transitions: np.ndarray) -> float:
    """Negative log-likelihood of the labels under emissions and transitions."""
    a = e[0]
    for row in e[1:]:
        m = a[:, None] + transitions
        top = m.max(axis=0)
        a = top + np.log(np.exp(m - top).sum(axis=0)) + row
    whole = a.max() + np.log(np.exp(a - a.max()).sum())
    return float(whole - e[np.arange(len(y)), y].sum() - transitions[y[:-1], y[1:]].sum())


def sequence_loss(transitions: np.ndarray):
    """A column function ``(emissions, labels)``: negative log-likelihood of a label
    sequence under emission and transition scores; zero over an empty one."""

    def one(rows, labels) -> float:
        if rows is None or labels is None or not len(rows):
            return 0.0
        e = np.array([np.asarray(r, dtype=float) for r in rows])
        return _log_likelihood(e, np.asarray(labels, dtype=int)[: len(e)], transitions)

    @F.pandas_udf(T.DoubleType())
    def loss(emissions: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([one(r, y) for r, y in zip(emissions, labels)], dtype=float)

    return loss


def masked_loss(transitions: np.ndarray, skip: int = 1, pad: int = -100):
    """A column function ``(emissions, labels, length)``: as :func:`sequence_loss` over the rows
    from ``skip`` up to ``length``; a ``pad`` label there counts as label 0."""

    @F.pandas_udf(T.DoubleType())
    def loss(emissions: pd.Series, labels: pd.Series, length: pd.Series) -> pd.Series:
        def one(rows, y, n) -> float:
            if rows is None or y is None or n is None or pd.isna(n) or int(n) <= skip or len(rows) <= skip:
                return 0.0
            e = np.array([np.asarray(r, dtype=float) for r in rows[skip : int(n)]])
            y = np.asarray(y[skip : int(n)], dtype=int)[: len(e)]
            return _log_likelihood(e, np.where(y == pad, 0, y), transitions)

        return pd.Series([one(*z) for z in zip(emissions, labels, length)], dtype=float)

    return loss
