"""Positions chosen by content, at which equal strings of different texts can be brought together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION_BITS = 20
#: A longer text is taken in overlapping pieces of so many units.
PIECE = (1 << POSITION_BITS) - 4096
_MASK = np.uint64((1 << POSITION_BITS) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def sliding_least(order: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` entries of order, the index of the least one, the first of equals (as far as 44 bits tell)."""
    n = len(order) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (order & ~_MASK) | np.arange(len(order), dtype=np.uint64)
    key = np.concatenate((key, np.full(-len(key) % width, np.iinfo(np.uint64).max))).reshape(-1, width)
    before = np.minimum.accumulate(key, 1).ravel()
    after = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & _MASK).astype(np.int64)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal entries."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(x)])) - 1


def pieces(n: int, window: int):
    """Start and end of overlapping pieces of n units, so that each window of units lies in one of them."""
    at = 0
    while True:
        end = min(n, at + PIECE)
        yield at, end
        if end == n:
            return
        at = end - window + 1


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans (rows of start and end) from any spans; touching ones are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    at = np.flatnonzero(first)
    return np.stack((spans[at, 0], np.maximum.reduceat(spans[:, 1], at)), 1)


def by_document(spans: DataFrame) -> DataFrame:
    """doc, spans: from rows doc, span (start << 32 | end)."""
    return spans.groupBy("doc").agg(F.collect_list("span").alias("spans"))


def unpacked(spans: list[int] | None) -> np.ndarray:
    x = np.array(spans or [], np.int64)
    return np.stack((x >> 32, x & 0xFFFFFFFF), 1) if len(x) else np.zeros((0, 2), np.int64)
