"""Likeness (Jaccard) of texts' sets of word shingles: the exact check behind candidates found otherwise.

Sets are of 64-bit hashes of shingles and made only for texts that are asked for. Edge cases: null and empty texts
have empty sets, which are like nothing here (equal sets are one node and never compared).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import meet
from ._common import slices
from .shingles import shingle_hashes


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``node, payload`` of ``texts`` (node, text): the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(text or "", words)).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "payload"])

    return texts.select("node", "text").mapInArrow(run, "node long, payload array<long>")


def alike(p: Column, q: Column, likeness: float) -> Column:
    both = F.size(F.array_intersect(p, q))
    possible = F.least(F.size(p), F.size(q)) / F.greatest(F.size(p), F.size(q)) >= likeness
    return possible & (both / (F.size(p) + F.size(q) - both) >= likeness)


def kernel(likeness: float) -> meet.Kernel:
    """The same about the sets of a block, for ``meet.rest``."""

    def of(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
        sizes = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], sizes.cumsum()])
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        each = np.split(ids, starts[1:-1])

        def near_to(x: int, others: np.ndarray) -> np.ndarray:
            mine = np.zeros(len(known), bool)
            mine[each[x]] = True
            both = np.array([np.count_nonzero(mine[each[y]]) for y in others])
            return both / np.maximum(sizes[others] + sizes[x] - both, 1) >= likeness

        return near_to

    return of
