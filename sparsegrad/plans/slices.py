"""Sums of long vectors, added up slice by slice.

A task that has a sum for most of D features would send a row for each. It
sends slices instead: one record for ``SLICE`` neighbouring ids, as packed
doubles (with their places where fewer than two thirds are not zero). Slices are
added in two levels: first in about sqrt(tasks) groups of tasks, then
across the groups. So T tasks send T D / SLICE records, no reducer reads more
than a few hundred kilobytes of a slice from each level at a time, and a
reducer holds one dense copy of the slices it owns, whatever T is."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Feature ids of a slice (8 kB), and slices of a vector from which it is sliced.
SLICE = 1024
SLICED_FROM = 16
#: Tasks from which slices are added in two levels.
TWO_LEVELS_FROM = 16

PACKED = "slice long, part int, at binary, g binary"
_NAMES = ["slice", "part", "at", "g"]


def groups_of(tasks: int) -> int:
    """Groups of tasks that the first level adds up; 1 for a single level."""
    return math.isqrt(tasks) if tasks >= TWO_LEVELS_FROM else 1


def _records(slices: Iterator[tuple[int, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
    held = []
    for number, values in slices:
        hit = np.flatnonzero(values)
        if 3 * len(hit) < 2 * len(values):
            held.append((number, hit.astype(np.int32).tobytes(), values[hit].tobytes()))
        else:
            held.append((number, b"", values.tobytes()))
        if len(held) == 512:
            yield _batch(held, part)
            held = []
    if held:
        yield _batch(held, part)


def _batch(held: list, part: int) -> pa.RecordBatch:
    number, at, g = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(number, pa.int64()), pa.array([part] * len(held), pa.int32()), pa.array(at, pa.binary()), pa.array(g, pa.binary())],
        names=_NAMES)


def packed(total: np.ndarray, width: int, groups: int) -> Iterator[pa.RecordBatch]:
    """The slices of a task's sum that are not zero; slice 0 always (it holds
    the bias part)."""
    part = TaskContext.get().partitionId() % groups
    cut = (total[i:i + width] for i in range(0, len(total), width))
    return _records(((k, s) for k, s in enumerate(cut) if k == 0 or s.any()), part)


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> dict[int, np.ndarray]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, at, g in zip(batch.column("slice").to_pylist(), batch.column("at"), batch.column("g")):
            total = sums.get(number)
            if total is None:
                total = sums[number] = np.zeros(width)
            values, places = np.frombuffer(g.as_buffer()), np.frombuffer(at.as_buffer(), np.int32)
            if len(places) or not len(values):
                total[places] += values
            else:
                total[:len(values)] += values
    return sums


def added(parts: DataFrame, width: int, groups: int) -> DataFrame:
    """(idx, g) of packed slices: ids whose sum is not zero, and idx 0 if any
    task sent a sum."""
    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _records(iter(sorted(_sums(batches, width).items())), 0)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, values in sorted(_sums(batches, width).items()):
            hit = np.flatnonzero(values)
            if number == 0 and (not len(hit) or hit[0]):
                hit = np.concatenate([[0], hit])
            yield pa.RecordBatch.from_arrays([pa.array(hit + number * width, pa.int64()), pa.array(values[hit])], names=["idx", "g"])

    if groups > 1:
        parts = parts.repartition("slice", "part").mapInArrow(level, PACKED)
    return parts.repartition("slice").mapInArrow(last, "idx long, g double")
