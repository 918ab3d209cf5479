"""Bounded-space online best-fit packing of token sequences.

A fixed number of bins is open at a time.  Their free spaces are the bits of one
integer, so the tightest bin that takes a piece is the lowest set bit at or above the
piece's length; when no bin takes it and all are open, the fullest closes first.
State is bounded by the number of open bins, whatever the input.  Tasks pack what they
read; bins that are still open at their end are packed into one another afterwards, as
pieces of their own, so many small partitions do not cost a set of open bins each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import Tables, bounded_batches
from .tokens import CHUNK, encoder


class BestFit:
    """place(length) -> (bin number, offset); bins are numbered from 0 in order of opening."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.spaces = 0  # bit s: some open bin has s free
        self.bins: dict[int, list[int]] = {}
        self.n_open = self.next = 0

    def _take(self, space: int) -> int:
        found = self.bins[space]
        number = found.pop()
        if not found:
            del self.bins[space]
            self.spaces &= ~(1 << space)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"length {length} is outside 1..{self.capacity}")
        fitting = self.spaces >> length
        if fitting:
            space = (fitting & -fitting).bit_length() - 1 + length
            number = self._take(space)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, number = self.capacity, self.next
            self.next += 1
        if left := space - length:
            self.bins.setdefault(left, []).append(number)
            self.spaces |= 1 << left
            self.n_open += 1
        return number, self.capacity - space


    def left_open(self) -> list[tuple[int, int]]:
        """(bin number, what it holds) of the bins that are open."""
        return [(number, self.capacity - space) for space, numbers in self.bins.items() for number in numbers]


SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Tasks whose open bins are packed together.
TASKS = 64


def _repack(capacity: int, open_bins: int):
    """The open bins (sequence_id, length) of a group of tasks: where each goes, the fullest first."""

    def run(table: pa.Table) -> pa.Table:
        bins = sorted(zip(table.column("length").to_pylist(), table.column("sequence_id").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
        fit, into, moved = BestFit(capacity, open_bins), [], []
        for length, sequence in bins:
            number, offset = fit.place(length)
            if number == len(into):
                into.append(sequence)
            moved.append((sequence, into[number], offset))
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("sequence_id", "into", "shift"), zip(*moved, strict=True), strict=True)})

    return run


def pack(
    docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = 2048, open_bins: int = 256, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id_col, SCHEMA and, if asked for, ids binary (little-endian uint32).

    A document is its ids and end_id; only one longer than capacity is cut.  Null or empty text is the end id alone.
    Repeated rows are packed each, null ids stay null; other columns are not carried; no rows give none.  Documents
    keep to the partition that read them; of each TASKS partitions the bins left open, open_bins at most, meet in one
    task, which puts them into one another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, fit, lane = encoder(tokenizer, kind), BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36
        kinds, names = (pa.int32(), *[pa.int64()] * 5), ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        id_type = None
        for batch in batches:
            id_type = batch.column("_id").type
            for i, j, buf, offsets in X.text_chunks(batch.column("_text"), CHUNK):
                ids, bounds = enc.encode(buf, offsets)
                owner, rows, blobs = [], [], []
                for r in range(j - i):
                    doc = np.append(ids[bounds[r] : bounds[r + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(doc), capacity)):
                        piece = doc[at : at + capacity].tobytes()
                        number, offset = fit.place(len(piece) >> 2)
                        owner.append(i + r)
                        rows.append((k, at, len(piece) >> 2, zlib.crc32(piece), lane + number, offset))
                        blobs.append(piece)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                arrays = [batch.column("_id").take(pa.array(owner, pa.int64())), *columns]
                if with_ids:
                    arrays.append(pa.array(blobs, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
        if open_ := fit.left_open():
            n = len(open_)
            columns = [pa.nulls(n, id_type), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([x for _, x in open_], pa.int64()), pa.nulls(n, pa.int64()), pa.array([lane + b for b, _ in open_], pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.nulls(n, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    spark = bounded_batches(docs)
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    packed = Tables(spark).save(rows.mapInArrow(run, f"_id {kind_of_id}, {SCHEMA}" + ", ids binary" * with_ids))
    group = F.shiftright("sequence_id", 36) / TASKS
    bins = packed.where("piece is null").select("sequence_id", "length", F.floor(group).alias("group"))
    moved = bins.groupBy("group").applyInArrow(_repack(capacity, open_bins), "sequence_id long, into long, shift long")
    placed = packed.where("piece is not null").join(moved, "sequence_id", "left")
    out = placed.withColumns({"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))})
    return out.select(F.col("_id").alias(id_col), *[c.split()[0] for c in SCHEMA.split(", ")], *["ids"] * with_ids)
