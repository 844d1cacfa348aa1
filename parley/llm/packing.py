"""Best-fit packing of token sequences, planned on counts of lengths instead of documents.

Each task cuts its documents into pieces and numbers those of one length. The counts of each length (as many as a sequence
has tokens) go to the driver, where best-fit decreasing runs over counts and gives runs of slots for each length. A piece
takes the slot of its rank within its length: its number within the task plus the counts of the tasks before it, so that no
length, however common, meets in one task.

Null text: as the empty text, a piece with the end token alone. Repeated rows: each is packed. An empty table gives no row.
Ties (equal lengths): by task, then by place in it. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs of slots as rows (length, first rank, slots, first sequence, offset), by length and rank.

    Slot number i of a run belongs to sequence first + i. Lengths go from the longest down; a piece goes where the least
    room is left that holds it. Sequences with equal room are kept as ranges, so the work grows with the number of lengths.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    out, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit a sequence of {capacity}")
        levels = sorted(r for r, ranges in room.items() if r >= length and ranges)
        while left:
            level = levels.pop(0) if levels else capacity
            ranges, each = room.pop(level, []), level // length
            if not ranges:  # open as many as the rest needs
                n = -(-left // each)
                ranges, sequences = [(sequences, n)], sequences + n
            while ranges and left:
                first, n = ranges.pop()
                full = min(n, left // each)
                parts = [(first, full, each)] if full else []
                if full < n and left - full * each:
                    parts.append((first + full, 1, left - full * each))
                used = 0
                for start, size, layers in parts:
                    for k in range(layers):
                        out.append((length, rank, size, start, capacity - level + k * length))
                        rank, left = rank + size, left - size
                    room.setdefault(level - layers * length, []).append((start, size))
                    used += size
                if used < n:
                    ranges.append((first + used, n - used))
            if ranges:
                room.setdefault(level, []).extend(ranges)
    plan = np.array(out, np.int64).reshape(-1, 5)
    return plan[np.lexsort((plan[:, 1], plan[:, 0]))]


def cut(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and task and number within the task and length.

    added: tokens that have an id of their own wherever their string stands in a text (`bytepairs.added_tokens`).
    """
    from parley.llm.bytepairs import text_ids
    from parley.llm.shared import slices

    own = tuple((added or {}).items())

    def run(batches):
        mine, task = text_ids(ranks_path, pattern, own), TaskContext.get().partitionId()
        taken = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            ids, border = mine([t or "" for t in batch.column("text").to_pylist()])
            n = len(border) - 1
            # each text's ids and the end token, as unsigned 32-bit numbers
            ids = np.insert(ids.astype("<u4"), border[1:], end_id)
            total = np.diff(border) + 1
            first = np.cumsum(total) - total
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(n), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = total - (pieces - 1) * capacity  # the first piece
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[row], capacity)
            raw = memoryview(ids.tobytes())
            at = first[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sizes, begin, count = np.unique(length[order], return_index=True, return_counts=True)
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(length)) - np.repeat(begin, count) + taken[length[order]]
            taken[sizes] += count
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(number, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that stay as they are when read again (see `shared.stored`)."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length
    plan = pieces.sparkSession.sparkContext.broadcast(plan_best_fit(total, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("task", "length", before.alias("before")), ["task", "length"]).withColumn("rank", F.col("before") + F.col("number"))

    def run(batches):
        length, rank, _, first, offset = plan.value.T
        key = length * (1 << 50) + rank
        for batch in batches:
            mine = batch.column("length").to_numpy() * (1 << 50) + batch.column("rank").to_numpy()
            at = np.searchsorted(key, mine, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[at] + mine - key[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, added: dict[str, int] | None = None) -> DataFrame:
    """Cuts and places all documents."""
    from parley.llm.shared import stored

    return place(stored(cut(docs, ranks_path, pattern, capacity=capacity, added=added), "pieces"), capacity)
