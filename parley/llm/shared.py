"""What the operators of this subpackage share: the folder for intermediate tables and vectorised text helpers.

Texts reach the helpers as one Arrow column; a null text counts as the empty text everywhere in this subpackage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.stage import stored, work_dir  # noqa: F401

#: Bytes of text handled at once inside a task; bounds the memory of the flat arrays. A longer text is handled alone.
SLICE = 2 << 20

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it (whatever its case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def named(df: DataFrame, names: Iterable[str] | None = None) -> list[Column]:
    """Columns of df by their whole names (default: all), whatever dots, backticks or spaces these have."""
    return [F.col(f"`{name.replace('`', '``')}`") for name in (df.columns if names is None else names)]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, … by position: mapInArrow can't take every name. `toDF` gives names back."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text starts (one more entry for the end)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = flat(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(at, at[row] + size, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def text_slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[pa.Array, int, int]]:
    """A column of texts in pieces of about `size` bytes, each with its first row and the row after its last."""
    row = 0
    for batch in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), size=size):
        yield batch.column(0), row, row + batch.num_rows
        row += batch.num_rows


_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64 and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULT, _INV)):
            p = np.full(max(n, SLICE + 4096), base, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _random_table(seed: str) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}{i}".encode()).digest()[:8] for i in range(256)), np.uint64).copy()


_BYTES = _random_table("bytes")


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h ^= h >> _U(27)
    h *= _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


class Spans:
    """Hashes of any byte ranges of one flat array, in constant time for each range."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))


#: White space that parts words: space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a text's border: starts, ends, and the number of runs in each text."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    last = at[1:][at[:-1] < at[1:]] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, at))


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes; an empty group gives 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def list_array(flat_values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the number of values in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), flat_values)
