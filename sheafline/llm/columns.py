"""Text columns as numpy arrays: slices of Arrow batches, words, lines and their hashes.

All positions are byte positions in the slice's UTF-8 data. The six bytes
0x20 and 0x09-0x0D never occur inside a multi-byte character, so words and
lines can be cut on bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte: rolling sums of these have no structure of the text's.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later slices."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), U64)
        have[0] = 1
        have[1:] = U64(base)
        np.multiply.accumulate(have, out=have)
        if len(have) > 1 << 19:
            return have[:n]  # too long to keep
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Texts:
    """The texts of some rows: bytes, offsets, and per-row sums over them."""

    def __init__(self, column: pa.Array):
        self.n = len(column)
        if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            kind = np.int64
        else:
            kind = np.int32
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], kind, self.n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if self.n else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.null = np.asarray(column.is_null()) if column.null_count else np.zeros(self.n, bool)
        self.data = data[offsets[0] : offsets[-1]]
        self.start = offsets[:-1] - offsets[0]
        self.end = offsets[1:] - offsets[0]
        self._sums: np.ndarray | None = None

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each row the mask holds."""
        total = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[self.end] - total[self.start]).astype(np.int64)

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        """Prefix sums of byte value times BASE**position."""
        data = self.data if data is None else data
        out = np.zeros(len(data) + 1, U64)
        np.multiply(BYTE_VALUE[data], powers(BASE, len(data)), out=out[1:])
        np.add.accumulate(out, out=out)
        return out

    def words(self, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each maximal run of the bytes that ``solid`` holds, those that are no space otherwise."""
        solid = ~IS_SPACE[self.data] if solid is None else solid
        padded = np.zeros(len(solid) + 2, bool)
        padded[1:-1] = solid
        begins, ends = padded[1:-1] & ~padded[:-2], solid & ~padded[2:]
        inner = self.start[(self.start > 0) & (self.start < len(solid))]
        begins[inner] |= solid[inner]
        ends[inner - 1] |= solid[inner - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return s, e, np.searchsorted(self.end, s, side="right")

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each \\n-separated line; an empty text has one empty line."""
        cuts = np.flatnonzero(self.data == 10)
        row = np.searchsorted(self.end, cuts, side="right")
        s = np.concatenate([self.start, cuts + 1])
        e_row = np.concatenate([np.arange(self.n), row])
        order = np.lexsort((s, e_row))
        s, e_row = s[order], e_row[order]
        e = np.empty_like(s)
        e[:-1] = s[1:] - 1
        last = np.ones(len(s), bool)
        last[:-1] = e_row[1:] != e_row[:-1]
        e[last] = self.end[e_row[last]]
        return s, e, e_row


def span_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A position-free hash of each byte span, its length mixed in."""
    raw = prefix[e] - prefix[s]
    n = int(s.max()) + 1 if len(s) else 0
    raw = raw * powers(BASE_INVERSE, n)[s]
    return mix(raw + mix((e - s).astype(U64)))


def windows(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of each run of n values of one row, and the index of its first value."""
    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(count, U64)
    for k in range(n):
        total = total * U64(BASE) + values[k : k + count]
    at = np.flatnonzero(row[: count] == row[n - 1 :])
    return mix(total[at] + U64(n)), at


def repeated(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does its (row, key) occur twice or more; is it not the first such."""
    n = len(keys)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    joint = keys ^ mix(row.astype(U64) + U64(0x51ED27))
    order = np.argsort(joint, kind="stable")
    joint = joint[order]
    same = np.zeros(n + 1, bool)
    same[1:-1] = joint[1:] == joint[:-1]
    many, later = np.empty(n, bool), np.empty(n, bool)
    many[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return many, later


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in one of the runs of n that begin at ``at``."""
    step = np.zeros(total + 1, np.int32)
    step[at] += 1  # the places in at are distinct
    step[at + n] -= 1
    return np.cumsum(step)[:total] > 0


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = Texts(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            upto = max(at + 1, int(np.searchsorted(texts.end, texts.start[at] + most, side="right")))
            upto = min(upto, n)
            yield batch.slice(at, upto - at)
            at = upto


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: What a worker keeps between tasks, by operator: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object, operator: str = "") -> DataFrame:
    """mapInArrow in which a task first drops what other operators have kept in its worker."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, drop in KEPT.items():
            if name != operator:
                drop()
        give_back()
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)
