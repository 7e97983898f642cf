"""Shared parts of the training-data operators: word hashes over Arrow text, scratch tables.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text; only A-Z are lower-cased. Both are plain
byte operations, so a batch of texts is handled as one byte array with numpy.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quietwire.scratch import pin

SLICE_BYTES = 1 << 20
"""Texts of a batch are handled in slices of about so many bytes (a longer text is a slice)."""

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _mix_table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = _mix_table()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = -(-n // (1 << 18)) * (1 << 18)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words:
    """The words of some texts, in order.

    ``start``/``end``: byte positions in ``data``; ``doc``: index of a word's text; ``first``:
    index of each text's first word, and the word count at the end; ``hash``: 64-bit word hashes.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = True):
        self.bounds = bounds
        self.data = _LOWER[data] if lower else data
        inside = ~_SEPARATOR[data]
        # A word also ends where a text ends.
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            at = bounds[:-1][bounds[:-1] < len(data)]
            before[at] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), dtype=bool)
        if len(data):
            after[:-1] = inside[1:]
            at = bounds[1:][bounds[1:] > 0] - 1
            after[at] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges: equal for equal bytes."""
        up, down = powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
                np.cumsum(_BYTE[self.data] * up[:-1], out=self._sums[1:])
            value = (self._sums[end] - self._sums[start]) * down[start]
            return mix(value ^ (end - start).astype(np.uint64))

    @property
    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def chains(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` values (one for each start that has so many left)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = values[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out = mix(out * _BASE + values[k : k + n])
    return out


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks and stages, beside the JVM."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a text column, of about ``size`` bytes: index of the first text, bytes, and bounds of the texts in them.

    A null text is empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        bounds = offsets[at : to + 1]
        yield at, data[bounds[0] : bounds[-1]], bounds - bounds[0]
        at = to
    give_back()


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Set-up of a job: texts go to Python workers in batches of at most so many MB.

    Spark's own bound counts rows (10,000) first, which is a lot of memory, once in the JVM and twice in Python, where rows are
    whole texts. Results don't depend on it. Operators don't call this; queries and pipeline stages do.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def short_lived_shuffles(spark: SparkSession) -> None:
    """Set-up of a job: shuffle files go when the query that made them has ended, not when the driver happens to collect garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared scratch folder and read back; survives lost executors."""
    return pin(df, f"llm-{name}")


PACKED = {
    "compression": "none",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "4",
    "parquet.page.size.row.check.min": "4",
}
"""Parquet options for rows of packed bytes. Spark writes and reads a row group in memory, up to 4,096 rows of it in one piece, and Parquet's
writer counts rows (100) before it looks at their size: with rows of 100 KB and more that is a lot of memory for each task."""


def kept_packed(df: DataFrame, name: str) -> DataFrame:
    """:func:`kept` for few rows that hold much, already compressed."""
    return pin(df, f"llm-{name}", **PACKED)
