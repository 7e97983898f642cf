"""Arrays of a fixed size that sum up a table of any size, gathered slice by slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from quietwire.llm.common import give_back

SLICES = 64
BLOOM_BITS = 1 << 24
SPARSE = 128
LEAST_BYTES = 1 << 10


def merged(rows: DataFrame, add: bool) -> np.ndarray:
    """Sums (saturating) or ors of the packed arrays in ``part, counts``; a fixed size comes back."""

    def merge(table: pa.Table) -> pa.Table:
        open_, total = zstandard.ZstdDecompressor(), None
        for x in table["counts"]:
            data = open_.decompress(x.as_py())
            y = np.frombuffer(data, "<u2").astype(np.uint64) if add else np.frombuffer(data, "u1")
            total = y.copy() if total is None else (total + y if add else total | y)
        if add:
            total = np.minimum(total, 0xFFFFFFFF).astype("<u4")
        packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        return pa.table({"part": table["part"][:1], "counts": pa.array([packed], pa.binary())})

    open_ = zstandard.ZstdDecompressor()
    found = {r[0]: open_.decompress(r[1]) for r in rows.groupBy("part").applyInArrow(merge, "part int, counts binary").collect()}
    kind = "<u4" if add else "u1"
    return np.concatenate([np.frombuffer(found[k], kind) for k in sorted(found)]) if found else np.zeros(0, kind)


def parts(counts: np.ndarray) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=1)
    cut = [pack.compress(c.tobytes()) for c in np.split(counts, SLICES)]
    return pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array(cut, pa.binary())], names=["part", "counts"])


def folded(bits: np.ndarray) -> np.ndarray:
    """Packed bits laid half on half while at most one in ``SPARSE`` is set: bit i is then that of all i modulo the new number."""
    while len(bits) > LEAST_BYTES:
        half = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
        if int(np.bitwise_count(half).sum()) * SPARSE > len(half) * 8:
            break
        bits = half
    return bits


def in_sketch(rows: DataFrame, *columns: str) -> Column:
    """A condition on columns of those names: false only where no row of ``rows`` has their values.

    One bit for each hash, ``BLOOM_BITS`` bits at most and fewer for few rows, so that most of a table that an exact join
    would drop need not be shuffled for it. Runs a job.
    """
    spread = F.pmod(F.xxhash64(*columns), F.lit(BLOOM_BITS * 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, dtype=bool)
        for batch in batches:
            bits[batch.column(0).to_numpy() % BLOOM_BITS] = True
        yield parts(np.packbits(bits))
        del bits
        give_back()

    found = merged(rows.select(spread.alias("x")).mapInArrow(run, "part int, counts binary"), add=False)
    if not len(found):
        return F.lit(False)
    # The bits are one value, looked up by native functions: the task that asks needs no Python worker. Every stage that asks
    # carries them through the driver.
    found = folded(found)
    bits = rows.sparkSession.createDataFrame([(bytearray(found.tobytes()),)], "bits binary").scalar()
    at = F.pmod(spread, F.lit(len(found) * 8))
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("bit_get", byte, 7 - F.pmod(at, F.lit(8)).cast("int")) == 1
