"""Payload columns: entropy, statistics, attack patterns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quietwire.config import MALICIOUS_PATTERNS

# Upper limits for one histogram matrix inside a task, whatever the Arrow batch holds.
_ROWS_AT_ONCE = 4096
_BYTES_AT_ONCE = 8 << 20


def _entropy_of_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Shannon entropy (bits) of many byte slices laid end to end in ``data``."""
    out = np.zeros(len(lengths))
    first = 0
    while first < len(lengths):
        ends = np.cumsum(lengths[first : first + _ROWS_AT_ONCE])
        rows = max(1, int(np.searchsorted(ends, _BYTES_AT_ONCE, side="right")))
        last = min(first + rows, len(lengths))
        part = lengths[first:last]
        begin = int(starts[first])
        chunk = data[begin : begin + int(part.sum())]
        cell = np.repeat(np.arange(last - first) * 256, part) + chunk
        counts = np.bincount(cell, minlength=(last - first) * 256)
        used = np.flatnonzero(counts)
        hits = counts[used]
        row = used >> 8
        weight = np.bincount(row, weights=hits * np.log2(hits), minlength=last - first)
        symbols = np.bincount(row, minlength=last - first)
        several = symbols > 1
        size = part[several]
        out[first:last][several] = np.maximum(np.log2(size) - weight[several] / size, 0.0)
        first = last
    return out


@F.arrow_udf(T.DoubleType())
def _byte_entropy(payload: pa.Array) -> pa.Array:
    payload = payload.cast(pa.large_binary())
    _, offsets, values = payload.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[payload.offset : payload.offset + len(payload) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    return pa.array(_entropy_of_slices(data, bounds[:-1], np.diff(bounds)))


def byte_entropy(payload: Column) -> Column:
    """Shannon entropy of the bytes, 0..8; 0 for null or empty.

    The bytes go to the worker as Arrow buffers and are counted in numpy without a Python object
    per row.
    """
    return _byte_entropy(F.coalesce(payload, F.lit(b"")))


def payload_length(payload: Column) -> Column:
    return F.coalesce(F.octet_length(payload), F.lit(0))


def scannable(payload: Column) -> Column:
    return payload_length(payload) > 0


def as_latin1(payload: Column) -> Column:
    """One character per byte, so text functions are safe on any bytes."""
    return F.decode(payload, "ISO-8859-1")


def first_pattern(lowered: Column, patterns: Sequence[str] = MALICIOUS_PATTERNS) -> Column:
    """The longest pattern contained in a lower-cased text; list order decides between equals."""
    by_length = sorted(patterns, key=lambda p: -len(p))
    return F.coalesce(
        *[
            F.when(F.contains(lowered, F.lit(p.lower())), F.lit(p))
            for p in by_length
        ]
    )


def malicious_pattern(payload: Column, patterns: Sequence[str] = MALICIOUS_PATTERNS) -> Column:
    """Pattern found in the payload, whatever its length, else null.

    The text is bound to a lambda so that it is decoded once and not for every pattern; over whole
    tables ``describe_payload`` is faster, as it decodes in a step of its own.
    """
    text = F.lower(as_latin1(payload))
    found = F.transform(F.array(text), lambda t: first_pattern(t, patterns))
    return F.when(scannable(payload), F.get(found, F.lit(0)))


def printable_count(latin1: Column) -> Column:
    return F.length(F.regexp_replace(latin1, "[^ -~]", ""))


def null_byte_count(latin1: Column) -> Column:
    return F.length(latin1) - F.length(F.regexp_replace(latin1, r"\x00", ""))


def payload_stats(payload: Column) -> Column:
    """struct(size, printable_chars, null_bytes, entropy, printable_ratio); null if empty."""
    text = as_latin1(payload)
    size = payload_length(payload)
    return F.when(
        scannable(payload),
        F.struct(
            size.cast("bigint").alias("size"),
            printable_count(text).cast("bigint").alias("printable_chars"),
            null_byte_count(text).cast("bigint").alias("null_bytes"),
            byte_entropy(payload).alias("entropy"),
            (printable_count(text).cast("double") / F.greatest(size, F.lit(1)).cast("double")).alias(
                "printable_ratio"
            ),
        ),
    )


def describe_payload(packets: DataFrame, patterns: Sequence[str] = MALICIOUS_PATTERNS) -> DataFrame:
    """Replace the payload by payload_len, entropy and pattern.

    Done before any shuffle, so that packets travel as narrow rows. Catalyst drops the columns
    (and the Python step behind entropy) where a job does not read them.
    """
    others = [c for c in packets.columns if c != "payload"]
    return (
        packets.withColumn("_text", F.when(scannable(F.col("payload")), F.lower(as_latin1(F.col("payload")))))
        .withColumn("payload_len", payload_length(F.col("payload")))
        .withColumn("entropy", byte_entropy(F.col("payload")))
        .withColumn("pattern", first_pattern(F.col("_text"), patterns))
        .select(*others, "payload_len", "entropy", "pattern")
    )
