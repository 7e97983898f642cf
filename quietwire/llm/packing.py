"""Best-fit packing by minimum bin slack, on the counts of lengths.

Pieces of equal length are alike to a packing, so bins are planned on the histogram of lengths,
which never has more entries than a bin has tokens. Each step takes the longest length left and
finds, by a bitset subset-sum over the lengths left, the combination that leaves the least slack
beside it; that combination is removed as often as the counts allow. Pieces then find their place
by their rank among the pieces of their length, so no task or driver ever sees all pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quietwire.llm.common import kept
from quietwire.llm.tokens import encode_column

SEQUENCE_TOKENS = 2048
END_ID = 0


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts by length of the fullest combination that fits into ``room``; longer lengths first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, power = min(counts[length], room // length), 1
        while left > 0:
            take = min(power, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, power = left - take, power * 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + take
            at -= length * take
    return found


def plan_bins(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """``(number of bins, {length: pieces in each})``, by minimum bin slack."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    if counts and (max(counts) > size or min(counts) < 1):
        raise ValueError("lengths must be between 1 and the size of a bin")
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        bin_ = fullest({x: n for x, n in counts.items() if n}, size - longest)
        counts[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in bin_.items())
        plan.append((times, bin_))
        for x, n in bin_.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces in a bin, first bin, offset of the first piece)."""
    used: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for times, bin_ in plan:
        offset = 0
        for length in sorted(bin_, reverse=True):
            n = bin_[length]
            slots.setdefault(length, []).append((used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in slots.items()}


def token_pieces(
    documents: DataFrame, tokenizer: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every document; ids as little-endian 32-bit numbers.

    A document is its text's ids and then ``end_id``; only longer ones than ``size`` are cut. A
    null or empty text is the end id alone. Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            for at, ids, bounds in encode_column(batch.column("text"), tokenizer):
                columns = {k: [] for k in ("row", "piece", "start", "length")}
                parts = []
                for i in range(len(bounds) - 1):
                    whole = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), size)):
                        part = whole[start : start + size]
                        parts.append(part.tobytes())
                        for k, v in (("row", at + i), ("piece", piece), ("start", start), ("length", len(part))):
                            columns[k].append(v)
                yield pa.record_batch(
                    [
                        names.take(pa.array(columns["row"])),
                        pa.array(columns["piece"], pa.int32()),
                        pa.array(columns["start"], pa.int64()),
                        pa.array(columns["length"], pa.int64()),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids binary"
    )


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Every row of ``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in a sequence).

    ``length`` is read; other columns pass through (own columns of those two names are replaced).
    Equal and repeated pieces take separate places. No rows give no rows. Lengths must be 1 to
    ``size``. Runs jobs: the pieces are written once, as ranks need a fixed table.
    """
    spark = pieces.sparkSession
    salts = 16 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fixed = kept(
        pieces.drop("sequence_id", "offset").withColumn("__salt", F.floor(F.rand(11) * salts).cast("int")), "pieces"
    )
    counts = fixed.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # at most `size` rows
    slots = spark.sparkContext.broadcast(_slots(plan_bins(histogram, size)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        F.col("length").alias("__l"),
        F.col("__salt").alias("__s"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    ranked = (
        fixed.withColumn(
            "__at", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(F.lit(0))) - 1
        )
        .join(begins, (F.col("length") == F.col("__l")) & (F.col("__salt") == F.col("__s")))
        .withColumn("__rank", F.col("__before") + F.col("__at"))
        .drop("__l", "__s", "__before", "__at", "__salt")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(same):
                    continue
                table = slots.value[int(length[same[0]])]
                row = table[np.searchsorted(table[:, 0], rank[same], side="right") - 1]
                inside = rank[same] - row[:, 0]
                sequence[same] = row[:, 2] + inside // row[:, 1]
                offset[same] = row[:, 3] + inside % row[:, 1] * length[same]
            keep = batch.drop_columns(["__rank"])
            yield pa.record_batch(
                [*keep.columns, pa.array(sequence), pa.array(offset)], names=[*keep.schema.names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
