"""The alert limiter: a few alerts per source and type in any cooldown period.

Which alerts pass depends on those that passed before, so a key is a sequence. It is cut into chunks; a chunk turns an
entry state (the last ``m`` kept times) into an exit state, and these functions are composed in a tree.

With N(p) the first candidate more than the cooldown after candidate p, the k-th kept one is
``p[k] = max(p[k-1] + 1, N(p[k-m]))``. Both steps are monotone, so the kept ones after an entry state are the largest,
place by place, of the sequences that start afresh at each of its candidates. A chunk's function is therefore a table
with one row for each candidate an earlier kept time can lead to: how many the sequence from there keeps in the chunk,
and the last of them. Those candidates lie within one cooldown of the chunk's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from quietwire.operators.ordering import null_safe_join
from quietwire.scratch import pin

KEY = ("src_ip", "alert_type")
ORDER = ("t_us", "packet_id", "rule_seq")
CHUNK, ENTRY = "_chunk", "_entry"
CHUNK_S = 3_600
CHUNK_ROWS = 1_000_000
"""Rows of a key in one chunk of time beyond which rows are cut by ranges as well."""

FANOUT = 32
NEVER = -(1 << 62)
"""A kept time that holds nothing back."""

TABLE = "before bigint, at array<bigint>, counts array<bigint>, tails array<bigint>"


def kept_positions(times: np.ndarray, kept: list[int], cooldown_us: int, max_alerts: int) -> list[int]:
    """Positions in sorted ``times`` that pass, given the times kept before.

    ``kept`` (at most ``max_alerts`` times, oldest first) is updated in place. A full list
    means nothing passes until its oldest entry is more than the cooldown ago, so the next
    position is found by binary search and the cost follows the alerts kept, not the candidates.
    """
    out: list[int] = []
    i, n = 0, len(times)
    while i < n:
        if len(kept) == max_alerts:
            i = max(i, int(np.searchsorted(times, kept[0] + cooldown_us, side="right")))
            if i >= n:
                break
            kept.pop(0)
        out.append(i)
        kept.append(int(times[i]))
        i += 1
    return out


def transition_table(
    times: np.ndarray, before: int, cooldown_us: int, max_alerts: int, tail: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The function of a chunk: candidates a time up to ``before`` can lead to, and what the sequence from each keeps.

    Returns their times, the numbers kept in the chunk, and the last ``tail`` kept times, newest first.
    """
    n = len(times)
    after = np.searchsorted(times, times + cooldown_us, side="right")
    size = min(int(np.searchsorted(times, before + cooldown_us, side="right")) + 1, n)
    place = np.arange(size)
    ring = np.full((tail, size), NEVER, dtype=np.int64)
    last = [np.full(size, -1) for _ in range(max_alerts)]  # oldest first
    counts = np.zeros(size, dtype=np.int64)
    step = 0
    while True:
        alive = np.flatnonzero(place < n)
        if not len(alive):
            break
        ring[step % tail, alive] = times[place[alive]]
        counts[alive] += 1
        last = [*last[1:], place]
        held = np.where(last[0] >= 0, after[np.clip(last[0], 0, n - 1)], 0)
        place = np.where(place < n, np.maximum(place + 1, held), n)
        step += 1
    newest = (counts[:, None] - 1 - np.arange(tail)) % tail
    tails = np.where(np.arange(tail) < counts[:, None], ring[newest, np.arange(size)[:, None]], NEVER)
    return times[:size], counts, tails


def through(
    entries: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray], cooldown_us: int, want: int
) -> tuple[np.ndarray, np.ndarray]:
    """How many a chunk keeps after each entry state (rows, oldest first), and the last ``want`` of them, newest first."""
    at, counts, tails = table
    m = entries.shape[1]
    x = np.searchsorted(at, entries + cooldown_us, side="right")
    inside = x < len(at)
    x = np.minimum(x, len(at) - 1)
    own = np.where(inside, counts[x], 0)
    total = (own + np.arange(m)).min(axis=1)
    found = np.full((len(entries), want), NEVER, dtype=np.int64)
    for w in range(want):
        for j in range(m):
            i = total - w - j
            back = own[:, j] - i
            use = (i >= 1) & (back < tails.shape[1])
            found[:, w] = np.where(use, np.maximum(found[:, w], tails[x[:, j], np.where(use, back, 0)]), found[:, w])
    return total, found


def _newest(total: np.ndarray, found: np.ndarray, earlier: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` of ``earlier`` followed by ``total`` more, whose last are ``found``; all newest first."""
    w = np.arange(size)
    use = w < total[:, None]
    back = np.clip(w - total[:, None], 0, earlier.shape[1] - 1)
    old = np.where((w - total[:, None]) < earlier.shape[1], np.take_along_axis(earlier, back, axis=1), NEVER)
    width = found.shape[1]
    return np.where(use, found[:, np.minimum(w, width - 1)], old)


def composed(
    first: tuple[np.ndarray, np.ndarray, np.ndarray],
    later: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
    before: int,
    cooldown_us: int,
    max_alerts: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The function of a run of chunks; ``before`` is the last time before them.

    Aligning sequences of different lengths costs up to ``max_alerts`` columns of the tails.
    """
    at, counts, tails = first
    size = tails.shape[1] - max_alerts
    tails = tails[:, :size]
    for table in later:
        total, found = through(tails[:, :max_alerts][:, ::-1], table, cooldown_us, size)
        counts, tails = counts + total, _newest(total, found, tails, size)
        if at[-1] <= before + cooldown_us:
            # A time before the run can lead past all chunks so far, into this one.
            more = int(np.searchsorted(table[0], before + cooldown_us, side="right")) + 1
            at = np.concatenate([at, table[0][:more]])
            counts = np.concatenate([counts, table[1][:more]])
            tails = np.concatenate([tails, table[2][:more, :size]])
    return at, counts, tails


def _read(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.asarray(row["at"], dtype=np.int64)
    return at, np.asarray(row["counts"], dtype=np.int64), np.asarray(row["tails"], dtype=np.int64).reshape(len(at), -1)


def _runs_of(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Bounds of equal (key, chunk) rows in a sorted batch."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    for name in (*KEY, CHUNK):
        column = batch.column(name)
        null = np.asarray(pc.is_null(column))
        changed[1:] |= np.asarray(pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)) | (null[1:] != null[:-1])
    starts = np.flatnonzero(changed).tolist()
    return list(zip([0, *starts], [*starts, batch.num_rows], strict=True))


def _passing(batches: Iterator[pa.RecordBatch], cooldown_us: int, max_alerts: int) -> Iterator[pa.RecordBatch]:
    """Rows that pass, of rows sorted by chunk, each with its chunk's entry state. Memory is one batch."""
    current, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        times = batch.column("t_us").to_numpy(zero_copy_only=False)
        take: list[int] = []
        for lo, hi in _runs_of(batch):
            name = tuple(batch.column(k)[lo].as_py() for k in (*KEY, CHUNK))
            if name != current:
                current, kept = name, list(batch.column(ENTRY)[lo].as_py() or ())
            take += [lo + p for p in kept_positions(times[lo:hi], kept, cooldown_us, max_alerts)]
        if take:
            yield batch.drop_columns([CHUNK, ENTRY]).take(pa.array(take))


def _passed(rows: DataFrame, entries: DataFrame | None, cooldown_us: int, max_alerts: int) -> DataFrame:
    """The rows that pass; chunks that are not in ``entries`` start empty."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns if c != CHUNK)
    empty = F.lit(None).cast("array<bigint>")
    with_entry = (
        rows.withColumn(ENTRY, empty)
        if entries is None
        else null_safe_join(rows, entries.withColumn(ENTRY, F.filter(ENTRY, lambda t: t > NEVER)), [*KEY, CHUNK], "left")
    )
    return (
        with_entry.repartition(*KEY, CHUNK)
        .sortWithinPartitions(*KEY, CHUNK, *ORDER)
        .mapInArrow(lambda batches: _passing(batches, cooldown_us, max_alerts), schema)
    )


def _tables(rows: DataFrame, chunks: DataFrame, cooldown_us: int, max_alerts: int, tail: int) -> DataFrame:
    """One row per chunk of a chain, with its transition table."""

    def table(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.iloc[:1]
        times = np.sort(frame["t_us"].to_numpy())
        before = int(one["_before"].iloc[0])
        at, counts, tails = transition_table(times, before, cooldown_us, max_alerts, tail)
        named = one[[*KEY, CHUNK, "_chain", "_ord"]]
        return named.assign(before=before, at=[at], counts=[counts], tails=[tails.ravel()])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*KEY, CHUNK)) + f", _chain bigint, _ord bigint, {TABLE}"
    narrow = null_safe_join(rows.select(*KEY, CHUNK, "t_us"), chunks, [*KEY, CHUNK])
    return narrow.groupBy(*KEY, CHUNK).applyInPandas(table, schema)


def _composed(tables: DataFrame, width: int, cooldown_us: int, max_alerts: int) -> DataFrame:
    """Tables of runs of ``FANOUT`` neighbours, ``width`` chunks each: what the first one's candidates lead to at the end."""

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_ord")
        first, *later = [_read(row) for _, row in frame.iterrows()]
        at, counts, tails = composed(first, later, int(frame["before"].iloc[0]), cooldown_us, max_alerts)
        return frame.iloc[:1].assign(at=[at], counts=[counts], tails=[tails.ravel()])

    group = F.floor(F.col("_ord") / (width * FANOUT))
    named = tables.withColumn("_group", group)
    schema = named.drop("_group").schema
    return named.groupBy(*KEY, "_chain", "_group").applyInPandas(lambda f: compose(f.drop(columns="_group")), schema)


def _walked(tables: DataFrame, entries: DataFrame | None, width: int, cooldown_us: int, max_alerts: int) -> DataFrame:
    """Entry states of all tables, from those of their runs of ``FANOUT``; without any, chains start empty."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_ord")
        first = frame[ENTRY].iloc[0]
        state = np.full((1, max_alerts), NEVER, dtype=np.int64) if first is None else np.array([first], dtype=np.int64)
        found = []
        for _, row in frame.iterrows():
            found.append(state[0].tolist())
            total, new = through(state, _read(row), cooldown_us, max_alerts)
            state = _newest(total, new, state[:, ::-1], max_alerts)[:, ::-1]
        return frame[[*KEY, CHUNK, "_chain", "_ord"]].assign(**{ENTRY: found})

    named = tables.withColumn("_group", F.floor(F.col("_ord") / (width * FANOUT)))
    if entries is None:
        named = named.withColumn(ENTRY, F.lit(None).cast("array<bigint>"))
    else:
        of = entries.select(*KEY, "_chain", F.floor(F.col("_ord") / (width * FANOUT)).alias("_group"), ENTRY)
        named = null_safe_join(named, of, [*KEY, "_chain", "_group"])
    kinds = {f.name: f.dataType.simpleString() for f in tables.schema}
    columns = (*KEY, CHUNK, "_chain", "_ord")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", {ENTRY} array<bigint>"
    return named.groupBy(*KEY, "_chain", "_group").applyInPandas(walk, schema)


def _chunks(rows: DataFrame, cooldown_us: int) -> DataFrame:
    """Chunks with their place in their chain (chunks less than a cooldown apart), its length, and their rows."""
    order = Window.partitionBy(*KEY).orderBy(CHUNK)
    spans = rows.groupBy(*KEY, CHUNK).agg(
        F.min("t_us").alias("_first"), F.max("t_us").alias("_last"), F.count("*").alias("_rows")
    )
    # Kept times of earlier chunks are at most the last time before.
    spans = spans.withColumn("_before", F.lag("_last").over(order))
    linked = F.coalesce(F.col("_first") <= F.col("_before") + cooldown_us, F.lit(False))
    spans = spans.withColumn("_chain", F.sum((~linked).cast("bigint")).over(order))
    in_chain = Window.partitionBy(*KEY, "_chain")
    return spans.select(
        *KEY,
        CHUNK,
        F.coalesce("_before", F.lit(NEVER)).alias("_before"),
        "_chain",
        (F.row_number().over(in_chain.orderBy(CHUNK)) - 1).cast("bigint").alias("_ord"),
        F.count("*").over(in_chain).alias("_length"),
        "_rows",
    )


def _entry_states(
    rows: DataFrame, chunks: DataFrame, longest: int, cooldown_us: int, max_alerts: int, rounds: list[str]
) -> DataFrame:
    """What each chunk of a chain starts from: ``KEY, CHUNK, ENTRY``.

    Tables of a chain's chunks are composed, ``FANOUT`` at a time, and walked down again: two rounds for each
    factor of ``FANOUT`` in the longest chain.
    """
    chunks = pin(chunks.where("_length > 1").drop("_length", "_rows"), "limiter-chunks")
    levels = 1
    while FANOUT**levels < longest:
        levels += 1
    tail = max_alerts * (levels + 1)
    found = [pin(_tables(rows, chunks, cooldown_us, max_alerts, tail), "limiter-tables")]
    rounds.append("tables")
    for level in range(levels - 1):
        found.append(pin(_composed(found[-1], FANOUT**level, cooldown_us, max_alerts), "limiter-tables"))
        rounds.append("compose")
    entries = None
    for level in reversed(range(levels)):
        entries = pin(_walked(found[level], entries, FANOUT**level, cooldown_us, max_alerts), "limiter-entries")
        rounds.append("walk")
    return entries.select(*KEY, CHUNK, ENTRY)


def limit_alerts(
    candidates: DataFrame,
    cooldown_s: int = 60,
    max_alerts: int = 3,
    chunk_s: int = CHUNK_S,
    rounds: list[str] | None = None,
) -> DataFrame:
    """Keep a candidate unless ``max_alerts`` kept ones of its source and type are within the cooldown.

    Candidates are written once and cut into chunks of time; where a chunk has more than ``CHUNK_ROWS`` rows they are cut by
    range as well, so that neither a busy hour nor a busy key is one task. Entry states of the chunks come from
    composed transition tables; then all chunks are folded at once. Null sources are a source. ``rounds`` collects the
    names of the rounds. Runs jobs; rows, tables and states go to the shared folder.
    """
    cooldown_us = cooldown_s * 1_000_000
    rounds = [] if rounds is None else rounds
    hour = F.floor(F.col("t_us") / (chunk_s * 1_000_000)).cast("bigint")
    rows = pin(candidates.withColumn(CHUNK, hour * (1 << 24)), "limiter")
    while True:
        chunks = _chunks(rows, cooldown_us)
        longest, most = chunks.agg(F.max("_length"), F.max("_rows")).first()
        if most is None or most <= CHUNK_ROWS or "ranges" in rounds:
            break
        cut = F.col(CHUNK) + F.spark_partition_id()
        rows = pin(rows.repartitionByRange(*KEY, *ORDER).withColumn(CHUNK, cut), "limiter")
        rounds.append("ranges")
    entries = None
    if longest is not None and longest > 1:
        entries = _entry_states(rows, chunks, longest, cooldown_us, max_alerts, rounds)
    return _passed(rows, entries, cooldown_us, max_alerts).select(*candidates.columns)
