"""Task-side state functions of the streaming jobs: one source (or key) at a time, numpy inside."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming.state import GroupState

from quietwire.operators.frames import frame_features, lifetime_features
from quietwire.operators.limiter import kept_positions

RATE_STATE = "seq bigint, rates array<double>"
RING_COLUMNS = ("t_us", "size", "port", "length", "entropy")
FEATURE_STATE = (
    "seq bigint, first_us bigint, bytes bigint, tcp bigint, udp bigint, icmp bigint, "
    + ", ".join(f"{c} array<double>" for c in RING_COLUMNS)
)
LIMITER_STATE = "kept array<bigint>"


def earliest(
    chunks: Iterator[pd.DataFrame], order: list[str], limit: int | None
) -> tuple[pd.DataFrame | None, int, int]:
    """The rows of one key in order, how many there were, and the last time.

    With a ``limit`` only the first so many: chunks are merged one at a time then. Without one they are all the rows of the
    key in this micro-batch, whose size the trigger sets (``max_files`` of ``packet_stream``).
    """
    if limit is None:
        rows = in_order(chunks, order)
        return (rows, len(rows), int(rows["t_us"].iloc[-1])) if len(rows) else (None, 0, 0)
    best, total, newest = None, 0, 0
    for chunk in chunks:
        if chunk.empty:
            continue
        total += len(chunk)
        newest = max(newest, int(chunk["t_us"].max()))
        if limit > 0:
            merged = chunk if best is None else pd.concat([best, chunk], ignore_index=True)
            best = merged.sort_values(order, ignore_index=True).head(limit)
    return best, total, newest


def in_order(chunks: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """All rows of one key in this micro-batch, sorted; the trigger limits how many there are."""
    return pd.concat(list(chunks), ignore_index=True).sort_values(order, ignore_index=True)


def expire(state: GroupState, newest_us: int, ttl_ms: int | None) -> None:
    """Ask for removal when event time passes the last packet by ``ttl_ms``; renewed at every call."""
    if ttl_ms is not None:
        wanted = newest_us // 1000 + ttl_ms
        state.setTimeoutTimestamp(max(wanted, state.getCurrentWatermarkMs() + 1))


def rate_step(
    times: np.ndarray, seen: int, rates: list[float], start_us: int, history: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Running count, rate and rolling mean of a source's next packets, and its rates so far."""
    seq = seen + np.arange(1, len(times) + 1)
    elapsed = (times - start_us) / 1e6
    rate = np.where(elapsed > 0, seq / np.where(elapsed > 0, elapsed, 1.0), np.nan)
    live = elapsed > 0
    pool = np.concatenate([np.asarray(rates, dtype=float), rate[live]])
    mean = np.full(len(times), np.nan)
    if live.any():
        at = len(rates) + np.arange(live.sum())
        low = np.maximum(at - history + 1, 0)
        sums = np.concatenate([[0.0], np.cumsum(pool)])
        mean[live] = (sums[at + 1] - sums[low]) / (at + 1 - low)
    return seq, rate, mean, pool


def rate_signals(
    start_us: int, history: int, cap: int | None, ttl_ms: int | None, columns: list[str]
) -> Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Count and rolling rate of a source; packets over the budget are counted but not emitted."""

    def update(
        key: Any, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, rates = state.get if state.exists else (0, [])
        rows, total, newest = earliest(chunks, ["t_us", "packet_id"], None if cap is None else cap - seen)
        expire(state, newest, ttl_ms)
        if rows is None:
            state.update((seen + total, rates))
            return
        seq, rate, mean, pool = rate_step(rows["t_us"].to_numpy(), seen, rates, start_us, history)
        state.update((seen + total, pool[-history:].tolist()))
        yield rows.assign(seq=seq, rate=rate, avg_rate=mean)[columns]

    return update


def feature_step(
    rows: pd.DataFrame, state: tuple, history: int, common: tuple[int, ...]
) -> tuple[pd.DataFrame, tuple]:
    """Features of a source at each of its next packets, and its state after them."""
    seen, first_us, nbytes, tcp, udp, icmp, *kept = state
    if first_us is None:
        first_us = int(rows["t_us"].iloc[0])
    new = {
        "t_us": rows["t_us"],
        "size": rows["size"],
        "port": rows["dst_port"],
        "length": rows["payload_len"],
        "entropy": rows["entropy"],
    }
    old = len(kept[0])
    ring = {
        c: np.concatenate([np.asarray(before, dtype=float), new[c].to_numpy(dtype=float, na_value=np.nan)])
        for c, before in zip(RING_COLUMNS, kept)
    }
    n = old + len(rows)
    out = frame_features(*ring.values(), np.zeros(n, dtype=np.int64), np.arange(old, n), history, common)
    seq = seen + np.arange(1, len(rows) + 1)
    protocol = rows["protocol"].to_numpy()
    running = lambda start, values: start + np.cumsum(values)
    bytes_life = running(nbytes, rows["size"].to_numpy())
    by_protocol = {p: running(n, protocol == p) for p, n in (("TCP", tcp), ("UDP", udp), ("ICMP", icmp))}
    times = rows["t_us"].to_numpy()
    out = pd.DataFrame(out | lifetime_features((times - first_us) / 1e6, seq, bytes_life, *by_protocol.values()))
    out["src_ip"], out["packet_id"] = rows["src_ip"].to_numpy(), rows["packet_id"].to_numpy()
    out["t_us"], out["seq"] = times, seq
    left = (
        int(seq[-1]),
        int(first_us),
        int(bytes_life[-1]),
        *[int(by_protocol[p][-1]) for p in ("TCP", "UDP", "ICMP")],
        *[ring[c][-history:].tolist() for c in RING_COLUMNS],
    )
    return out, left


def feature_rows(
    history: int, cap: int | None, min_packets: int, common: tuple[int, ...], ttl_ms: int | None, columns: list[str]
) -> Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The 18 features of a source at each packet, with its last ``history`` packets as state."""

    def update(
        key: Any, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, first_us, nbytes, tcp, udp, icmp, kept = 0, None, 0, 0, 0, 0, [[]] * len(RING_COLUMNS)
        if state.exists:
            seen, first_us, nbytes, tcp, udp, icmp, *kept = state.get
        rows, _, newest = earliest(chunks, ["t_us", "packet_id"], None if cap is None else cap - seen)
        expire(state, newest, ttl_ms)
        if rows is None:
            return
        out, left = feature_step(rows, (seen, first_us, nbytes, tcp, udp, icmp, *kept), history, common)
        state.update(left)
        seq = out["seq"].to_numpy()
        yield out[seq >= max(min_packets, 3)][columns]

    return update


def kept_alerts(
    cooldown_us: int, max_alerts: int, ttl_ms: int | None, columns: list[str]
) -> Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The limiter with its last kept times as state."""

    def update(
        key: Any, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = in_order(chunks, ["t_us", "packet_id", "rule_seq"])
        kept = list(state.get[0]) if state.exists else []
        times = rows["t_us"].to_numpy()
        passed = kept_positions(times, kept, cooldown_us, max_alerts)
        state.update((kept,))
        expire(state, int(times[-1]), ttl_ms)
        yield rows.iloc[passed][columns]

    return update
