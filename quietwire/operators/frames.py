"""Features over the last packets of a source, for rows in order: the arithmetic of batch and stream.

Rows of many sources may stand in one set of arrays. A frame is a range of rows; its sums are differences of
running sums, so the cost per row does not depend on the length of the frame. Sums of whole numbers are exact, so
that a gap of decades leaves no error behind when it has left the frame.
"""

from __future__ import annotations

import numpy as np

_SPLIT = 26


def _totals(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def frame_variance(values: np.ndarray, use: np.ndarray, low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Population variance of the whole numbers in use among rows ``low`` to ``at``; 0 where there is none."""
    v = np.where(use, values, 0).astype(np.int64)
    span = lambda x: (total := _totals(x))[at + 1] - total[low]
    n, first = span(use.astype(np.int64)), span(v)
    longest = int((at - low).max()) + 1 if len(at) else 0
    if not len(v) or (int(np.abs(v).max()) < 1 << 20 and longest < 1 << 10):
        over = (n * span(v * v) - first * first).astype(float)
    else:
        high, rest = v >> _SPLIT, v & ((1 << _SPLIT) - 1)
        parts = [span(x).astype(object) for x in (high * high, high * rest, rest * rest)]
        squares = parts[0] * (1 << 2 * _SPLIT) + parts[1] * (1 << (_SPLIT + 1)) + parts[2]
        over = (n.astype(object) * squares - first.astype(object) ** 2).astype(float)
    return over / np.maximum(n, 1).astype(float) ** 2


def distinct_in_frames(values: np.ndarray, start: np.ndarray, history: int) -> np.ndarray:
    """Number of distinct values (NaN is none) among the last ``history`` rows from ``start`` on, at every row.

    A value enters a frame unless it stood in it already, and leaves it with its last occurrence.
    """
    n = len(values)
    there, place = ~np.isnan(values), np.arange(n)
    order = np.lexsort((place, values, start))
    order = order[there[order]]
    before, after = np.full(n, -history - 1), np.full(n, n + history)
    same = (values[order[1:]] == values[order[:-1]]) & (start[order[1:]] == start[order[:-1]])
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    enters = _totals((there & (before <= place - history)).astype(np.int64))
    leaves = _totals((there & (after >= place + history)).astype(np.int64))
    gone = leaves[np.maximum(place - history + 1, start)] - leaves[start]
    return (enters[1:] - enters[start] - gone).astype(float)


def frame_features(
    t: np.ndarray,
    size: np.ndarray,
    port: np.ndarray,
    length: np.ndarray,
    entropy: np.ndarray,
    start: np.ndarray,
    at: np.ndarray,
    history: int,
    common: tuple[int, ...],
) -> dict[str, np.ndarray]:
    """Features of the frames that end at rows ``at``; ``start`` is, for every row, the first row of its source."""
    t = t.astype(np.int64)
    low = np.maximum(at - history + 1, start[at])
    n = at - low + 1
    span = lambda v: (total := _totals(v))[at + 1] - total[low]
    every = np.ones(len(t), dtype=bool)

    def mean(v: np.ndarray, use: np.ndarray) -> np.ndarray:
        count = span(use.astype(np.int64))
        return np.where(count > 0, span(np.where(use, v, 0.0)) / np.maximum(count, 1), 0.0)

    gaps = np.diff(t, prepend=t[:1])
    # The gap of the oldest row in the frame leads out of it.
    inner = np.minimum(low + 1, at)
    some_gap = at > low
    gap_variance = np.where(some_gap, frame_variance(gaps, every, inner, at), 0.0)
    # Rows of the last five seconds, within the source: time restarts with each one.
    shifted = t + 0
    recent = np.empty(len(at), dtype=np.int64)
    bounds = np.flatnonzero(np.diff(start, prepend=-1))
    for first, last in zip(bounds, [*bounds[1:], len(t)], strict=True):
        mine = slice(*np.searchsorted(at, [first, last]))
        own = at[mine]
        recent[mine] = own + 1 - (first + np.searchsorted(shifted[first:last], t[own] - 5_000_000, side="right"))
    has_port = ~np.isnan(port)
    uncommon = has_port & ~np.isin(port, np.asarray(common, dtype=float))
    some = length > 0
    return {
        "avg_packet_size": mean(size, every),
        "packet_size_variance": frame_variance(size, every, low, at),
        "inter_arrival_mean": (t[at] - t[low]) / np.maximum(n - 1, 1) / 1e6,
        "inter_arrival_std": np.sqrt(gap_variance) / 1e6,
        "burst_rate": np.minimum(recent, history) / 5.0,
        "unique_ports": distinct_in_frames(port, start, history)[at],
        "uncommon_port_ratio": mean(uncommon.astype(float), has_port),
        "payload_entropy": mean(entropy, entropy > 0),
        "avg_payload_size": mean(length, some),
        "payload_size_variance": frame_variance(length, some, low, at),
    }


def lifetime_features(
    age_s: np.ndarray, seq: np.ndarray, size: np.ndarray, tcp: np.ndarray, udp: np.ndarray, icmp: np.ndarray
) -> dict[str, np.ndarray]:
    """Features over all packets of a source so far, from its running sums."""
    return {
        "packets_per_second": seq / np.maximum(age_s, 0.001),
        "bytes_per_second": size / np.maximum(age_s, 0.001),
        "total_packets": seq.astype(float),
        "total_bytes": size.astype(float),
        "session_duration": age_s,
        "tcp_ratio": tcp / seq,
        "udp_ratio": udp / seq,
        "icmp_ratio": icmp / seq,
    }
