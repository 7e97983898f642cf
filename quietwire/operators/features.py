"""The 18 traffic features per source: as a snapshot and at every packet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quietwire.config import FEATURE_COMMON_PORTS, FEATURE_NAMES
from quietwire.functions.payload import describe_payload
from quietwire.operators.frames import frame_features, lifetime_features
from quietwire.operators.ordering import null_safe_join, split_with_halo, take_per_source


def seconds(us: Column) -> Column:
    return us.cast("double") / 1e6


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def is_uncommon(port: Column) -> Column:
    return ~port.isin(*FEATURE_COMMON_PORTS)


def snapshot_features(
    packets: DataFrame, history: int, as_of_us: int | None = None, min_packets: int = 3
) -> DataFrame:
    """One row of features per source with at least ``min_packets`` packets.

    Lifetime parts are one ``groupBy`` with map-side sums. History parts read only the newest
    ``history`` packets of each source, picked by a salted two-round top-n, so no task ever holds
    a whole hot source. ``as_of_us`` defaults to the time of the newest packet.
    """
    now = packets.agg(F.max("t_us")).scalar() if as_of_us is None else F.lit(as_of_us)
    protocol = F.col("protocol")
    life = packets.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("size").cast("bigint")).alias("bytes"),
        F.min("t_us").alias("first_us"),
        F.count_if(protocol == "TCP").alias("tcp"),
        F.count_if(protocol == "UDP").alias("udp"),
        F.count_if(protocol == "ICMP").alias("icmp"),
    ).where(F.col("n") >= min_packets)

    newest = take_per_source(
        describe_payload(packets).select(
            "src_ip", "t_us", "packet_id", "size", "dst_port", "payload_len", "entropy"
        ),
        history,
        newest=True,
        rank="age",
    )
    older = Window.partitionBy("src_ip").orderBy("age")
    size, port, length, entropy = (F.col(c) for c in ("size", "dst_port", "payload_len", "entropy"))
    hist = (
        newest.withColumn("gap_us", F.col("t_us") - F.lead("t_us").over(older))
        .groupBy("src_ip")
        .agg(
            F.avg(size).alias("avg_packet_size"),
            F.var_pop(size).alias("packet_size_variance"),
            F.avg("gap_us").alias("gap_mean"),
            F.stddev_pop("gap_us").alias("gap_std"),
            F.count_if(F.col("t_us") > now - 5_000_000).alias("burst"),
            F.countDistinct(port).alias("ports"),
            F.count_if(is_uncommon(port)).alias("uncommon"),
            F.count(port).alias("with_port"),
            F.avg(F.when(entropy > 0, entropy)).alias("mean_entropy"),
            F.avg(F.when(length > 0, length)).alias("mean_payload"),
            F.var_pop(F.when(length > 0, length)).alias("payload_var"),
        )
    )
    age_s = seconds(now - F.col("first_us"))
    n = F.col("n").cast("double")
    zero = F.lit(0.0)
    columns = {
        "packets_per_second": n / F.greatest(age_s, F.lit(0.001)),
        "bytes_per_second": F.col("bytes").cast("double") / F.greatest(age_s, F.lit(0.001)),
        "avg_packet_size": F.col("avg_packet_size"),
        "packet_size_variance": F.col("packet_size_variance"),
        "total_packets": n,
        "total_bytes": F.col("bytes").cast("double"),
        "inter_arrival_mean": F.coalesce(F.col("gap_mean") / 1e6, zero),
        "inter_arrival_std": F.coalesce(F.col("gap_std") / 1e6, zero),
        "burst_rate": F.col("burst").cast("double") / 5.0,
        "session_duration": age_s,
        "tcp_ratio": F.col("tcp") / n,
        "udp_ratio": F.col("udp") / n,
        "icmp_ratio": F.col("icmp") / n,
        "unique_ports": F.col("ports").cast("double"),
        "uncommon_port_ratio": ratio(F.col("uncommon"), F.col("with_port")),
        "payload_entropy": F.coalesce(F.col("mean_entropy"), zero),
        "avg_payload_size": F.coalesce(F.col("mean_payload"), zero),
        "payload_size_variance": F.coalesce(F.col("payload_var"), zero),
    }
    return null_safe_join(life, hist, ["src_ip"]).select("src_ip", *[columns[c].alias(c) for c in FEATURE_NAMES])


_RING = ("t_us", "size", "port", "length", "entropy")
_LIFE = ("bytes", "tcp", "udp", "icmp")


def running_features(
    sequenced: DataFrame,
    history: int,
    min_packets: int = 10,
    part_rows: int | None = 100_000,
) -> DataFrame:
    """The features of a source as they stood at each of its packets, from ``min_packets`` on.

    Input: described packets with ``seq``. One pass over sorted Arrow batches, with the last ``history`` packets of a part in
    hand, so that a worker holds one batch. ``part_rows`` must be given where a source may be large (see
    ``split_with_halo``); each part then starts with a row of its own that holds the lifetime sums of earlier parts.
    """
    protocol = F.col("protocol")
    life = {
        "bytes": F.coalesce(F.col("size").cast("bigint"), F.lit(0).cast("bigint")),
        **{p.lower(): F.coalesce((protocol == p).cast("bigint"), F.lit(0).cast("bigint")) for p in ("TCP", "UDP", "ICMP")},
    }
    as_double = lambda c: F.col(c).cast("double")
    rows = split_with_halo(sequenced, part_rows, history).select(
        "src_ip",
        "part",
        "t_us",
        "packet_id",
        F.col("seq").cast("bigint").alias("seq"),
        "core",
        *[expr.alias(name) for name, expr in life.items()],
        as_double("dst_port").alias("port"),
        as_double("payload_len").alias("length"),
        as_double("entropy").alias("entropy"),
    )
    if part_rows is not None:
        rows = rows.unionByName(_earlier_parts(sequenced, life, part_rows), allowMissingColumns=True)
    least, names = max(min_packets, 3), list(FEATURE_NAMES)
    schema = "src_ip string, packet_id bigint, t_us bigint, seq bigint, " + ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            mine = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "t_us", *_LIFE, "port", "length", "entropy")}
            mine["core"] = batch.column("core").fill_null(False).to_numpy(zero_copy_only=False)
            mine["seq"] = batch.column("seq").fill_null(0).to_numpy()
            head = batch.column("seq").is_null().to_numpy(zero_copy_only=False)
            new = _starts(batch)
            # Rows to emit are numbered in the batch; carried ones are not.
            mine["row"] = np.arange(batch.num_rows)
            if carry is not None:
                if (batch.column("src_ip")[0].as_py(), batch.column("part")[0].as_py()) == carry["key"]:
                    new[0] = False
                old = carry["rows"]
                mine = {c: np.concatenate([old[c], mine[c]]) for c in mine}
                head = np.concatenate([carry["head"], head])
                new = np.concatenate([np.arange(len(carry["head"])) == 0, new])
            # The first row of a group may be its header: running sums start from it, frames after it.
            n = len(head)
            begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            counted = mine["core"] | head
            sums = {}
            for c in _LIFE:
                total = np.cumsum(np.where(counted, mine[c], 0))
                sums[c] = total - (total[begin] - np.where(counted, mine[c], 0)[begin])
            first_us = mine["t_us"][begin]
            body = ~head
            place = np.cumsum(body) - 1
            start = (place[np.minimum(begin + head[begin], n - 1)])[body]
            ring = {
                "t_us": mine["t_us"][body],
                "size": mine["bytes"][body],
                "port": mine["port"][body].astype(float),
                "length": mine["length"][body].astype(float),
                "entropy": mine["entropy"][body].astype(float),
            }
            emit = body & mine["core"] & (mine["row"] >= 0) & (mine["seq"] >= least)
            at = place[emit]
            if len(at):
                seq = mine["seq"][emit]
                age = (mine["t_us"] - first_us)[emit] / 1e6
                found = frame_features(*ring.values(), start, at, history, FEATURE_COMMON_PORTS)
                found |= lifetime_features(age, seq, *[sums[c][emit] for c in _LIFE])
                own = batch.take(pa.array(mine["row"][emit]))
                yield pa.record_batch(
                    [*[own.column(c) for c in ("src_ip", "packet_id", "t_us", "seq")], *[pa.array(found[c]) for c in names]],
                    names=["src_ip", "packet_id", "t_us", "seq", *names],
                )
            # What the next batch needs of the last group: its sums so far, as a header, and its last rows.
            last = int(begin[-1])
            keep = np.flatnonzero(body & (np.arange(n) >= last))[-history:]
            rows_kept = {c: np.concatenate([mine[c][last : last + 1], mine[c][keep]]) for c in mine}
            for c in _LIFE:
                rows_kept[c] = rows_kept[c].copy()
                rows_kept[c][0] = sums[c][-1]
            rows_kept["core"] = np.zeros(len(keep) + 1, dtype=bool)
            rows_kept["row"] = np.full(len(keep) + 1, -1)
            carry = {
                "key": (batch.column("src_ip")[-1].as_py(), batch.column("part")[-1].as_py()),
                "rows": rows_kept,
                "head": np.arange(len(keep) + 1) == 0,
            }

    return (
        rows.repartition("src_ip", "part")
        .sortWithinPartitions("src_ip", "part", F.col("seq").isNotNull(), "t_us", "packet_id")
        .mapInArrow(run, schema)
    )


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows of a sorted batch begin another source or part."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for name in ("src_ip", "part"):
        column = batch.column(name)
        null = np.asarray(pc.is_null(column))
        new[1:] |= np.asarray(pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)) | (null[1:] != null[:-1])
    return new


def _earlier_parts(sequenced: DataFrame, life: dict[str, Column], part_rows: int) -> DataFrame:
    """A row for each part of a source (``seq`` null): its lifetime sums before the part, and its first time."""
    part = F.floor((F.col("seq").cast("bigint") - 1) / part_rows).cast("bigint").alias("part")
    earlier = Window.partitionBy("src_ip").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("src_ip").orderBy("part")
    return (
        sequenced.groupBy("src_ip", part)
        .agg(*[F.sum(expr).alias(name) for name, expr in life.items()], F.min("t_us").alias("t"))
        .select(
            "src_ip",
            "part",
            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("bigint").alias(c) for c in life],
            F.first("t").over(upto).alias("t_us"),
        )
    )
