"""Detection as one streaming job: packets to limited, stored alerts, with all rules and the model.

Two chained stateful operators. The first holds a source: its packets wait in state, in slices of time, until the
watermark has passed their slice; then they are counted, rated and turned into features in time order, so that packets may arrive
out of order by as much as the watermark's delay. Rules and model score its rows without state. The second limits
the alerts of a source and type.

State of a source is a map of slices, so that a source of any rate is handled slice by slice: a worker holds one
slice of one key at a time, or several short ones of at most :data:`LEAST_ROWS` rows and one more slice. Needs the RocksDB state store (:func:`use_rocksdb`).
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quietwire.config import FEATURE_COMMON_PORTS, FEATURE_NAMES, DetectorConfig
from quietwire.functions.payload import describe_payload
from quietwire.functions.text import features_json
from quietwire.operators import rules as R
from quietwire.operators.filters import ml_score_valid, valid_sources
from quietwire.operators.forest import Forest, predict
from quietwire.operators.limiter import kept_positions
from quietwire.sources.alerts import append_alert_stream
from quietwire.streaming import state as S

SLICE_US = 10_000_000
LEAST_ROWS = 20_000
"""Short slices are handled together until they have so many rows: a frame has a cost of its own."""

NARROW = "ts timestamp, packet_id bigint, t_us bigint, src_ip string, protocol string, dst_port int, size int, payload_len int, entropy double, pattern string"
SIGNALS = (
    "ts timestamp, packet_id bigint, t_us bigint, src_ip string, protocol string, dst_port int, payload_len int, "
    "pattern string, seq bigint, rate double, avg_rate double, " + ", ".join(f"{n} double" for n in FEATURE_NAMES)
)


def use_rocksdb(spark: SparkSession) -> None:
    """Set-up of a session for the job: operators with timers keep their state in RocksDB."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class _Sliced(StatefulProcessor):
    """Rows of a key in slices of time, kept as Arrow bytes in a map state; all else in one value.

    ``order`` sorts the rows of a slice. The value is a dictionary; its entry ``pending`` counts the parts of each slice.
    """

    def __init__(self, order: list[str], slice_us: int):
        self.order, self.slice_us = order, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slice bigint, part int", "data binary")
        self.value = handle.getValueState("value", "data binary")

    def read(self) -> dict:
        return pickle.loads(self.value.get()[0]) if self.value.exists() else {"pending": {}}

    def write(self, value: dict) -> None:
        self.value.update((pickle.dumps(value),))

    def store(self, value: dict, frames: Iterator[pd.DataFrame]) -> set[int]:
        """Put rows into their slices; which ones are new."""
        new = set()
        for frame in frames:
            slices = frame["t_us"].to_numpy() // self.slice_us
            order = np.argsort(slices, kind="stable")
            numbers, starts = np.unique(slices[order], return_index=True)
            rows = pa.RecordBatch.from_pandas(frame.iloc[order], preserve_index=False, nthreads=1)
            rows = rows.replace_schema_metadata(None)
            for number, start, end in zip(numbers.tolist(), starts, [*starts[1:], len(frame)], strict=True):
                part = value["pending"].get(number, 0)
                if part == 0:
                    new.add(number)
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, rows.schema) as writer:
                    writer.write_batch(rows.slice(start, end - start))
                self.parts.updateValue((number, part), (sink.getvalue(),))
                value["pending"][number] = part + 1
        return new

    def take(self, value: dict, before: int | None) -> Iterator[pd.DataFrame]:
        """Sorted rows of the slices below ``before`` (all, if None), oldest first: one slice at a time, short ones together."""
        tables: list[pa.Table] = []
        for number in sorted(value["pending"]):
            if before is not None and number >= before:
                break
            for part in range(value["pending"].pop(number)):
                with pa.ipc.open_stream(self.parts.getValue((number, part))[0]) as reader:
                    tables.append(reader.read_all())
                self.parts.removeKey((number, part))
            if sum(len(t) for t in tables) >= LEAST_ROWS:
                yield self.sorted_rows(tables)
                tables = []
        if tables:
            yield self.sorted_rows(tables)

    def sorted_rows(self, tables: list[pa.Table]) -> pd.DataFrame:
        # A column may be null, or whole numbers, in some parts only.
        rows = pa.concat_tables(tables, promote_options="permissive").to_pandas(use_threads=False)
        return rows.sort_values(self.order, ignore_index=True)

    def close(self) -> None:
        pass


class SourceProcessor(_Sliced):
    """Counts, rates and features of a source, packet by packet, behind the watermark.

    With ``ttl_ms`` a source that was silent for longer starts anew, whatever the micro-batches, and its state goes.
    """

    def __init__(self, start_us: int, cfg: DetectorConfig, ttl_ms: int | None, slice_us: int):
        super().__init__(["t_us", "packet_id"], slice_us)
        self.start_us, self.cfg, self.ttl_ms = start_us, cfg, ttl_ms

    def _timer(self, number: int) -> int:
        return -(-(number + 1) * self.slice_us // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        value = self.read()
        for number in self.store(value, rows):
            self.handle.registerTimer(self._timer(number))
        self.write(value)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        value = self.read()
        found = False
        # The first timer takes all slices behind the watermark; those of the others find nothing left.
        for rows in self.take(value, timerValues.getCurrentWatermarkInMs() * 1000 // self.slice_us):
            found = True
            for some in self.unbroken(value, rows):
                yield self.advance(value, some, timerValues.getCurrentWatermarkInMs())
        if found and self.ttl_ms is not None:
            value["idle"] = value["last_us"] // 1000 + self.ttl_ms
            # A timer behind the watermark would not be looked for again.
            self.handle.registerTimer(max(value["idle"], timerValues.getCurrentWatermarkInMs()) + 1)
        if not value["pending"] and value.get("idle") is not None and now >= value["idle"]:
            self.value.clear()
        elif found:
            self.write(value)

    def unbroken(self, value: dict, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows up to the next silence; the state is emptied where one ends."""
        if self.ttl_ms is None:
            yield rows
            return
        times = rows["t_us"].to_numpy()
        gaps = np.diff(times, prepend=value.get("last_us", times[0]))
        cuts = np.flatnonzero(gaps > self.ttl_ms * 1000).tolist()
        for start, end in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if start in cuts:
                value.pop("features", None)
                value.pop("rates", None)
            if end > start:
                yield rows.iloc[start:end].reset_index(drop=True)

    def advance(self, value: dict, rows: pd.DataFrame, watermark_ms: int) -> pd.DataFrame:
        cfg = self.cfg
        state = value.get("features", (0, None, 0, 0, 0, 0, *[[]] * len(S.RING_COLUMNS)))
        times = rows["t_us"].to_numpy()
        seq, rate, mean, pool = S.rate_step(times, state[0], value.get("rates", []), self.start_us, cfg.rate_history)
        out, value["features"] = S.feature_step(rows, state, cfg.history, FEATURE_COMMON_PORTS)
        value["rates"], value["last_us"] = pool[-cfg.rate_history :].tolist(), int(times[-1])
        for name in ("protocol", "dst_port", "payload_len", "pattern"):
            out[name] = rows[name].to_numpy()
        out["rate"], out["avg_rate"] = rate, mean
        # Rows leave behind the watermark; what follows knows them by the time they leave.
        out["ts"] = pd.to_datetime(watermark_ms + 1, unit="ms")
        return out[_names(SIGNALS)]


class LimiterProcessor(_Sliced):
    """The limiter of a source and type; a model alert passes a second time, unlimited (``copy`` is ``direct``)."""

    def __init__(self, cooldown_us: int, max_alerts: int, ttl_ms: int | None, columns: list[str], slice_us: int):
        super().__init__(["t_us", "packet_id", "rule_seq"], slice_us)
        self.cooldown_us, self.max_alerts, self.ttl_ms, self.columns = cooldown_us, max_alerts, ttl_ms, columns

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # A source's rows come in time order from batch to batch, so all that are here can pass now.
        value = self.read()
        self.store(value, rows)
        kept = value.setdefault("kept", [])
        for frame in self.take(value, None):
            passed = kept_positions(frame["t_us"].to_numpy(), kept, self.cooldown_us, self.max_alerts)
            limited = frame.iloc[passed].assign(copy="limited")
            direct = frame[frame["rule"] == "ml"].assign(copy="direct")
            yield pd.concat([limited, direct] if len(direct) else [limited], ignore_index=True)[self.columns]
        if self.ttl_ms is not None:
            value["idle"] = timerValues.getCurrentWatermarkInMs() + self.ttl_ms
            self.handle.registerTimer(value["idle"])
        self.write(value)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if expiredTimerInfo.getExpiryTimeInMs() >= self.read().get("idle", 0):
            self.value.clear()
        return iter(())


def signals(
    packets: DataFrame,
    start_us: int,
    cfg: DetectorConfig = DetectorConfig(),
    ttl_s: int | None = None,
    slice_us: int = SLICE_US,
) -> DataFrame:
    """What rules and model read, for every packet of a usable source; ``packets`` has a watermark on ``ts``."""
    narrow = describe_payload(valid_sources(packets, cfg.trusted_subnets)).select(*_names(NARROW))
    ttl_ms = None if ttl_s is None else ttl_s * 1000
    return narrow.groupBy("src_ip").transformWithStateInPandas(
        SourceProcessor(start_us, cfg, ttl_ms, slice_us), SIGNALS, "append", "eventTime", eventTimeColumnName="ts"
    )


def candidates(rows: DataFrame, forest: Forest | None, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Candidates of all rules and of the model, in one pass over the signals."""
    null = lambda kind: F.lit(None).cast(kind)
    hit = lambda name, order, kind, score, raw: F.struct(
        F.lit(name).alias("rule"),
        F.lit(order).alias("rule_seq"),
        F.lit(kind).alias("alert_type"),
        score.alias("score"),
        raw.alias("raw_data"),
    )
    hits = [
        F.when(r.fires, hit(r.name, r.order, r.alert_type, null("double"), null("string"))) for r in R.packet_rules(cfg)
    ]
    if forest is not None:
        rows = predict(forest, rows)
        score = F.col("anomaly_score")
        flagged = F.col("prediction") == -1
        if cfg.score_threshold is not None:
            flagged = flagged | (score < cfg.score_threshold)
        ready = F.col("seq") >= max(cfg.min_packets_ml, 3)
        hits.append(F.when(ready & flagged & ml_score_valid(score), hit("ml", 0, "ML", score, features_json())))
    found = rows.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    parts = ("rule", "rule_seq", "alert_type", "score", "raw_data")
    model = F.col("_hit.rule") == "ml"
    # A model alert tells nothing of the packet it came with.
    own = lambda c: F.when(~model, F.col(c)).alias(c)
    plain = {"packet_id", "t_us", "src_ip", "seq"}
    columns = [F.col(f"_hit.{c}") if c in parts else F.col(c) if c in plain else own(c) for c in R.CANDIDATE]
    return found.select("ts", *columns)


def limited(
    found: DataFrame, cfg: DetectorConfig = DetectorConfig(), ttl_s: int | None = None, slice_us: int = SLICE_US
) -> DataFrame:
    """Limited candidates and direct copies of model alerts."""
    ttl_ms = None if ttl_s is None else ttl_s * 1000
    schema = T.StructType([*found.schema.fields, T.StructField("copy", T.StringType())])
    processor = LimiterProcessor(cfg.cooldown_s * 1_000_000, cfg.max_alerts, ttl_ms, schema.fieldNames(), slice_us)
    return found.groupBy("src_ip", "alert_type").transformWithStateInPandas(
        processor, schema, "append", "eventTime", eventTimeColumnName="ts"
    )


def alert_stream(
    packets: DataFrame,
    start_us: int,
    forest: Forest | None = None,
    cfg: DetectorConfig = DetectorConfig(),
    ttl_s: int | None = None,
    slice_us: int = SLICE_US,
) -> DataFrame:
    """Alert rows, as :func:`quietwire.plans.detection.detect` gives them for a table of the same packets.

    Packets later than the watermark's delay are dropped; the last ones before the end of a stream stay in state.
    """
    rows = limited(candidates(signals(packets, start_us, cfg, ttl_s, slice_us), forest, cfg), cfg, ttl_s, slice_us)
    direct = F.col("copy") == "direct"
    subject, body = R.alert_text([R.ml_rule(), *R.packet_rules(cfg)])
    description = F.when(direct, R.ml_rule().body).otherwise(F.concat(subject, F.lit(" - "), body))
    score = F.when(direct, F.col("score")).otherwise(F.lit(0.0))
    return rows.select(*R._alert_row(description, score, F.when(direct, F.col("raw_data"))))


def run(
    packets: DataFrame,
    start_us: int,
    path: str,
    checkpoint: str,
    forest: Forest | None = None,
    cfg: DetectorConfig = DetectorConfig(),
    ttl_s: int | None = None,
    slice_us: int = SLICE_US,
) -> StreamingQuery:
    """Start the job: alerts go to the table at ``path``, exactly once."""
    use_rocksdb(packets.sparkSession)
    return append_alert_stream(alert_stream(packets, start_us, forest, cfg, ttl_s, slice_us), path, checkpoint)
