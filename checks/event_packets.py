"""A packet view over an ``events`` table (event_id, ts, user_id, event_type, value, props).

Events are no packets; this fixed mapping makes a deterministic packet table out of them with all
the cases the detector knows. Gaps between events are hours, so time runs 3600 times faster
unless ``compress`` is off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EPOCH_US = 1_704_067_200_000_000

# The mapping from events to packets, shared with the check SQL.
PACKET_SQL = """
WITH e AS (SELECT *, user_id % 40 AS src, {US} - 1704067200000000 AS d_us FROM {EVENTS})
SELECT event_id AS packet_id,
  1704067200000000 + {TIME} AS t_us,
  CASE WHEN src = 5  THEN '192.168.65.9'
       WHEN src = 6  THEN '127.0.0.1'
       WHEN src = 7  THEN '8.8.8.8'
       WHEN src = 8  THEN '169.254.3.3'
       WHEN src = 9  THEN '203.0.113.7'
       WHEN src = 10 THEN '93.184.216.34'
       WHEN src = 12 THEN 'not-an-ip'
       ELSE concat('10.0.1.', CAST(src + 1 AS {STR})) END AS src_ip,
  CASE WHEN event_type IN ('click','view','purchase') THEN 'TCP'
       WHEN event_type = 'signup' THEN 'UDP' ELSE 'ICMP' END AS protocol,
  CASE WHEN event_type = 'error' THEN NULL
       WHEN event_id % 10 < 4 THEN 443 WHEN event_id % 10 < 7 THEN 80 WHEN event_id % 10 = 7 THEN 53
       WHEN event_id % 10 = 8 THEN 8080
       ELSE CAST(1024 + (event_id * 7919) % 60000 AS INT) END AS dst_port,
  CAST(40 + floor(value) AS INT) AS size,
  CASE WHEN event_type IN ('view','error') THEN NULL
       WHEN event_id % 41 = 0 THEN concat('id=1 union select ', props)
       WHEN event_id % 43 = 0 THEN repeat('A', 200)
       WHEN event_id % 97 = 0 THEN repeat('B', 1500)
       ELSE concat(event_type, props) END AS payload
FROM e
"""
FAST_TIME = "CASE WHEN src = 11 THEN 600000000 + (d_us {DIV} 216000) ELSE d_us {DIV} 3600 END"
REAL_TIME = "d_us"


def packet_sql(events: str, us: str, div: str, text: str, compress: bool = True) -> str:
    time = FAST_TIME.format(DIV=div) if compress else REAL_TIME
    return PACKET_SQL.format(EVENTS=events, US=us, TIME=time, STR=text)


def as_packets(events: DataFrame, compress: bool = True) -> DataFrame:
    """Map an events table or stream to packets."""
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    sql = packet_sql("{events}", us, "div", "STRING", compress)
    return (
        events.sparkSession.sql(sql, events=events)
        .withColumn("dst_port", F.col("dst_port").cast("int"))
        .withColumn("payload", F.encode("payload", "UTF-8"))
    )


def packets_from_events(spark: SparkSession, folder: str, compress: bool = True) -> DataFrame:
    return as_packets(spark.read.parquet(f"{folder}/events.parquet"), compress)
