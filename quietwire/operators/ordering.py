"""Per-source order without putting one source into one task.

A single source may hold a third of all packets, so a plain ``PARTITION BY src_ip`` window is
only used on rows that are already limited per source. Everything else goes through here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quietwire.scratch import pin

PACKET_ORDER = ("t_us", "packet_id")


def take_per_source(
    rows: DataFrame,
    n: int,
    newest: bool = False,
    rank: str = "seq",
    key: str = "src_ip",
    order: Sequence[str] = PACKET_ORDER,
    salts: int = 512,
) -> DataFrame:
    """The first (or newest) ``n`` rows of every source, with their rank 1..n.

    Two rounds. The first ranks within (source, salt), where the salt comes from the input
    partition: every task sends at most ``n`` rows of a source, and a hot source is spread over
    ``salts`` groups. The second ranks what is left, at most ``n * salts`` rows per source. Which
    rows are taken does not depend on the salt. Beyond the session's
    ``spark.sql.optimizer.windowGroupLimitThreshold`` Spark ranks before it drops rows.
    """
    by = [F.col(c).desc() if newest else F.col(c).asc() for c in order]
    salted = rows.withColumn("_salt", F.pmod(F.hash(F.spark_partition_id()), F.lit(salts)))
    inner = Window.partitionBy(key, "_salt").orderBy(*by)
    outer = Window.partitionBy(key).orderBy(*by)
    return (
        salted.withColumn("_rank", F.row_number().over(inner))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_salt")
        .withColumn(rank, F.row_number().over(outer))
        .where(F.col(rank) <= n)
    )


def null_safe_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal; the keys of ``table`` are dropped."""
    named = table.select(*[F.col(c).alias(f"_on_{c}" if c in keys else c) for c in table.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in keys]
    return rows.join(named, reduce(Column.__and__, same), how).drop(*[f"_on_{c}" for c in keys])


def running_totals(
    rows: DataFrame,
    totals: dict[str, Column],
    keys: Sequence[str] = ("src_ip",),
    order: Sequence[str] = PACKET_ORDER,
) -> DataFrame:
    """Inclusive running sums per key in row order, for groups of any size.

    ``order`` must identify a row within its key. Rows are range-partitioned into runs of about
    equal size, so a hot key covers many runs; each run is summed on its own and shifted by the
    total of the runs before it. Runs are written once because the run number has to stay what
    it was when the totals were taken.
    """
    names = list(totals)
    runs = pin(
        rows.select("*", *[expr.alias(f"_x_{name}") for name, expr in totals.items()])
        .repartitionByRange(*keys, *order)
        .withColumn("_run", F.spark_partition_id()),
        "runs",
    )
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        runs.groupBy(*keys, "_run")
        .agg(*[F.sum(f"_x_{name}").alias(f"_x_{name}") for name in names])
        .select(
            *keys,
            "_run",
            *[
                F.coalesce(F.sum(f"_x_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
                for name in names
            ],
        )
    )
    within = (
        Window.partitionBy(*keys, "_run")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return null_safe_join(runs, before, [*keys, "_run"]).select(
        *rows.columns,
        *[(F.col(f"_before_{name}") + F.sum(f"_x_{name}").over(within)).alias(name) for name in names],
    )


def running_count(packets: DataFrame) -> DataFrame:
    """``seq``: how many packets the source has sent so far, this one included."""
    return running_totals(packets, {"seq": F.lit(1).cast("bigint")})


def split_with_halo(sequenced: DataFrame, part_rows: int | None, halo: int) -> DataFrame:
    """Cut every source into parts of ``part_rows`` packets that can be framed on their own.

    Adds ``part`` and ``core``. The last ``halo`` packets of a part are repeated in the next one
    (``core`` false there), so a frame of up to ``halo`` preceding rows never leaves its part.
    With ``part_rows`` None the sources are known to be limited and stay whole.
    """
    if part_rows is None:
        return sequenced.select("*", F.lit(0).cast("bigint").alias("part"), F.lit(True).alias("core"))
    if halo > part_rows:
        raise ValueError("a part must hold at least as many packets as the halo")
    at = F.col("seq").cast("bigint") - 1
    own = F.floor(at / part_rows).cast("bigint")
    near_end = F.pmod(at, F.lit(part_rows)) >= part_rows - halo
    parts = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        sequenced.withColumn("_own", own)
        .withColumn("part", F.explode(parts))
        .withColumn("core", F.col("part") == F.col("_own"))
        .drop("_own")
    )
