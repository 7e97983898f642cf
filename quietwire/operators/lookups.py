"""Lookup joins: known addresses, networks, full grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quietwire.config import KNOWN_IPS
from quietwire.functions.ip import ip_to_long, ipv6_halves, is_ipv4, is_ipv6, network_category
from quietwire.scratch import pin

BROADCAST_NETWORKS = 100_000
BROADCAST_LENGTHS = 32


def known_ips(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN_IPS), "ip_address string, entity string")


def enrich_known_ips(alerts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Add ``entity`` (name of a known address or null) and ``category``.

    The built-in list has 12 rows and is broadcast; for a table passed in Spark decides by size.
    """
    names = F.broadcast(known_ips(alerts.sparkSession)) if known is None else known
    return alerts.join(names, "ip_address", "left").withColumn(
        "category", F.coalesce(F.col("entity"), network_category(F.col("ip_address")))
    )


def known_only(alerts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    names = F.broadcast(known_ips(alerts.sparkSession)) if known is None else known
    return alerts.join(names, "ip_address", "left_semi")


def _address(ip: Column) -> Column:
    """struct(family, hi, lo) of an IPv4 or IPv6 address, null for any other text."""
    four = F.struct(F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("hi"), ip_to_long(ip).alias("lo"))
    halves = ipv6_halves(ip)
    six = F.struct(F.lit(6).alias("family"), halves.getField("hi").alias("hi"), halves.getField("lo").alias("lo"))
    return F.when(is_ipv4(ip), four).when(is_ipv6(ip), six)


def _prefix(address: Column, bits: Column) -> Column:
    """struct(family, bits, hi, lo): the first ``bits`` bits of an address, the others zero."""
    cut = lambda x, n: F.call_function("shiftleft", F.call_function("shiftright", x, n), n)
    none = F.lit(0).cast("bigint")
    hi, lo, four = address.getField("hi"), address.getField("lo"), address.getField("family") == 4
    high = F.when(four | (bits == 0), none).when(bits < 64, cut(hi, 64 - bits)).otherwise(hi)
    low = (
        F.when(bits == 0, none)
        .when(four, cut(lo, 32 - bits))
        .when(bits <= 64, none)
        .otherwise(cut(lo, 128 - bits))
    )
    return F.struct(
        address.getField("family").alias("family"), bits.alias("bits"), high.alias("hi"), low.alias("lo")
    )


def network_prefixes(subnets: DataFrame) -> DataFrame:
    """Networks (column ``cidr``), IPv4 and IPv6, as ``cidr, prefix``.

    Entries that are no network, or have host bits set, are left out; one without a length is a single address.
    """
    parts = F.split("cidr", "/")
    width = F.when(F.col("address.family") == 4, 32).otherwise(128)
    named = subnets.select("cidr", _address(F.get(parts, F.lit(0))).alias("address"), F.get(parts, F.lit(1)).alias("text"))
    sized = named.withColumn("bits", F.when(F.col("text").isNull(), width).otherwise(F.col("text").try_cast("int")))
    return (
        sized.where(F.col("address").isNotNull() & F.col("bits").between(0, width))
        .withColumn("prefix", _prefix(F.col("address"), F.col("bits")))
        .where((F.col("prefix.hi") == F.col("address.hi")) & (F.col("prefix.lo") == F.col("address.lo")))
        .groupBy("prefix")
        .agg(F.min("cidr").alias("cidr"))
    )


def source_networks(rows: DataFrame, subnets: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Every distinct address of ``rows`` that lies in a network, with the longest such ``network``.

    One equi-join: an address meets each network as its own first bits, once for each length among the networks of its
    family (at most 33 and 129). Networks and addresses can be tables of any size; a hot source is one row here.
    """
    prefixes = network_prefixes(subnets)
    lengths = prefixes.groupBy(F.col("prefix.family").alias("family")).agg(F.collect_set("prefix.bits").alias("lengths"))
    known = {r.family: sorted(r.lengths) for r in lengths.collect()}
    own = lambda family: F.array(*[F.lit(n) for n in known.get(family, [])]).cast("array<int>")
    address = F.col("_address")
    sources = rows.select(ip).distinct().withColumn("_address", _address(F.col(ip))).where(address.isNotNull())
    each = sources.withColumn("_bits", F.explode(F.when(address.getField("family") == 4, own(4)).otherwise(own(6))))
    met = each.withColumn("prefix", _prefix(address, F.col("_bits"))).join(prefixes, "prefix")
    return met.groupBy(ip).agg(F.max_by("cidr", "_bits").alias("network"))


def _with_networks(rows: DataFrame, subnets: DataFrame, ip: str) -> DataFrame:
    """``rows``, the address first, with the longest ``network`` their address lies in.

    Up to ``BROADCAST_NETWORKS`` networks of up to ``BROADCAST_LENGTHS`` lengths are broadcast, one lookup for each length, and
    rows stay where they are. More go by the shuffle join of :func:`source_networks`. Runs jobs over ``subnets``.
    """
    prefixes = pin(network_prefixes(subnets), "networks")
    known = prefixes.groupBy("prefix.family", "prefix.bits").count().collect()
    if len(known) > BROADCAST_LENGTHS or sum(r["count"] for r in known) > BROADCAST_NETWORKS:
        return rows.join(source_networks(rows, subnets, ip), ip, "left")
    # An array, as fields of a struct would be taken out below the joins, each parsing the address anew.
    numbers = lambda a: F.when(a.isNotNull(), F.array(*[a.getField(n).cast("bigint") for n in ("family", "hi", "lo")]))
    taken = rows.withColumn("__address", F.get(F.transform(F.array(_address(F.col(ip))), numbers), F.lit(0)))
    part = lambda i: F.get("__address", F.lit(i))
    address = F.struct(part(0).alias("family"), part(1).alias("hi"), part(2).alias("lo"))
    found = []
    for number, r in enumerate(sorted(known, key=lambda r: -r.bits)):
        own = _prefix(address, F.lit(r.bits))
        side = prefixes.where((F.col("prefix.family") == r.family) & (F.col("prefix.bits") == r.bits)).select(
            F.col("prefix.hi").alias("__hi"), F.col("prefix.lo").alias("__lo"), F.col("cidr").alias(f"__network{number}")
        )
        same = (F.when(part(0) == r.family, own.getField("hi")) == F.col("__hi")) & (own.getField("lo") == F.col("__lo"))
        taken = taken.join(F.broadcast(side), same, "left").drop("__hi", "__lo")
        found.append(F.col(f"__network{number}"))
    network = F.coalesce(*found, F.lit(None).cast("string")).alias("network")
    return taken.select(ip, *[F.col(c) for c in rows.columns if c != ip], network)


def longest_networks(packets: DataFrame, subnets: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Packets with the ``network`` their source lies in: the longest of those given, null for none."""
    return _with_networks(packets, subnets, ip)


def outside_networks(packets: DataFrame, subnets: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Packets whose source lies in none of the networks, IPv4 or IPv6."""
    columns = [ip, *[c for c in packets.columns if c != ip]]
    return _with_networks(packets.select(*columns), subnets, ip).where("network IS NULL").select(*columns)


def fill_grid(counts: DataFrame, grid: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Every row of ``grid``, with 0 where ``counts`` has nothing."""
    return grid.join(counts, list(on), "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0).cast("bigint"))
    )


def day_hour_grid(spark: SparkSession) -> DataFrame:
    """The 168 hours of a week: day_no (0 Monday), hour."""
    return spark.range(168).select(
        F.floor(F.col("id") / 24).cast("int").alias("day_no"), (F.col("id") % 24).cast("int").alias("hour")
    )


def bucket_grid(bounds: DataFrame, step_us: int) -> DataFrame:
    """All buckets between the first and the last one, from a one-row table (first_us, last_us)."""
    return bounds.where(F.col("first_us").isNotNull()).select(
        F.explode(F.sequence(F.col("first_us"), F.col("last_us"), F.lit(step_us))).alias("bucket_us")
    )
