from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from quietwire import config as C
from quietwire.functions import ip as ipf
from quietwire.operators import filters as flt, lookups as look
from tests.conftest import packet, packets_df

ODD = ["0.0.0.0", "256.1.1.1", "1.2.3", "01.2.3.4", "1.2.3.4 ", "1.2.3.4\n", "", "abc", None, "192.0.0.9", "192.0.0.170", "172.32.0.1", "172.31.255.255", "8.8.8.8", "224.0.0.1", "240.0.0.1", "255.255.255.255", "192.168.65.1", "198.19.3.3"]


def addresses() -> list[str | None]:
    rng = random.Random(3)
    first = [0, 8, 10, 127, 169, 172, 192, 198, 203, 224, 239, 240, 100]
    return ODD + [f"{rng.choice(first)}.{rng.choice([0, 16, 18, 31, 51, 168, 254, 7])}.{rng.choice([0, 2, 65, 100, 113])}.{rng.randint(0, 255)}" for _ in range(600)]


def parse(text):
    try:
        return ipaddress.IPv4Address(text)
    except (ValueError, TypeError):
        return None


def test_parse_and_categories(spark):
    cases = addresses()
    ip = F.col("ip")
    df = spark.createDataFrame(list(enumerate(cases)), "i int, ip string").select(
        "i", ipf.ip_to_long(ip).alias("n"), ipf.safe_ip(ip).alias("safe"), ipf.ip_category(ip).alias("cat"), flt.valid_source(ip).alias("ok")
    )
    known = dict(C.KNOWN_IPS)
    trusted = ipaddress.ip_network(C.TRUSTED_SUBNETS[0])
    for row in df.collect():
        text, parsed = cases[row.i], parse(cases[row.i])
        assert row.n == (None if parsed is None else int(parsed)), text
        assert row.safe == ("<invalid_ip>" if parsed is None else text)
        if text in known:
            want = known[text]
        elif parsed is None:
            want = "Unknown/Invalid"
        elif parsed.is_loopback:
            want = "Localhost (Loopback)"
        elif parsed.is_private:
            want = "Local Network (Private)"
        elif parsed.is_multicast:
            want = "Multicast"
        else:
            want = "Public Internet"
        assert row.cat == want, text
        bad = parsed is None or parsed.is_loopback or parsed.is_link_local or parsed in trusted
        assert bool(row.ok) == (not bad), text


def test_bad_networks_are_skipped():
    assert ipf.leading_octets("10.0.0.1/8") is None
    assert ipf.leading_octets("nonsense") is None
    assert ipf.leading_octets("172.16.0.0/12") == (2, [f"172.{i}" for i in range(16, 32)])
    assert ipf.leading_octets("192.0.0.170/31") == (4, ["192.0.0.170", "192.0.0.171"])


def test_outside_networks(spark):
    nets = ["10.0.0.0/8", "172.16.0.0/12", "203.0.113.128/25", "0.0.0.0/7", "10.1.1.1/8", "x"]
    cases = addresses()
    rows = [packet(i, i, ip) for i, ip in enumerate(cases)]
    subnets = spark.createDataFrame([(n,) for n in nets], "cidr string")
    real = [ipaddress.ip_network(n) for n in nets[:4]]
    want = {i for i, ip in enumerate(cases) if parse(ip) is None or not any(parse(ip) in n for n in real)}
    got = look.outside_networks(packets_df(spark, rows), subnets).select("packet_id").collect()
    assert {r.packet_id for r in got} == want


def test_label_training_ips(spark):
    ips = ["10.0.0.1", "127.0.0.1", None, "8.8.8.8", "bad", "169.254.0.1"]
    rows = [packet(i, 0, ip) for i, ip in enumerate(ips)]
    got = flt.label_training_ips(packets_df(spark, rows)).orderBy("packet_id").collect()
    assert [r.label for r in got] == ["10.0.0.1", "invalid_ip_0", "invalid_ip_1", "8.8.8.8", "invalid_ip_2", "invalid_ip_3"]


def test_ipv6_against_the_standard_library(spark):
    rng = random.Random(6)
    cases = ["::", "::1", "::1%eth0", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::g", ":::", "1::2::3", "::1.2.3.4"]
    cases += ["::ffff:127.0.0.1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "1:2:3:4:5:6:1.2.3.4", "fe80::1", "ff02::1", "::1%", "12345::"]
    cases += ["2001:3::1", "2001:20::1", "2001:1::1", "2001:db8::", "fd00::1", "4000::1", "64:ff9b:1::1", "100::1", "::256.1.1.1", None, "1:"]
    for _ in range(400):
        number = rng.getrandbits(128) >> rng.choice([0, 0, 0, 64, 100])
        cases.append(rng.choice([str, lambda a: a.exploded])(ipaddress.IPv6Address(number)))

    def want(text):
        try:
            a = ipaddress.IPv6Address(text)
        except ValueError:
            return (False, "Unknown/Invalid")
        a = a.ipv4_mapped or a
        known = dict(C.KNOWN_IPS).get(str(text))
        kinds = ((a.is_loopback, "Localhost (Loopback)"), (a.is_private, "Local Network (Private)"), (a.is_multicast, "Multicast"), (a.is_reserved, "Reserved"))
        return (True, known or next((name for yes, name in kinds if yes), "Public Internet"))

    df = spark.createDataFrame(list(enumerate(cases)), "i int, ip string")
    got = {r.i: (r.v, r.c) for r in df.select("i", ipf.is_ipv6(F.col("ip")).alias("v"), ipf.ip_category(F.col("ip")).alias("c")).collect()}
    skip = {i for i, c in enumerate(cases) if c and c.lower().startswith(("3fff", "2002"))}  # differ between library versions
    assert {i: got[i] for i in got if i not in skip} == {i: want(c) for i, c in enumerate(cases) if i not in skip}


def test_longest_networks_against_the_standard_library(spark):
    import random
    from ipaddress import ip_address, ip_network

    r = random.Random(4)
    texts = [str(ip_address(r.getrandbits(32))) for _ in range(60)]
    texts += [str(ip_address((0x20010DB8 << 96) | r.getrandbits(96))) for _ in range(60)]
    nets = ["0.0.0.0/0", "::/0", "::/64", "8.8.8.8", "2001:db8::", "10.0.0.1/8", "x", None, "1.2.3.4/33", "::/129"]
    for t in texts[::3]:
        bits = 32 if "." in t else 128
        for n in (r.randint(1, bits), r.choice([8, 16, 24, 32, 63, 64, 65, 127])):
            if n <= bits:
                nets.append(str(ip_network(f"{t}/{n}", strict=False)))
    odd = ["8.8.8.8", "2001:db8::", "::ffff:8.8.8.8", "fe80::1%eth0", "nothing", "", None, "8.8.8.8"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + odd)], "packet_id int, src_ip string")
    got = look.longest_networks(rows, spark.createDataFrame([(n,) for n in nets], "cidr string")).collect()

    def parsed(make, text):
        try:
            return make(text)
        except ValueError:
            return None

    known = {n: parsed(ip_network, n) for n in nets if n is not None}
    for row in got:
        a = None if row.src_ip is None else parsed(ip_address, row.src_ip)
        fits = [] if a is None else [(n.prefixlen, n) for n in known.values() if n is not None and n.version == a.version and a in n]
        want = max(fits, default=(None, None), key=lambda x: x[0])[1]
        assert (None if row.network is None else ip_network(row.network)) == want, row
    assert len(got) == len(texts) + len(odd)


def test_networks_by_broadcast_and_by_shuffle(spark, monkeypatch):
    nets = [("10.0.0.0/8",), ("10.1.0.0/16",), ("10.1.2.3",), ("2001:db8::/32",), ("2001:db8::ff:0/112",), ("::/0",), ("bad",)]
    texts = ["10.1.2.3", "10.1.2.4", "10.9.9.9", "11.0.0.1", "2001:db8::ff:1", "2001:DB8::1", "::ffff:10.1.2.3", "1::%eth", "x", None]
    rows = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts * 2)], "packet_id int, src_ip string, network0 string")
    subnets = spark.createDataFrame(nets, "cidr string")
    near, outside = look.longest_networks(rows, subnets), look.outside_networks(rows, subnets)
    # With a short list of networks the rows stay where they are.
    for df in (near, outside):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    got = [near.columns, sorted(near.collect(), key=str), outside.columns, sorted(outside.collect(), key=str)]
    assert {r.src_ip for r in got[3]} == {"11.0.0.1", "x", None}
    monkeypatch.setattr(look, "BROADCAST_NETWORKS", 3)
    near, outside = look.longest_networks(rows, subnets), look.outside_networks(rows, subnets)
    assert got == [near.columns, sorted(near.collect(), key=str), outside.columns, sorted(outside.collect(), key=str)]
