from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quietwire import config as C
from quietwire.functions import payload as pay, text as txt

BENIGN = [b"", None, bytes(range(256)), bytes(3000), b"a plain line of words, and one more", b"union of two selections"]


def surrounded(rng: random.Random, pattern: str) -> tuple[bytes, str]:
    """A payload that holds the pattern in mixed case, and the longest pattern that is in it."""
    mixed = "".join(rng.choice([c.upper(), c.lower()]) for c in pattern)
    fill = lambda: bytes(rng.choices(b"0123456789 _%\xff\x00", k=rng.randint(0, 2500)))
    payload = fill() + mixed.encode() + fill()
    held = [p for p in C.MALICIOUS_PATTERNS if p.lower().encode() in payload.lower()]
    return payload, max(held, key=len)


def test_patterns(spark):
    rng = random.Random(8)
    cases = [surrounded(rng, p) for p in C.MALICIOUS_PATTERNS for _ in range(3)]
    rows = list(enumerate([c[0] for c in cases] + BENIGN))
    df = spark.createDataFrame(rows, "i int, p binary").select("i", pay.malicious_pattern(F.col("p")).alias("m"))
    got = {r.i: r.m for r in df.collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]
    assert all(got[len(cases) + i] is None for i in range(len(BENIGN)))


def test_pattern_scan_stays_native(spark):
    df = spark.createDataFrame([(b"x",)], "p binary").select(pay.malicious_pattern(F.col("p")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def entropy(data: bytes) -> float:
    return -sum(p * math.log2(p) for p in (data.count(bytes([b])) / len(data) for b in set(data)))


def test_entropy(spark):
    rng = random.Random(1)
    cases = [bytes(range(256)), b"A" * 100, b"", None, b"ab", bytes(5)]
    cases += [bytes(rng.choices(range(256), k=rng.randint(1, 3000))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, p binary").repartition(3)
    got = {r.i: r.e for r in df.select("i", pay.byte_entropy(F.col("p")).alias("e")).collect()}
    assert got[0] == 8.0 and got[1] == 0.0 and got[2] == 0.0 and got[3] == 0.0 and got[5] == 0.0
    for i, data in enumerate(cases):
        if data:
            assert got[i] == pytest.approx(entropy(data), abs=1e-12)


def test_payload_stats(spark):
    cases = [b"abc\x00\x00\xff", b"", None, b"x" * 1025, b"hello"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, p binary")
    got = {r.i: r.s for r in df.select("i", pay.payload_stats(F.col("p")).alias("s")).collect()}
    assert got[1] is None and got[2] is None and got[3].size == 1025
    assert (got[0].size, got[0].printable_chars, got[0].null_bytes) == (6, 3, 2)
    assert got[0].printable_ratio == 0.5 and got[4].printable_ratio == 1.0


def expected_redaction(text: str) -> str:
    for word in C.SENSITIVE_WORDS:
        text = re.sub(word + r"[=:]\s*\S+", "[REDACTED]", text, flags=re.IGNORECASE)
    return "".join(c if c.isprintable() else "?" for c in text)


def test_redact(spark):
    cases = [
        "password=secret123 done",
        "TOKEN: abc key:x secret=\ty auth=  z",
        "a" * 2000,
        "tab\tnewline\nzero\x00nbsp wide　zwsp​line ",
        "password= hidden emoji \U0001f600 ok",
        "monkey=banana",
        "",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: (r.a, r.b) for r in df.select("i", txt.redact(F.col("t")).alias("a"), txt.printable_only(F.col("t")).alias("b")).collect()}
    for i, text in enumerate(cases):
        assert got[i][0] == expected_redaction(text)
        assert got[i][1] == "".join(c if c.isprintable() else "?" for c in text)
    cut = df.where("i = 2").select(txt.redact(F.col("t"), 1000).alias("a"), txt.printable_only(F.col("t"), 50).alias("b"))
    assert [len(x) for x in cut.first()] == [1003, 50]


def test_target_port(spark):
    cases = ["to port 8080, which", "Port  22.", "no number", None, "port 99999999999 from"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: r.p for r in df.select("i", txt.target_port(F.col("t")).alias("p")).collect()}
    assert got == {0: 8080, 1: 22, 2: None, 3: None, 4: None}
