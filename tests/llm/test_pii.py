"""Personal data: basic spans against plain patterns, checks, context, and odd input."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from checks.compare import connect, rows_of
from quietwire.llm import pii, queries

SF = "/root/testdata/sf0.001"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    text, out = text or "", []
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    for order, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def base_hash(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base_spans(text)).encode()).hexdigest()


ODD = [
    "",
    None,
    "a@b.c+d@e.f x@y a@@b.c ..@-.- a@b.c.",
    "999.1.2.3.4 1.2.3.4.5.6.7.8 01.002.0255.3 256.1.1.1 1.1.1.1",
    "4845168114407329 4845168114407329",
    "4845-1681 1440-7329 and 4845  168114407329, 5 4845168114407329",
    "+1 (017) 555-7713 +1(2 +123456789 ++49 30 1234 5678-9 +1 2345678901234567",
    "é😀é 97.51.17.173 😀 a.b@c.de é",
    "card 1234567812345670 order 1234567812345670",
    "0" * 2000 + " a" + "b" * 2000 + "@",
    "7@x.y " * 3000,
    "+" * 2000 + "1 " * 2000 + "(" * 2000,
    "1.2.3.4 4845168114407329, " * 700,
]


def test_basic_spans_equal_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find_spans(df)).collect()}
    for i, text in enumerate(ODD):
        spans = base_spans(text)
        want = [sum(k == kind for _, _, k, _ in spans) for kind in ("email", "ip", "card", "phone")]
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == want, text and text[:60]
        assert got[i]["base_sha256"] == base_hash(text), text and text[:60]
        named = {f"{k}:{s}:{e}" for s, _, k, e in spans}
        assert named <= set(got[i]["spans"].split(","))


def test_long_runs_take_linear_time(spark):
    text = "0" * 1_000_000 + " a" + "b" * 1_000_000 + "@ 1.2.3.4"
    row = pii.digest(pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row["spans"] == f"ip:{len(text) - 7}:{len(text)}"


def test_basic_spans_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["base_sha256"] for r in queries.op13_pii(spark, SF).collect()}
    assert got == {k: base_hash(v) for k, v in texts.items()}


ADDED = [
    ("two cards 7536784127813050 4845168114407329 here", "card:10:26,card:27:43"),
    ("order 4845168114407329 1", ""),  # a chain of 17 digits; the run in it is lowered by "order"
    ("IBAN DE89 3704 0044 0532 0130 00.", "iban:5:32"),
    ("IBAN DE88 3704 0044 0532 0130 00.", ""),
    ("GB82WEST12345698765432", "iban:0:22"),
    ("ssn 123-45-6789", "ssn:4:15"),
    ("123-45-6789", ""),
    ("ssn 666-45-6789", ""),
    ("call (017) 555-7713", "phone:5:19"),
    ("item (017) 555-7713", ""),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret:9:49"),
    ('example token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', ""),
    ("token = aaaaaaaaaaaaaaaaaaaaaa", ""),
]


def test_added_spans_need_their_check_and_context(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(ADDED)], "doc_id long, text string")
    for row in pii.find_spans(df).collect():
        found = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row["spans"] if not s["base"])
        assert (row["text"], found) == ADDED[row["doc_id"]]


def test_context_moves_the_score(spark):
    texts = ["visa 4845168114407329", "4845168114407329", "invoice 4845168114407329"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = [r["spans"][0]["score"] for r in pii.find_spans(df).orderBy("doc_id").collect()]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 3
    assert all(r["spans"][0]["base"] for r in pii.find_spans(df).collect())


def test_odd_tables(spark, odd_documents):
    out = pii.find_spans(odd_documents)
    assert out.columns == [*odd_documents.columns, "spans"] and out.count() == odd_documents.count()
    again = out.withColumn("spans", F.lit("own"))
    assert pii.find_spans(again).columns == [*odd_documents.columns, "spans"]
    assert pii.digest(pii.find_spans(odd_documents.limit(0))).collect() == []


def test_only_native_functions_and_no_shuffle(spark):
    plan = queries.op13_pii(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_pii_equals_its_sql(spark):
    got = queries.op13_pii(spark, SF)
    cur = connect(SF).execute(pii.PII_SQL)
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())
