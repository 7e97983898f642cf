"""The Merkle manifest against a plain tree, and on odd input."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from checks.compare import connect, rows_of
from quietwire.llm import merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def proofs(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The last node, and for each of ``nodes`` what stands left and right of it on each level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            paths[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        place = [p // 16 for p in place]
    return nodes[0], paths


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [proofs([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order]
    root, above = proofs([t[0] for t in trees])
    out = []
    for s, (subroot, paths), upper in zip(order, trees, above, strict=True):
        for (_, _, own, row), path in zip(sorted(by_source[s], key=lambda x: x[:3]), paths, strict=True):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None
            lower = None if row[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
            folded = leaf(row[0], lower, *row[2:]) if tampered else own
            for left, right in path + upper:
                folded = digest(left, folded, right)
            proof = digest(*[x for pair in path + upper for x in pair])
            out.append((str(row[0]), own, subroot, root, proof, folded, folded == root))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS run", "1 AS tree", "2 AS at", "3 AS g", "'y' AS leaf")
    found = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    return sorted((str(r[0]), *r[1:]) for r in found)


def test_trees_of_many_sizes_and_odd_rows(spark):
    rows, k = [], 0
    for source, n in ((None, 3), ("", 1), ("A", 16), ("a", 17), ("é", 2), ("hot", 600), ("b", 257)):
        for _ in range(n):
            rows.append((k, f"Text {k} É", "en", source, k))
            k += 1
    rows += [(None, None, None, None, None), (None, "", None, "hot", 0), (5, "Again", "de", "hot", 1)]
    rows += [(5, "Again", "de", "hot", 1), (7, None, "de", "hot", None), (-3, "X" * 200_000, "de", "hot", 9)]
    rows += [(1000 + i, "One each", None, f"s{i}", 1) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_one_leaf_one_source_and_none(spark):
    assert run(spark, [(1, "a", None, None, 1)]) == brute([(1, "a", None, None, 1)])
    few = [(i, "Ab", "en", "s", 2) for i in range(20)]
    assert run(spark, few) == brute(few)
    assert run(spark, []) == []


def test_hot_nodes_are_stored_once_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 32)
    rows = [(i, f"Text {i}", "en", "hot" if i % 3 else f"s{i % 7}", i) for i in range(700)]
    assert run(spark, rows) == brute(rows)


def test_the_climb_is_a_recursive_query_that_keeps_the_session(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    anchors = spark.createDataFrame([(0, 0, "-1:0:0", [b"x"])], "run long, block long, node string, folded array<binary>")
    nodes = spark.createDataFrame(
        [("-1:0:0", 0, None, "x", b"", b"", True)],
        "id string, block long, parent string, digest string, left binary, right binary, subroot boolean",
    )
    climbed = merkle._climbing(anchors, nodes)
    assert "UnionLoop" in climbed._jdf.queryExecution().executedPlan().toString()
    assert tuple(climbed.first()) == (0, [b"x"], b"", "x", "x")
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_manifest_equals_its_sql(spark):
    got = queries.op12_merkle_manifest(spark, SF)
    cur = connect(SF).execute(merkle.MANIFEST_SQL)
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())
