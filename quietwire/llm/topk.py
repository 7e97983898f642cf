"""Exact top-k inner products by ball trees.

Vectors are dealt to shards of bounded size; a shard is indexed as a ball tree (centre and radius
per node). A block of queries visits the nodes of a shard by descending upper bound of the inner
product, ``q.centre + |q| * radius``, and skips nodes whose bound is below a query's k-th score.
Every block first searches one shard; the k-th scores found there are the bounds the block
carries to all other shards. Those are dealt to columns of some shards each: a column takes every block
of queries once, and the k-th scores rise from one of its shards to the next.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quietwire.llm.common import kept, kept_packed

SHARD_ROWS = 4096
BLOCK_QUERIES = 256
LEAF_ROWS = 64
SCALE = 1024
COLUMNS = 64
"""Columns of shards (no more than there are shards) while a column's vectors and a group's queries are below ``GROUP_BYTES``."""
GROUP_BYTES = 32 << 20
SLICE_QUERIES = 4096
LOWEST = np.iinfo(np.int64).min
HIGHEST = float(1 << 53)
SHORT = float(1 << 24) * 0.999


def packed(whole: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes (2, 4 or 8) that hold the largest of them."""
    most = np.abs(whole).max(initial=0)
    return whole.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def unpacked(data: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (dim * rows)}").reshape(rows, dim)


def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, dim, vector``: components as floor(scale * x), packed as whole numbers of 2, 4 or 8 bytes.

    Rows whose vector is null, empty, or holds a null or a non-finite component are left out; so are
    rows without an id. A component beyond the range of 53 bits is an error.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column("embedding"), batch.column("vec_id")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum()))
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            there = np.array(column.is_valid()) & np.array(ids.is_valid())
            keep, dims, vectors = [], [], []
            for i in np.flatnonzero(there & (sizes > 0)):
                x = values[bounds[i] : bounds[i + 1]]
                if np.isfinite(x).all():
                    whole = np.floor(x * scale)
                    if np.abs(whole).max() >= HIGHEST:
                        raise ValueError("a component is too large for exact scores")
                    keep.append(i)
                    dims.append(len(whole))
                    vectors.append(packed(whole))
            yield pa.record_batch(
                [
                    ids.take(pa.array(keep, pa.int64())),
                    pa.array(dims, pa.int32()),
                    pa.array(vectors, pa.binary()),
                ],
                names=["vec_id", "dim", "vector"],
            )

    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(pack, "vec_id long, dim int, vector binary")


def ball_tree(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, ...]:
    """Order of the rows, and per node: first row, last row, left child (0: a leaf), centre, radius."""
    order = np.arange(len(vectors))
    points = vectors.astype(np.float64)
    first, last, left, centres, radii = [0], [len(vectors)], [0], [], []
    at = 0
    while at < len(first):
        a, b = first[at], last[at]
        rows = points[order[a:b]]
        centre = rows.mean(axis=0)
        gaps = ((rows - centre) ** 2).sum(axis=1)
        centres.append(centre)
        radii.append(np.sqrt(gaps.max()))
        if b - a > leaf_rows and gaps.max() > 0:
            # Split along the line between two far points, at the median.
            one = rows[gaps.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            along = rows @ (other - one)
            order[a:b] = order[a:b][np.argsort(along, kind="stable")]
            left[at] = len(first)
            middle = (a + b) // 2
            first += [a, middle]
            last += [middle, b]
            left += [0, 0]
        at += 1
    return order, np.array(first), np.array(last), np.array(left), np.array(centres), np.array(radii)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; an error where they could pass 63 bits."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1]
    if most < HIGHEST:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most >= float(1 << 62):
        raise ValueError("inner products pass 63 bits")
    return q.astype(np.int64) @ v.astype(np.int64).T


def search(tree: dict, names: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (queries x k) of the best rows of one shard; LOWEST where there is none.

    ``bound``: scores that a row must reach, per query (k-th scores known so far).
    """
    best = np.full((len(q), k), LOWEST, np.int64)
    best_ids = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    kth = bound.copy()
    points = q.astype(np.float64)
    norms = np.sqrt((points**2).sum(axis=1))
    vectors = tree["vectors"].astype(np.float64)
    longest = norms.max(initial=0) * np.sqrt((vectors**2).sum(axis=1).max(initial=0))
    # No sum of some of the products passes the product of the norms: below SHORT single precision is exact.
    short = longest < SHORT
    if short:
        points, vectors = points.astype(np.float32), vectors.astype(np.float32)
    uppers = q.astype(np.float64) @ tree["centre"].T + norms[:, None] * tree["radius"]
    uppers += 1 + np.abs(uppers) * 1e-9  # above any rounding

    def push(node: int, rows: np.ndarray) -> None:
        bounds = uppers[rows, node]
        alive = bounds >= kth[rows]
        if alive.any():
            heapq.heappush(heap, (-bounds[alive].max(), node, rows[alive], bounds[alive]))

    heap: list = []
    push(0, np.arange(len(q)))
    while heap:
        _, node, rows, bounds = heapq.heappop(heap)
        rows = rows[bounds >= kth[rows]]
        if not len(rows):
            continue
        if child := int(tree["left"][node]):
            push(child, rows)
            push(child + 1, rows)
            continue
        a, b = tree["first"][node], tree["last"][node]
        ids = tree["ids"][a:b]
        scores = points[rows] @ vectors[a:b].T if short else products(q[rows], tree["vectors"][a:b])
        better = scores.max(axis=1) >= kth[rows]
        if not better.any():
            continue
        rows, scores = rows[better], scores[better].astype(np.int64)
        scores[names[rows][:, None] == ids[None, :]] = LOWEST
        all_scores = np.concatenate([best[rows], scores], axis=1)
        all_ids = np.concatenate([best_ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        top = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]  # ~s falls as s rises
        best[rows] = np.take_along_axis(all_scores, top, axis=1)
        best_ids[rows] = np.take_along_axis(all_ids, top, axis=1)
        kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
    return best_ids, best


_TREE = "dim int, shard int, ids binary, vectors binary, first binary, last binary, left binary, centre binary, radius binary"


def index(vectors: DataFrame, shards: int) -> DataFrame:
    """One row per shard and dimension, with its ball tree. Rows are dealt by ``number``: ids may repeat."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        v = np.stack([unpacked(x, dim, 1)[0] for x in table["vector"].to_pylist()]).astype("<i8")
        order, first, last, left, centre, radius = ball_tree(v)
        row = {"dim": [dim], "shard": [key[1].as_py()], "ids": [table["vec_id"].to_numpy()[order].tobytes()]}
        row |= {"vectors": [packed(v[order])], "first": [first.tobytes()], "last": [last.tobytes()]}
        row |= {"left": [left.tobytes()], "centre": [centre.tobytes()], "radius": [radius.tobytes()]}
        kinds = {"dim": pa.int32(), "shard": pa.int32()}
        return pa.table({k: pa.array(x, kinds.get(k, pa.binary())) for k, x in row.items()})

    return (
        vectors.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int"))
        .groupBy("dim", "shard")
        .applyInArrow(build, _TREE)
    )


def _tree(row: dict, dim: int) -> dict:
    tree = {n: np.frombuffer(row[n], np.int64) for n in ("first", "last", "left", "ids")}
    tree["vectors"] = unpacked(row["vectors"], dim, len(tree["ids"]))
    tree["centre"] = np.frombuffer(row["centre"], np.float64).reshape(-1, dim)
    return tree | {"radius": np.frombuffer(row["radius"], np.float64)}


def _rows(names: np.ndarray, numbers: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    real = scores > LOWEST
    found = [np.repeat(numbers, real.sum(axis=1)), np.repeat(names, real.sum(axis=1)), ids[real], scores[real]]
    return pa.table([pa.array(x, pa.int64()) for x in found], names=["number", "query_id", "vec_id", "score"])


_FOUND = "number long, query_id long, vec_id long, score long"
_BLOCK = "dim int, block int, names binary, numbers binary, queries binary"


def blocks_of(asked: DataFrame, blocks: int) -> DataFrame:
    """The query rows in blocks of one dimension, one row each."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        q = np.stack([unpacked(x, dim, 1)[0] for x in table["vector"].to_pylist()]).astype("<i8")
        row = [[dim], [key[1].as_py()], [table["vec_id"].to_numpy().tobytes()], [table["number"].to_numpy().tobytes()], [packed(q)]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = ["dim", "block", "names", "numbers", "queries"]
        return pa.table([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=names)

    block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")
    return asked.withColumn("block", block).groupBy("dim", "block").applyInArrow(build, _BLOCK)


def _searched_first(pairs: DataFrame, k: int) -> DataFrame:
    """Every block with the best rows (``ids``, ``scores``, k for each query) of one shard, or with none where there is no shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                names = np.frombuffer(x["names"], np.int64)
                scores = np.full((len(names), k), LOWEST, np.int64)
                ids = np.zeros((len(names), k), np.int64)
                if x["ids"] is not None:
                    q = unpacked(x["queries"], x["dim"], len(names))
                    ids, scores = search(_tree(x, x["dim"]), names, q, np.full(len(q), LOWEST, np.int64), k)
                part = batch.slice(row, 1).select(["dim", "block", "shard", "names", "numbers", "queries"])
                more = [pa.array([y.tobytes()], pa.binary()) for y in (ids, scores)]
                yield pa.record_batch([*part.columns, *more], names=[*part.schema.names, "ids", "scores"])

    return pairs.mapInArrow(run, "dim int, block int, shard int, names binary, numbers binary, queries binary, ids binary, scores binary")


def _found_first(searched: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, numbers, ids, scores = (np.frombuffer(batch.column(n)[row].as_py(), np.int64) for n in ("names", "numbers", "ids", "scores"))
                yield from _rows(names, numbers, ids.reshape(-1, k), scores.reshape(-1, k)).to_batches()

    return searched.select("names", "numbers", "ids", "scores").mapInArrow(run, _FOUND)


def _searched(asked: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """Best rows of every query in every column, without the shard it was first searched in."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        empty = np.zeros((0, k), np.int64)
        found = [_rows(empty[:, 0], empty[:, 0], empty, empty)]
        dim = key[0].as_py()
        names = np.frombuffer(b"".join(left["names"].to_pylist()), np.int64)
        if not len(names) or not right.num_rows:
            return found[0]
        numbers = np.frombuffer(b"".join(left["numbers"].to_pylist()), np.int64)
        sizes = [len(x) // 8 for x in left["names"].to_pylist()]
        home = np.repeat(left["shard"].to_numpy(), sizes)
        q = np.concatenate([unpacked(x, dim, n) for x, n in zip(left["queries"].to_pylist(), sizes, strict=True)])
        bound = np.frombuffer(b"".join(left["scores"].to_pylist()), np.int64).reshape(-1, k)[:, k - 1]
        for at in range(0, len(q), SLICE_QUERIES):
            part = slice(at, at + SLICE_QUERIES)
            kth = bound[part].copy()
            scores = np.full((len(kth), k), LOWEST, np.int64)
            ids = np.full((len(kth), k), np.iinfo(np.int64).max, np.int64)
            for row in right.sort_by("shard").to_batches(max_chunksize=1):
                x = row.to_pylist()[0]
                rows = np.flatnonzero(home[part] != x["shard"])
                if not len(rows):
                    continue
                more_ids, more = search(_tree(x, dim), names[part][rows], q[part][rows], kth[rows], k)
                some = more[:, 0] > LOWEST
                rows, more_ids, more = rows[some], more_ids[some], more[some]
                all_scores = np.concatenate([scores[rows], more], axis=1)
                all_ids = np.concatenate([ids[rows], more_ids], axis=1)
                top = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
                scores[rows] = np.take_along_axis(all_scores, top, axis=1)
                ids[rows] = np.take_along_axis(all_ids, top, axis=1)
                kth[rows] = np.maximum(kth[rows], scores[rows, k - 1])
            found.append(_rows(names[part], numbers[part], ids, scores))
        return pa.concat_tables(found)

    keys = ("dim", "line", "column")
    return asked.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(run, _FOUND)


def top_k(
    candidates: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every query row.

    Input: ``vec_id, embedding``. Queries are the rows where ``is_query`` (over ``vec_id``) holds;
    candidates are all rows but those with the query's id. Ties go to the smaller id; a repeated candidate row counts again,
    a repeated query row is answered again. Vectors of other lengths than the query's don't count.
    See :func:`whole_vectors` for rows that take no part. No rows give no rows. Runs jobs.
    """
    vectors = kept(whole_vectors(candidates, scale).withColumn("number", F.monotonically_increasing_id()), "vectors")
    sizes = [F.count(F.lit(1)), F.coalesce(F.sum(F.length("vector")), F.lit(0))]
    rows, row_bytes = vectors.agg(*sizes).first()
    shards = max(1, -(-rows // shard_rows))
    columns = min(shards, max(COLUMNS, -(-row_bytes // GROUP_BYTES)))
    trees = kept_packed(index(vectors, shards), "trees")
    asked = vectors.where(is_query)
    total, asked_bytes = asked.agg(*sizes).first()
    lines = max(1, -(-asked_bytes // GROUP_BYTES))
    dealt = kept_packed(blocks_of(asked, max(1, -(-total // block_queries))), "queries")
    # Neither side is broadcast: a row is a shard or a block, and Spark's estimates don't see that explode() repeats them.
    home = dealt.withColumn("shard", F.pmod(F.col("block"), F.lit(shards)).cast("int"))
    first = kept_packed(_searched_first(home.join(trees.hint("merge"), ["dim", "shard"], "left"), k), "first")
    every_column, every_line = F.sequence(F.lit(0), F.lit(columns - 1)), F.sequence(F.lit(0), F.lit(lines - 1))
    rest = first.select(
        "dim",
        F.pmod("block", F.lit(lines)).alias("line"),
        F.explode(every_column).alias("column"),
        *("shard", "names", "numbers", "queries", "scores"),
    )
    targets = trees.withColumn("column", F.pmod("shard", F.lit(columns))).withColumn("line", F.explode(every_line))
    every = _found_first(first, k).unionByName(_searched(rest, targets, k))
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return (
        every.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
