"""Jaccard join of word shingles, as a join in a metric space.

Documents with equal shingle sets are one class. Classes meet in three steps, each exact:

1. *Singleton pivots.* Every shingle is a pivot set of its own; a class lies in the region of its
   rarest shingle, and its boundary window are the regions a set within the distance may lie in:
   its ``n - ceil(t * n) + l`` rarest shingles. (All unrelated texts are at a Jaccard distance of
   about 1 from each other and from any document, so that the triangle inequality alone cannot part them.)
   With ``l = 1 + n // MORE`` a linked pair meets ``l`` times, at places near the front of both windows; pairs
   that meet in small regions are counted, and members of larger regions are tied to one of them. Classes
   that are tied, or meet often enough, form clusters; no link leaves a cluster.
2. *Document pivots.* A cluster with more members than a task should hold is cut into Voronoi
   regions around some of its documents. A member also goes to the region of any pivot whose distance
   exceeds the one of its own pivot by at most twice the join distance (triangle inequality), so every linked
   pair meets in the region of one of the two. Regions that are still too large are cut again.
3. *Exact join.* Inside a region all intersections are counted. A region that no pivots can
   part (a family of near copies closer than twice the distance) is joined in pairs of bounded blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quietwire.llm.common import Words, chains, kept, slices
from quietwire.llm.components import components
from quietwire.llm.sketches import SLICES, in_sketch, merged, parts

SKETCH = 1 << 22
SMALL_REGION = 32
MORE = 20
MOST_MEMBERS = 256
PIVOTS = 16
DEPTH = 2
MOST_VISITS = 4.0


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle."""
    hashes = words.hash
    runs = chains(hashes, size)
    out = []
    for i in range(len(words.first) - 1):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def least_overlap(n: int, percent: int) -> int:
    """Smallest intersection of a set of ``n`` with any set that reaches the similarity."""
    return -(-n * percent // 100)


def least_common(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection of sets of ``n`` and ``m`` that reach the similarity."""
    return -(-(n + m) * percent // (100 + percent))


def _described(documents: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, class`` of every row; besides, per task, shingle counts by hash (``part, counts``)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.int32)
        name = None
        for batch in batches:
            name = batch.schema.field("doc_id").type
            for at, data, bounds in slices(batch.column("text")):
                sets = shingle_sets(Words(data, bounds), size)
                buckets, times = np.unique((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), return_counts=True)
                counts[buckets] += times.astype(np.int32)
                n = len(sets)
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(at, n),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) for s in sets], pa.binary()),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    names=["doc_id", "n", "class", "part", "counts"],
                )
        if name is not None:
            part = parts(np.minimum(counts, 0xFFFF).astype("<u2"))
            nulls = [pa.nulls(SLICES, t) for t in (name, pa.int64(), pa.binary())]
            yield pa.record_batch([*nulls, *part.columns], names=["doc_id", "n", "class", "part", "counts"])

    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, class binary, part int, counts binary"
    )


def _windows(documents: DataFrame, size: int, percent: int, order: np.ndarray) -> DataFrame:
    """``token, n, class, at``: each class in the regions of its window (copies in a task once), and the place there."""
    table = documents.sparkSession.sparkContext.broadcast(order)  # SKETCH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, met = table.value, set()
        for batch in batches:
            for _, data, bounds in slices(batch.column("text")):
                tokens, sizes, names, widths, places = [], [], [], [], []
                for s in shingle_sets(Words(data, bounds), size):
                    name = set_digest(s)
                    if not len(s) or name in met:
                        continue
                    met.add(name)
                    width = min(len(s), len(s) - least_overlap(len(s), percent) + 1 + len(s) // MORE)
                    at = np.argsort(rank[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")[:width]
                    tokens.append(s[at])
                    sizes.append(len(s))
                    names.append(name)
                    widths.append(width)
                    places.append(np.arange(width, dtype=np.int32))
                if names:
                    rows = np.repeat(np.arange(len(names)), widths)
                    yield pa.record_batch(
                        [
                            pa.array(np.concatenate(tokens).view(np.int64)),
                            pa.array(np.array(sizes, np.int32)[rows]),
                            pa.array(names, pa.binary()).take(pa.array(rows)),
                            pa.array(np.concatenate(places)),
                        ],
                        names=["token", "n", "class", "at"],
                    )

    return documents.select("text").mapInArrow(run, "token long, n int, class binary, at int")


def _meetings(windows: DataFrame, percent: int, ranges: int) -> DataFrame:
    """``a, b``: classes that may be linked, or are tied to others through a large region.

    Rows are dealt by ranges of (token, size, class), so a large region may span tasks. In the sorted rows a
    region also ends where the next size rules out all that came before. The first and the last region of a task,
    which may go on in another, count as large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        last = opened = None  # the last row's token and size, and the first class of its region
        large = True  # whether the region that goes on is known to be large
        held = None  # rows of a region that may go on, while it is small
        for batch in batches:
            if not batch.num_rows:
                continue
            token, n = batch.column("token").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            names = np.array(batch.column("class").to_pylist(), dtype=object)
            at = batch.column("at").to_numpy().astype(np.int64)
            if last is None:
                yield _ties([None], [names[0]], [here], [0], [int(token[0])], [int(n[0])])
            if held is not None:
                token, n, names, at = (np.concatenate([x, y]) for x, y in zip(held, (token, n, names, at), strict=True))
                last, held = None, None
                fresh = True
            else:
                fresh = last is None
            breaks = np.ones(len(token), dtype=bool)
            breaks[1:] = (token[1:] != token[:-1]) | (n[:-1] * 100 < n[1:] * percent)
            goes_on = not fresh and token[0] == last[0] and last[1] * 100 >= n[0] * percent
            starts = np.flatnonzero(breaks)
            sizes = np.diff(np.append(starts, len(token)))
            # The batch's last region waits for the next batch as long as it is small and not the task's first.
            many = sizes > SMALL_REGION
            if goes_on or large:
                many[0] = True
            large = bool(many[-1])
            upto = len(token)
            if not many[-1]:
                upto = int(starts[-1])
                held = tuple(x[upto:] for x in (token, n, names, at))
            region = np.repeat(np.arange(len(starts)), sizes)
            big = many[region]
            # Large regions: everything is tied to the first.
            first = np.empty(len(starts), dtype=object)
            first[:] = list(names[starts])
            if goes_on:
                first[0] = opened
            rows = np.flatnonzero(big & (first[region] != names))
            if len(rows):
                pairs = sorted(set(zip(first[region[rows]].tolist(), names[rows].tolist(), strict=True)))
                yield _pairs([x for x, _ in pairs], [y for _, y in pairs], np.zeros(len(pairs), np.int64))
            # Small regions: the pairs that meet near the front of both windows.
            some = np.flatnonzero(~big[:upto] & (sizes[region[:upto]] > 1))
            for lag in range(1, SMALL_REGION):
                x, y = some[:-lag], some[lag:]
                fit = region[x] == region[y]
                if not fit.any():
                    break
                x, y = x[fit], y[fit]
                fewer = 1 + np.minimum(n[x], n[y]) // MORE
                common = least_common(n[x], n[y], percent)
                near = (at[x] < n[x] - common + fewer) & (at[y] < n[y] - common + fewer) & (common <= np.minimum(n[x], n[y]))
                x, y, fewer = x[near], y[near], fewer[near]
                if len(x):
                    yield _pairs(names[x].tolist(), names[y].tolist(), fewer)
            last = (int(token[-1]), int(n[-1]))
            opened = first[-1]
        if held is not None:
            first = held[2][0]
            if len(held[2]) > 1:
                pairs = sorted({(first, y) for y in held[2].tolist() if y != first})
                yield _pairs([x for x, _ in pairs], [y for _, y in pairs], np.zeros(len(pairs), np.int64))
            opened, last = first, (int(held[0][-1]), int(held[1][-1]))
        if last is not None:
            yield _ties([None], [opened], [here], [1], [last[0]], [last[1]])

    rows = kept(
        windows.repartitionByRange(ranges, "token", "n", "class")
        .sortWithinPartitions("token", "n", "class")
        .mapInArrow(run, "a binary, b binary, least long, task int, side int, token long, n long"),
        "meetings",
    )
    # A region may go on in the next task: two rows for each task are looked at here.
    ends = sorted(rows.where("task is not null").collect(), key=lambda r: (r["task"], r["side"]))
    over = [
        (bytes(x["b"]), bytes(y["b"]))
        for x, y in zip(ends, ends[1:], strict=False)
        if x["side"] == 1 and y["side"] == 0 and x["token"] == y["token"] and x["n"] * 100 >= y["n"] * percent
    ]
    met = (
        rows.where("task is null")
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.count(F.lit(1)).alias("times"), F.min("least").alias("least"))
        .where(F.col("times") >= F.col("least"))
        .select("a", "b")
    )
    return met.unionByName(rows.sparkSession.createDataFrame(over, "a binary, b binary")) if over else met


_MET = ["a", "b", "least", "task", "side", "token", "n"]


def _ties(a, b, task, side, token, n) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(x, t) for x, t in zip((a, b, [None], task, side, token, n), kinds, strict=True)], names=_MET)


def _pairs(a: list[bytes], b: list[bytes], least: np.ndarray) -> pa.RecordBatch:
    k = len(a)
    empty = [pa.nulls(k, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64())]
    return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(least.astype(np.int64)), *empty], names=_MET)


def _member_sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``cluster, class, copies, shingles`` of the documents in ``wanted`` (``doc_id, ...``)."""
    maybe = in_sketch(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in slices(batch.column("text")):
                sets = shingle_sets(Words(data, bounds), size)
                part = batch.slice(at, len(sets)).drop_columns(["text"])
                yield pa.record_batch(
                    [*part.columns, pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=[*part.schema.names, "shingles"],
                )

    texts = documents.select("doc_id", "text").where(maybe)
    return (
        texts.join(wanted, "doc_id")
        .dropDuplicates(["class"])
        .select("cluster", "class", "copies", "text")
        .mapInArrow(run, "cluster binary, class binary, copies long, shingles binary")
    )


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets with all others, over the shingles both sides hold."""
    out = np.zeros((len(sets), len(others)), dtype=np.int64)
    one, two = np.concatenate(sets), np.concatenate(others)
    common = np.intersect1d(one, two)
    if not len(common):
        return out
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (sets, others)]
    at = [np.searchsorted(common, x) for x in (one, two)]
    hit = [common[np.minimum(a, len(common) - 1)] == x for a, x in zip(at, (one, two), strict=True)]
    for lo in range(0, len(common), 4096):
        m = []
        for side, x in enumerate((sets, others)):
            mine = hit[side] & (at[side] >= lo) & (at[side] < lo + 4096)
            y = np.zeros((len(x), min(4096, len(common) - lo)), dtype=np.float32)
            y[rows[side][mine], at[side][mine] - lo] = 1
            m.append(y)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def _linked(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    same = _overlaps(sets, others)
    total = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in others])[None, :] - same
    return 100 * same >= percent * total


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``links`` (square, symmetric) connects."""
    seen, out = np.zeros(len(links), dtype=bool), []
    for start in range(len(links)):
        if seen[start]:
            continue
        seen[start], stack = True, [start]
        while stack:
            x = stack.pop()
            for y in np.flatnonzero(links[x] & ~seen):
                seen[y] = True
                out.append((x, int(y)))
                stack.append(int(y))
    return out


_FOUND = "a binary, b binary, class binary, links long"


def _found(edges: list[tuple[bytes, bytes]], names: list[bytes], counts: list[int]) -> pa.RecordBatch:
    k, n = len(edges), len(names)
    return pa.record_batch(
        [
            pa.array([e[0] for e in edges] + [None] * n, pa.binary()),
            pa.array([e[1] for e in edges] + [None] * n, pa.binary()),
            pa.array([None] * k + names, pa.binary()),
            pa.array([None] * k + counts, pa.int64()),
        ],
        names=["a", "b", "class", "links"],
    )


def _join_groups(members: DataFrame, percent: int) -> DataFrame:
    """Links inside each group: ``a, b`` that connect what is linked, and ``class, links`` counts.

    Input: ``groups, class, copies, home, shingles``, at most a bounded number of rows a group. ``home``
    tells a group's own members from visitors. A pair of visitors is not looked at, and a pair
    that also meets at the visitor's home is counted in the lesser group alone.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["groups"] != held[0]["groups"]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, names, counts = [], [], []
        for rows in groups(batches):
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
            links = _linked(sets, sets, percent)
            np.fill_diagonal(links, False)
            key, homes = rows[0]["groups"], [r["home"] for r in rows]
            own = np.array([h == key for h in homes])
            links &= own[:, None] | own[None, :]
            edges += [(rows[x]["class"], rows[y]["class"]) for x, y in _forest(links)]
            late = np.array([h < key for h in homes])  # counted at the visitor's home
            links &= ~(late[:, None] | late[None, :])
            weight = links @ np.array([r["copies"] for r in rows])
            for i in np.flatnonzero(weight):
                names.append(rows[i]["class"])
                counts.append(int(weight[i]))
            if len(edges) + len(names) > 10_000:
                yield _found(edges, names, counts)
                edges, names, counts = [], [], []
        yield _found(edges, names, counts)

    return (
        members.select("groups", "class", "copies", "home", "shingles")
        .repartition("groups")
        .sortWithinPartitions("groups", "class")
        .mapInArrow(run, _FOUND)
    )


def _voronoi(
    members: DataFrame, sizes: DataFrame, percent: int, pivots: int, salts: int, trial: bool = False
) -> DataFrame:
    """Members of large groups dealt to the regions of pivots: their own, and those of the window.

    A region's name is its group's and 8 bytes, so that names of one level order their subregions alike. With
    ``trial``, only a few members of each group are dealt, and ``groups, visits`` comes back: the
    mean number of regions a member goes to.
    """
    spread = F.xxhash64("class", "groups")
    all_ = members.join(sizes, "groups")
    drawn = (
        all_.where(F.pmod(spread, F.greatest(F.col("size") / (2 * pivots), F.lit(1)).cast("long")) == 0)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .withColumn("rank", F.lit(0))
    )
    if trial:
        all_ = all_.where(F.pmod(F.xxhash64("groups", "class", F.lit(1)), F.greatest(F.col("size") / 64, F.lit(1)).cast("long")) == 0)
    dealt = all_.withColumn("salt", F.pmod(spread, F.lit(salts)).cast("int")).withColumn("rank", F.lit(1))
    near = 2 * (100 - percent) / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, group, names, sets = None, None, [], []

        def settle(waiting: list[dict]) -> Iterator[tuple[dict, bytes, list[bytes]]]:
            keys = [group + hashlib.blake2b(n, digest_size=8).digest() for n in names] or [group + bytes(8)]
            if names:
                mine = [np.frombuffer(r["shingles"], np.uint64) for r in waiting]
                same = _overlaps(mine, sets)
                total = np.array([len(s) for s in mine])[:, None] + np.array([len(s) for s in sets])[None, :] - same
                gap = 1 - same / np.maximum(total, 1)
            else:
                gap = np.zeros((len(waiting), 1))
            window = gap <= gap.min(axis=1)[:, None] + near
            for row, nearest, there in zip(waiting, gap.argmin(axis=1), window, strict=True):
                # A visitor stays one in every region below.
                home = keys[nearest] if row["home"] == row["groups"] else row["home"]
                yield row, home, [keys[j] for j in np.flatnonzero(there)]

        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("groups", "class", "copies", "home", "shingles")}
            waiting: list[dict] = []
            for row in [*batch.to_pylist(), None]:
                if waiting and (row is None or row["groups"] != group or row["rank"] == 0 or len(waiting) >= 512):
                    for old, home, keys in settle(waiting):
                        for key in [old["groups"]] if trial else keys:
                            out["groups"].append(key)
                            out["home"].append(home)
                            out["class"].append(old["class"])
                            out["copies"].append(len(keys) if trial else old["copies"])
                            out["shingles"].append(b"" if trial else old["shingles"])
                    waiting = []
                if row is None:
                    break
                if (row["groups"], row["salt"]) != place:
                    place, group, names, sets = (row["groups"], row["salt"]), row["groups"], [], []
                if row["rank"] == 0:
                    names.append(row["class"])
                    sets.append(np.frombuffer(row["shingles"], np.uint64))
                else:
                    waiting.append(row)
            kinds = {"copies": pa.int64()}
            yield pa.record_batch([pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()], names=list(out))

    columns = ["groups", "salt", "rank", "class", "copies", "home", "shingles"]
    found = (
        drawn.select(columns)
        .unionByName(dealt.select(columns))
        .repartition("groups", "salt")
        .sortWithinPartitions("groups", "salt", "rank", "class")
        .mapInArrow(run, "groups binary, class binary, copies long, home binary, shingles binary")
    )
    return found.groupBy("groups").agg(F.avg("copies").alias("visits")) if trial else found


def _join_blocks(members: DataFrame, sizes: DataFrame, percent: int, most: int) -> DataFrame:
    """Links inside groups of any size: every pair of their blocks is a group of its own."""
    blocks = F.greatest(F.ceil(F.col("size") / (most / 2)), F.lit(1)).cast("int")
    dealt = members.join(sizes, "groups").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    )
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "pair",
        F.unhex(
            F.sha2(
                F.concat(
                    F.col("groups"),
                    F.encode(
                        F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other")), "utf-8"
                    ),
                ),
                256,
            )
        ),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["pair"] != held[0]["pair"]:
                    yield joined(held)
                    held = []
                held.append(row)
        if held:
            yield joined(held)

    def joined(rows: list[dict]) -> pa.RecordBatch:
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        links = _linked(sets, sets, percent)
        np.fill_diagonal(links, False)
        block = np.array([r["block"] for r in rows])
        key = rows[0]["groups"]
        own = np.array([r["home"] == key for r in rows])
        late = np.array([r["home"] < key for r in rows])
        links &= own[:, None] | own[None, :]
        if any(r["block"] != r["other"] for r in rows):
            links &= block[:, None] != block[None, :]  # the blocks themselves are other pairs
        edges = [(rows[x]["class"], rows[y]["class"]) for x, y in _forest(links)]
        weight = (links & ~(late[:, None] | late[None, :])) @ np.array([r["copies"] for r in rows])
        some = np.flatnonzero(weight)
        return _found(edges, [rows[i]["class"] for i in some], [int(weight[i]) for i in some])

    return (
        pairs.select("pair", "groups", "block", "other", "class", "copies", "home", "shingles")
        .repartition("pair")
        .sortWithinPartitions("pair", "class")
        .mapInArrow(run, _FOUND)
    )


def jaccard_components(
    documents: DataFrame,
    words: int = 5,
    percent: int = 80,
    most_members: int = MOST_MEMBERS,
    pivots: int = PIVOTS,
    depth: int = DEPTH,
    most_visits: float = MOST_VISITS,
) -> DataFrame:
    """Components of documents whose distinct ``words``-word shingles reach a Jaccard of ``percent`` %.

    Input: ``doc_id, text``; other columns are not read. Returns one row per input row: ``doc_id,
    n_shingles, component_id`` (least doc_id reachable by links, itself included) and ``n_links``
    (documents it is linked with, copies included).

    A text with fewer words is one shingle; null and empty texts have none, are linked with nothing and are
    components of their own. Rows of one id with equal texts are copies; null ids take part, but
    name a component only if nothing else does. No rows give no rows. Runs jobs.
    """
    spark = documents.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = kept(_described(documents, words), "sets")
    described = both.where("part is null").select("doc_id", "n", "class")
    order = merged(both.where("part is not null").select("part", "counts"), add=True)
    if not len(order):
        order = np.zeros(SKETCH, "<u4")
    windows = kept(_windows(documents, words, percent, order), "windows")
    clusters = components(_meetings(windows, percent, ranges))
    clusters = kept(clusters.select(F.col("node").alias("class"), F.col("component").alias("cluster")), "clusters")
    classes = described.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    wanted = kept(clusters.join(classes, "class"), "wanted")
    members = _member_sets(documents, wanted, words).select(
        F.col("cluster").alias("groups"), "class", "copies", F.col("cluster").alias("home"), "shingles"
    )
    found = None
    salts = max(2, ranges // 4)
    for level in range(depth + 1):
        members = kept(members, "members")
        sizes = members.groupBy("groups").agg(F.count(F.lit(1)).alias("size"))
        large = kept(sizes.where(F.col("size") > most_members), "large")
        small = _join_groups(members.join(large.select("groups"), "groups", "left_anti"), percent)
        found = small if found is None else found.unionByName(small)
        if large.isEmpty():
            break
        # Pivots that send a member to most regions part nothing: such a group is joined in blocks.
        visits = _voronoi(members, large, percent, pivots, salts, trial=True)
        part = kept(
            large.join(visits, "groups", "left").withColumn(
                "cut", (F.lit(level < depth) & (F.coalesce("visits", F.lit(0.0)).between(0.5, most_visits)))
            ),
            "cut",
        )
        whole, cut = part.where(~F.col("cut")).select("groups", "size"), part.where("cut").select("groups", "size")
        found = found.unionByName(_join_blocks(members, whole, percent, most_members))
        if cut.isEmpty():
            break
        members = _voronoi(members, cut, percent, pivots, salts)
    found = kept(found, "found")
    linked = components(found.where("a is not null").select("a", "b"))
    counts = found.where("class is not null").groupBy("class").agg(F.sum("links").alias("links"))
    named = (
        classes.join(linked.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    heads = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    told = (
        named.join(heads, "component")
        .join(counts, "class", "left")
        .select(
            F.col("class").alias("__class"),
            "component_id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    return described.join(told, (F.col("class") == F.col("__class")) & (F.col("n") > 0), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80, **options) -> DataFrame:
    """One document of each component, the one with the least id, with all columns.

    Texts without words are linked with nothing and stay; of rows with one id one stays; rows without an id stay.
    """
    found = jaccard_components(documents, words, percent, **options).where(F.col("doc_id").isNotNull())
    doubtful = kept(
        found.groupBy("doc_id")
        .agg(F.max("component_id").alias("__head"), F.count(F.lit(1)).alias("__rows"))
        .where((F.col("__head") != F.col("doc_id")) | (F.col("__rows") > 1))
        .withColumnRenamed("doc_id", "__id"),
        "doubtful",
    )
    marked = documents.withColumn("__maybe", in_sketch(doubtful.select(F.col("__id").alias("doc_id")), "doc_id"))
    some = marked.where("__maybe").join(doubtful, F.col("doc_id") == F.col("__id"), "left")
    clear = some.where(F.col("__id").isNull())
    heads = some.where(F.col("__head") == F.col("doc_id")).dropDuplicates(["doc_id"])
    out = marked.where(~F.col("__maybe")).drop("__maybe")
    return out.unionByName(clear.select(*documents.columns)).unionByName(heads.select(*documents.columns))
