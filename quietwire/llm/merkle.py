"""A Merkle tree over a table of documents, and proofs by climbing it with a recursive query.

Every document is a leaf. Leaves of a source, by id, are hashed in runs of 16, level by level, up to the source's
subroot; subroots, by source, are hashed the same way up to the root. All levels are stored as node rows linked to
their parents. A recursive query (``WITH RECURSIVE``) climbs from every leaf to the root, appends the siblings it meets
to the proof and folds the leaf's own, perhaps tampered, hash with them.

The leaves of a run meet the same nodes, so one row climbs for all (at most 16) of them. A node near the root is met by
all rows: node rows are stored once for each block of ``BLOCK`` leaves below them, and rows join the copy of their
block, so that no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quietwire.llm.common import kept
from quietwire.operators.ordering import null_safe_join

WIDTH = 16
BLOCK = 1024
UPPER = -1
"""Number of the tree over the subroots; the sources' trees count from 0."""

LEAF = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its length in bytes, a colon and its value."""
    parts = [
        F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-"))
        for x in fields
    ]
    return F.sha2(F.concat(*parts), 256)


def _numbered(leaves: DataFrame) -> DataFrame:
    """Adds ``tree`` (number of the source), ``n`` (its leaves), ``at`` (place in it) and ``g`` (place among all leaves).

    Leaves are range-partitioned by source, id and hash: a source of any size covers many runs, and each run is
    numbered on its own, from the sizes of those before it.
    """
    runs = kept(
        leaves.repartitionByRange("source", "doc_id", "leaf").withColumn("run", F.spark_partition_id()), "merkle-leaves"
    )
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    inside = Window.partitionBy("run").orderBy("source")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    def shifted(rows: DataFrame, size: Column, name: str) -> DataFrame:
        """Sums of ``size`` over all rows before, in the order of run and source."""
        totals = rows.groupBy("run").agg(F.sum(size).alias("_x"))
        totals = totals.select("run", F.coalesce(F.sum("_x").over(earlier), F.lit(0)).alias("_x"))
        return rows.join(totals, "run").select(
            *rows.columns, (F.col("_x") + F.coalesce(F.sum(size).over(before), F.lit(0))).alias(name)
        )

    parts = shifted(runs.groupBy("run", "source").agg(F.count("*").alias("size")), F.col("size"), "first")
    sources = parts.groupBy("source").agg(
        F.min("run").alias("run"), F.sum("size").alias("n"), F.min("first").alias("tree_first")
    )
    trees = shifted(sources, F.lit(1).cast("long"), "tree").drop("run")
    parts = null_safe_join(parts.drop("size"), trees, ["source"])
    place = F.row_number().over(Window.partitionBy("run", "source").orderBy("doc_id", "leaf")) - 1
    return null_safe_join(runs, parts, ["run", "source"]).select(
        "tree",
        "n",
        "doc_id",
        "leaf",
        "tampered",
        (place + F.col("first")).alias("g"),
        (place + F.col("first") - F.col("tree_first")).alias("at"),
    )


def _id(tree: Column | int, level: Column | int, at: Column) -> Column:
    part = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.concat_ws(":", part(tree), part(level), at)


def _count(n: Column, level: int) -> Column:
    """Nodes of a tree of ``n`` leaves on a level."""
    return F.ceil(n / float(WIDTH**level)).cast("long")


def _levels(nodes: DataFrame, leaves: int, level: int, top: Callable[[Column], Column]) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of all levels from ``level`` on, and the last node of each tree.

    ``nodes``: ``tree, n, at, digest, lo, hi`` (the places of its leaves) on that level, ``n`` counting the nodes of
    level 0. ``leaves``: the largest ``n``. ``top``: the link of a node whose parent is the last node of its tree.
    """
    stored, tops = [], []
    while True:
        alone = _count(F.col("n"), level) == 1
        tops.append(nodes.where(alone))
        if -(-leaves // WIDTH**level) <= 1:
            break
        runs = kept(
            nodes.where(~alone)
            .groupBy("tree", F.floor(F.col("at") / WIDTH).alias("parent"))
            .agg(
                F.max("n").alias("n"),
                F.sort_array(F.collect_list(F.struct("at", "digest", "lo", "hi"))).alias("nodes"),
            ),
            "merkle-level",
        )
        link = F.when(_count(F.col("n"), level + 1) == 1, top(F.col("tree"))).otherwise(
            _id(F.col("tree"), level + 1, F.col("parent"))
        )
        digests = F.col("nodes.digest")
        stored.append(
            runs.select("tree", "nodes", link.alias("link"), F.posexplode("nodes").alias("slot", "node")).select(
                _id(F.col("tree"), level, F.col("node.at")).alias("id"),
                F.col("link").alias("parent"),
                F.col("node.digest").alias("digest"),
                F.unhex(F.array_join(F.slice(digests, F.lit(1), F.col("slot")), "")).alias("left"),
                F.unhex(F.array_join(F.slice(digests, F.col("slot") + 2, F.lit(WIDTH)), "")).alias("right"),
                "node.lo",
                "node.hi",
            )
        )
        nodes = runs.select(
            "tree",
            "n",
            F.col("parent").alias("at"),
            F.sha2(F.array_join("nodes.digest", ""), 256).alias("digest"),
            F.array_min("nodes.lo").alias("lo"),
            F.array_max("nodes.hi").alias("hi"),
        )
        level += 1
    last = tops[0]
    for more in tops[1:]:
        last = last.unionByName(more)
    return stored, last


def _climbing(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """The recursive query: rows ``run, block, node, folded`` end with ``proof, subroot, root``.

    ``folded`` holds the hash of each leaf of the run after the last node met. Hashes travel as bytes, half as long as
    their hex text, which is what gets hashed.
    """
    spark = anchors.sparkSession
    anchors.createOrReplaceTempView("merkle_anchors")
    nodes.createOrReplaceTempView("merkle_nodes")
    return spark.sql(
        """
        WITH RECURSIVE climb(run, block, node, folded, proof, subroot, root) AS (
          SELECT run, block, node, folded, unhex(''), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM merkle_anchors
          UNION ALL
          SELECT c.run, c.block, n.parent,
            CASE WHEN n.parent IS NULL THEN c.folded
                 ELSE transform(c.folded, f -> unhex(sha2(lower(hex(concat(n.left, f, n.right))), 256))) END,
            concat(c.proof, n.left, n.right),
            CASE WHEN n.subroot THEN n.digest ELSE c.subroot END,
            n.digest
          FROM climb c JOIN merkle_nodes n ON n.id = c.node AND n.block = c.block)
        SELECT run, folded, proof, subroot, root FROM climb WHERE node IS NULL
        """
    )


def manifest(documents: DataFrame, tampered: Column) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what its leaf, tampered with or not, folds up to.

    ``tampered``: which documents get their ``A-Z`` lower-cased after the tree was built (null: not). Returns
    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A null field is hashed as ``-``, so it differs from an empty one; null ids come first in their source and a null
    source is a source of its own, before all others. Rows that share an id are ordered by their hash; equal rows are leaves of their own.
    An empty table has no leaves, hence no rows. Columns other than the hashed ones are not read. Runs jobs:
    leaves, levels and the climb are written to the shared scratch folder.
    """
    spark = documents.sparkSession
    lowered = leaf_hash(*[F.translate(c, CAPITALS, SMALL) if c == "text" else F.col(c) for c in LEAF])
    leaves = documents.select(
        "doc_id", "source", leaf_hash(*[F.col(c) for c in LEAF]).alias("leaf"), F.when(tampered, lowered).alias("tampered")
    )
    leaves = _numbered(leaves)
    # Runs of leaves, the first nodes above them, and what each leaf folds to there.
    members = F.transform(
        F.sort_array(F.collect_list(F.struct("g", "doc_id", "leaf", "tampered"))),
        lambda x: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), x["tampered"].alias("tampered")),
    )
    runs = kept(
        leaves.groupBy("tree", F.floor(F.col("at") / WIDTH).alias("at")).agg(
            F.max("n").alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi"), members.alias("leaves")
        ),
        "merkle-runs",
    )
    digests = F.col("leaves.leaf")
    first = runs.select(
        "tree",
        "n",
        "at",
        F.when(F.col("n") == 1, digests[0]).otherwise(F.sha2(F.array_join(digests, ""), 256)).alias("digest"),
        "lo",
        "hi",
    )
    largest, trees = runs.agg(F.max("n"), F.max("tree")).first()
    if largest is None:
        return runs.select(
            F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"),
            *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
            F.lit(True).alias("verified"),
        ).limit(0)
    to_subroot = lambda tree: _id(UPPER, 0, tree)
    below, subroots = _levels(first, largest, 1, to_subroot)
    subroots = kept(
        subroots.select(
            F.lit(UPPER).cast("long").alias("tree"),
            F.lit(trees + 1).cast("long").alias("n"),
            F.col("tree").alias("at"),
            "digest",
            "lo",
            "hi",
        ),
        "merkle-subroots",
    )
    height = 0
    while -(-(trees + 1) // WIDTH**height) > 1:
        height += 1
    root_id = f"{UPPER}:{height}:0"
    above, root = _levels(subroots, trees + 1, 0, lambda tree: F.lit(root_id))
    root = root.select(
        F.lit(root_id).alias("id"),
        F.lit(None).cast("string").alias("parent"),
        "digest",
        F.unhex(F.lit("")).alias("left"),
        F.unhex(F.lit("")).alias("right"),
        "lo",
        "hi",
    )
    nodes = root
    for level in [*below, *above]:
        nodes = nodes.unionByName(level)
    block = lambda place: F.floor(F.col(place) / BLOCK)
    nodes = kept(
        nodes.select(
            "id",
            F.explode(F.sequence(block("lo"), block("hi"))).alias("block"),
            "parent",
            "digest",
            "left",
            "right",
            F.col("id").startswith(f"{UPPER}:0:").alias("subroot"),
        ),
        "merkle-nodes",
    )
    others = lambda i: F.concat(
        F.array_join(F.slice(digests, F.lit(1), i), ""), F.array_join(F.slice(digests, i + 2, F.lit(WIDTH)), "")
    )
    own = lambda x: F.coalesce(x["tampered"], x["leaf"])
    step = lambda x, i: F.sha2(
        F.concat(
            F.array_join(F.slice(digests, F.lit(1), i), ""),
            own(x),
            F.array_join(F.slice(digests, i + 2, F.lit(WIDTH)), ""),
        ),
        256,
    )
    anchors = runs.select(
        F.col("lo").alias("run"),
        block("lo").alias("block"),
        F.when(F.col("n") <= WIDTH, to_subroot(F.col("tree"))).otherwise(_id(F.col("tree"), 1, F.col("at"))).alias("node"),
        F.transform(
            F.when(F.col("n") == 1, F.transform("leaves", own)).otherwise(F.transform("leaves", step)), F.unhex
        ).alias("folded"),
    )
    # The limit guards against endless recursion; here every row climbs the height of the tree and stops.
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        climbed = kept(_climbing(anchors, nodes), "merkle-climb")
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    rows = runs.select(F.col("lo").alias("run"), "leaves").join(climbed, "run")
    each = rows.select("*", F.posexplode("leaves").alias("slot", "own"))
    siblings = F.when(F.size("leaves") > 1, others(F.col("slot"))).otherwise(F.lit(""))
    found = F.lower(F.hex(F.get("folded", F.col("slot"))))
    return each.select(
        "own.doc_id",
        "own.leaf",
        "subroot",
        "root",
        F.sha2(F.concat(siblings, F.lower(F.hex("proof"))), 256).alias("proof_sha256"),
        found.alias("folded_root"),
        (found == F.col("root")).alias("verified"),
    )


def _sql_field(name: str, value: str | None = None) -> str:
    value = value or f"CAST({name} AS VARCHAR)"
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


# Bytes enter one by one, each followed by eight shifts (-1).
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
  string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
_LOWER_SQL = f"translate(text, '{CAPITALS}', '{SMALL}')"
_LEAF_SQL = " || ".join(_sql_field(c) for c in LEAF)
_TAMPERED_SQL = " || ".join(_sql_field(c, _LOWER_SQL if c == "text" else None) for c in LEAF)

MANIFEST_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256({_LEAF_SQL}) AS leaf,
    CASE WHEN {_SQL_CRC} % 5 = 0 THEN sha256({_TAMPERED_SQL}) ELSE sha256({_LEAF_SQL}) END AS changed
  FROM documents),
placed AS (
  SELECT r, doc_id, leaf, changed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low(tree, level, pos, digest) AS (
  SELECT tree, 0, pos, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // {WIDTH}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, level, pos // {WIDTH}),
subroots AS (SELECT tree, arg_max(digest, level) AS digest, max(level) AS height FROM low GROUP BY tree),
high(level, pos, digest) AS (
  SELECT 0, tree, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // {WIDTH}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, pos // {WIDTH}),
top AS (SELECT arg_max(digest, level) AS root, max(level) AS height FROM high),
nodes AS (
  SELECT low.tree, level, pos, low.digest, height FROM low JOIN subroots USING (tree) WHERE level < height
  UNION ALL
  SELECT -1, level, pos, digest, height FROM high CROSS JOIN top WHERE level < height),
groups AS (SELECT tree, level, pos // {WIDTH} AS parent, height, list({{'pos': pos, 'digest': digest}} ORDER BY pos) AS nodes
  FROM nodes GROUP BY ALL),
start AS (SELECT r, tree AS own, CASE WHEN height = 0 THEN -1 ELSE tree END AS tree, 0 AS level,
    CASE WHEN height = 0 THEN tree ELSE pos END AS pos, changed AS folded, '' AS proof
  FROM placed JOIN subroots USING (tree)),
climb AS (
  SELECT * FROM start
  UNION ALL
  SELECT r, own, CASE WHEN c.level + 1 = g.height AND c.tree >= 0 THEN -1 ELSE c.tree END,
    CASE WHEN c.level + 1 = g.height AND c.tree >= 0 THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.level + 1 = g.height AND c.tree >= 0 THEN own ELSE c.pos // {WIDTH} END,
    sha256(array_to_string(list_transform(g.nodes, lambda x: CASE WHEN x.pos = c.pos THEN c.folded ELSE x.digest END), '')),
    c.proof || array_to_string(list_transform(list_filter(g.nodes, lambda x: x.pos <> c.pos), lambda x: x.digest), '')
  FROM climb c JOIN groups g ON g.tree = c.tree AND g.level = c.level AND g.parent = c.pos // {WIDTH}),
ended AS (SELECT r, own, folded, proof FROM climb CROSS JOIN top WHERE climb.tree = -1 AND climb.level = top.height)
SELECT doc_id, leaf, subroots.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = root AS verified
FROM ended JOIN placed USING (r) JOIN subroots ON subroots.tree = own CROSS JOIN top
"""
