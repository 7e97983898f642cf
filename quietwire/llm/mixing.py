"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Every document gets the key ``-ln(u) / weight`` with ``u`` from a digest of its id, so that taking
documents of a source by ascending key draws without replacement in proportion to the weight, and
reruns agree. A source's target is met by whole epochs first and then by the documents whose
prefix sum of words stays within what is left.

No source is ever sorted in one task: the words of a source are summed over ``KEY_BINS`` ranges
of the key (pre-aggregated before the shuffle), the ranges are prefix-summed, and only the documents of the one
range in which the budget ends are sorted and prefix-summed one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from quietwire.llm.common import kept

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
KEY_BINS = 65_536
LEAST_QUALITY = 0.05
_SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of words; each word with the white space around it becomes one letter."""
    marks = F.regexp_replace(text, rf"[{_SPACE}]*+[^{_SPACE}]++[{_SPACE}]*+", "x")
    return F.coalesce(
        F.when(text.rlike(rf"[^{_SPACE}]"), F.length(marks)).otherwise(0), F.lit(0)
    ).cast("long")


def letter_share(text: Column) -> Column:
    """Default document quality: the share of letters, at least ``LEAST_QUALITY``."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]++", ""))
    share = letters / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(share, F.lit(LEAST_QUALITY)), F.lit(LEAST_QUALITY))


def uniform(key: Column) -> Column:
    """A number inside (0, 1) from the first 48 bits of the md5 of a key (null: of an empty text)."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: float = MOST_EPOCHS,
) -> DataFrame:
    """Targets of sources from ``(source, source_size)``, one row per source.

    Weights repeat over the sources in code point order, null last. No target exceeds
    ``most_epochs`` times its source; what is above is shared again by weight. That fixed point is
    ``min(level * weight, cap)``, and the level follows from the sources sorted by cap / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    every = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    )
    # Sources below the level are full; the first whose ratio reaches its level sets the level.
    level = F.first(F.when(F.col("ratio") >= F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    return ranked.withColumn("target", F.least(F.coalesce(level * F.col("weight"), F.col("cap")), F.col("cap"))).select(
        "source", "source_size", "target"
    )


def mix_sources(
    documents: DataFrame,
    quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: float = MOST_EPOCHS,
) -> DataFrame:
    """How often each document is taken.

    Input: ``doc_id, text, source`` and any other columns (``quality`` may use them). Returns
    ``doc_id, source, size, source_size, target, taken, copies`` for every input row.

    A null text has size 0 and is never taken; a null source is a source; a source without words has a target of 0; a null id draws the key
    of an empty id. Repeated rows are separate documents (equal keys, so they stand side by side).
    No rows give no rows. Runs jobs: the sizes are written once to the shared folder.
    """
    base = kept(
        documents.select(
            F.col("doc_id"),
            F.col("source"),
            word_count(F.col("text")).alias("size"),
            (-F.log(uniform(F.col("doc_id"))) / (quality if quality is not None else letter_share(F.col("text")))).alias(
                "key"
            ),
        ).withColumn("bin", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * KEY_BINS)),
        "mixing",
    )
    bins = base.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    targets = source_targets(
        bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most_epochs
    ).withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))).withColumn(
        "rest", F.coalesce(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))
    )
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).select(
        F.col("source").alias("b_source"), F.col("bin").alias("b_bin"), "before", "words"
    )
    t = targets.select(
        F.col("source").alias("t_source"), "source_size", "target", "epochs", "rest"
    )
    bounds = before.join(t, F.col("b_source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn(
        "part",
        F.when(F.col("before") + F.col("words") <= F.col("rest"), "all")
        .when(F.col("before") >= F.col("rest"), "none")
        .otherwise("some"),
    )
    rows = base.join(
        bounds, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin"))
    ).drop("b_source", "b_bin", "words")
    # Only the range of keys in which a source's budget ends is ordered row by row.
    within = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    some = rows.where(F.col("part") == "some").withColumn(
        "sum_before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    picked = some.withColumn("more", (F.col("sum_before") + F.col("size") / 2 <= F.col("rest")).cast("int"))
    rest = rows.where(F.col("part") != "some").withColumn("more", (F.col("part") == "all").cast("int"))
    copies = (F.col("epochs") + F.col("more")).cast("long")
    return picked.drop("sum_before").unionByName(rest).select(
        "doc_id",
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (F.when(F.col("size") > 0, copies).otherwise(0) * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long").alias("copies"),
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mixture itself: every input column, each document as often as it is taken.

    Documents are told apart by ``doc_id``, size and source; repeated rows of one document
    share its draw. Rows without words are not in a mixture.
    """
    draws = (
        mix_sources(documents, **options)
        .where(F.col("copies") > 0)
        .groupBy("doc_id", "source", "size")
        .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    ).select(
        F.col("doc_id").alias("__id"),
        F.col("source").alias("__source"),
        F.col("size").alias("__size"),
        F.col("copies").alias("__copies"),
        F.col("rows").alias("__rows"),
    )
    columns = documents.columns
    sized = documents.withColumn("__words", word_count(F.col("text")))
    same = (
        F.col("doc_id").eqNullSafe(F.col("__id"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
    )
    # Of repeated rows each carries its share of the copies: the same number, or one less.
    w = Window.partitionBy("doc_id", "source", "__words").orderBy(F.lit(0))
    joined = sized.join(draws, same)
    alone = joined.where(F.col("__rows") == 1).withColumn("__n", F.col("__copies"))
    repeated = joined.where(F.col("__rows") > 1).withColumn("__at", F.row_number().over(w)).withColumn(
        "__n",
        F.floor(F.col("__copies") / F.col("__rows"))
        + (F.col("__at") <= F.col("__copies") % F.col("__rows")).cast("long"),
    ).drop("__at")
    return (
        alone.unionByName(repeated)
        .where(F.col("__n") > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
        .select(*columns)
    )


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("taken", T.LongType()),
    ]
)

MIXING_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)
      / coalesce(greatest(length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE / greatest(length(text), 1), 0.05), 0.05) AS key
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM base GROUP BY source),
capped AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
    1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM src),
levels AS (
  SELECT a.source, any_value(a.ratio) AS ratio,
    (any_value(a.budget) - coalesce(sum(b.cap) FILTER (b.ratio < a.ratio), 0)) / sum(b.weight) FILTER (b.ratio >= a.ratio) AS level
  FROM capped a CROSS JOIN capped b GROUP BY a.source),
goal AS (
  SELECT source, source_size, least(cap, weight * (SELECT min_by(level, ratio) FROM levels WHERE ratio >= level)) AS target
  FROM capped),
run AS (
  SELECT b.*, g.source_size, g.target, floor(g.target / g.source_size) AS epochs,
    g.target - floor(g.target / g.source_size) * g.source_size AS rest,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - b.size AS before
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN before + size / 2.0 <= rest AND before < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
