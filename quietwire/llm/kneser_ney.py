"""Quality classifier: perplexity under interpolated modified Kneser-Ney models of trusted text.

There are two models. One is over word shapes (length, case, marks, digits, repetition), of which there is a fixed
number, so that texts in any language and of invented words share n-grams. Counts of trusted texts
are aggregated and joined order by order into probabilities and back-off weights; every document's n-grams, counted
once per document, are joined with them. The other is over the words themselves (:mod:`quietwire.llm.word_model`). A document is
rejected where its mean log probability under either model lies outside the quantiles of the trusted texts of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quietwire.llm.common import Words, kept, slices
from quietwire.llm.sketches import in_sketch
from quietwire.llm.word_model import word_scores

ORDER = 3
BITS = 10
BROADCAST_ROWS = 2_000_000
LOW, HIGH, MARGIN = 0.001, 0.999, 0.8
LEAST_TRUSTED = 50
BROADCAST_LANGUAGES = 10_000

_CLASS = np.full(256, 3, dtype=np.uint8)  # 0 letter, 1 digit, 2 closing mark, 3 other
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_CLASS[48:58] = 1
_CLASS[[ord(c) for c in ".,;:!?"]] = 2
_LENGTH = np.zeros(64, dtype=np.int64)
_LENGTH[[2]], _LENGTH[[3]], _LENGTH[4:6], _LENGTH[6:9], _LENGTH[9:13], _LENGTH[13:20], _LENGTH[20:] = 1, 2, 3, 4, 5, 6, 7
BEGIN, END = (1 << BITS) - 2, (1 << BITS) - 1


def shapes(words: Words) -> np.ndarray:
    """Shape of every word: a number below ``BEGIN``. ``words`` must not be lower-cased."""
    start, end, data = words.start, words.end, words.data
    if not len(start):
        return np.zeros(0, np.int64)
    cuts = np.stack([start, end], axis=1).ravel()
    kind = np.append(_CLASS[data], np.uint8(0))
    digits = np.logical_or.reduceat(kind == 1, cuts)[::2]
    others = np.logical_or.reduceat(kind == 3, cuts)[::2]
    letters = np.logical_or.reduceat(kind == 0, cuts)[::2]
    last = data[end - 1]
    closing = np.where(last == ord("."), 1, np.where(last == ord(","), 2, np.where(kind[end - 1] == 2, 3, 0)))
    length = _LENGTH[np.minimum(end - start, 63)]
    upper = (data[start] >= 65) & (data[start] <= 90)
    second = data[np.minimum(start + 1, len(data) - 1)]
    capitals = upper & (end - start > 1) & (second >= 65) & (second <= 90)
    content = np.where(others, np.where(letters, 2, 3), digits.astype(np.int64))
    hashes = words.hash
    again = np.zeros(len(start), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    case = np.where(capitals, 2, upper.astype(np.int64))
    # 8 lengths x 4 closings x 4 contents x 3 cases x 2 = 768 shapes
    return (((length * 4 + closing) * 4 + content) * 3 + case) * 2 + again


def ngram_counts(documents: DataFrame, carry: list[str]) -> DataFrame:
    """Per row: the carried columns, its number of tokens, and its distinct trigrams of shapes with their counts.

    Trigrams of words are counted by :mod:`quietwire.llm.word_model`. A text is its shapes between two begins and an end; a null or empty text is an end alone.
    """
    fields = {c: documents.schema[c].dataType.simpleString() for c in carry}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in slices(batch.column("text")):
                words, n = Words(data, bounds, lower=False), len(bounds) - 1
                ends = words.first[1:] + 3 * np.arange(1, n + 1)
                whole = np.full(len(words.start) + 3 * n, BEGIN, dtype=np.int64)
                place = np.ones(len(whole), dtype=bool)
                place[ends - 1] = False
                heads = np.concatenate([[0], ends[:-1]])
                place[heads] = place[heads + 1] = False
                whole[place] = shapes(words)
                whole[ends - 1] = END
                keys = (whole[:-2] << (2 * BITS)) | (whole[1:-1] << BITS) | whole[2:]
                owner = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
                same = owner[:-2] == owner[2:]
                both, counts = np.unique((owner[:-2][same] << (3 * BITS)) | keys[same], return_counts=True)
                cuts = np.searchsorted(both >> (3 * BITS), np.arange(n + 1)).astype(np.int32)
                part = batch.slice(at, n).drop_columns(["text"])
                yield pa.record_batch(
                    [
                        *part.columns,
                        pa.array((np.diff(words.first) + 1).astype(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(cuts),
                            pa.StructArray.from_arrays(
                                [pa.array(both & ((1 << (3 * BITS)) - 1)), pa.array(counts.astype(np.int64))],
                                names=["gram", "n"],
                            ),
                        ),
                    ],
                    names=[*part.schema.names, "tokens", "grams"],
                )

    schema = ", ".join(f"`{c}` {t}" for c, t in fields.items())
    return documents.select(*carry, "text").mapInArrow(
        run, f"{schema}, tokens long, grams array<struct<gram: long, n: long>>"
    )


def _discounted(counts: DataFrame, context: Column, order: int) -> tuple[DataFrame, DataFrame]:
    """``gram, p`` (discounted share) and ``context, back`` (back-off weight) from ``gram, n``."""
    m = {r[0]: r[1] for r in counts.where("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (m.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = min(max(1 - 2 * y * n2 / n1, 0.05), 0.95) if n1 else 0.5
    d2 = min(max(2 - 3 * y * n3 / n2, 0.05), 1.9) if n2 else 0.75
    d3 = min(max(3 - 4 * y * n4 / n3, 0.05), 2.8) if n3 else 0.9
    off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    with_context = counts.withColumn("context", context).withColumn("off", F.least(off, F.col("n").cast("double")))
    totals = with_context.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("back"))
    share = with_context.join(totals.select("context", "total"), "context").select(
        "gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("p")
    )
    return share, totals.select("context", "back")


def learn(trigrams: DataFrame) -> dict[str, DataFrame]:
    """Tables of an interpolated modified Kneser-Ney model from ``gram, n`` of trusted text.

    ``three``: trigram to probability share; ``two``, ``one``: the same on continuation counts; ``back3``,
    ``back2``: back-off weight of a context; ``none``: probability of a symbol never met.
    """
    low, low2 = (1 << BITS) - 1, (1 << (2 * BITS)) - 1
    gram = F.col("gram")
    three, back3 = _discounted(trigrams, F.shiftright(gram, BITS), 3)
    # Lower orders count in how many contexts a gram stands.
    pairs = trigrams.groupBy((gram.bitwiseAND(F.lit(low2))).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    pairs = kept(pairs, "kn-pairs")
    two, back2 = _discounted(pairs, F.shiftright(gram, BITS), 2)
    ones = pairs.groupBy((gram.bitwiseAND(F.lit(low))).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    one, back1 = _discounted(kept(ones, "kn-ones"), F.lit(0), 1)
    return {"three": three, "back3": back3, "two": two, "back2": back2, "one": one, "back1": back1}


def _joined(left: DataFrame, right: DataFrame, on: str, name: str, rows: int) -> DataFrame:
    """Left join; the right side is broadcast where its counted rows allow."""
    side = right.toDF(on, name)
    return left.join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, on, "left")


def log_probabilities(counted: DataFrame, key: str, model: dict[str, DataFrame]) -> DataFrame:
    """``key, log2p``: the sum over all trigrams of each row of ``counted``."""
    low, low2 = (1 << BITS) - 1, (1 << (2 * BITS)) - 1
    pinned = {k: kept(v, f"kn-{k}") for k, v in model.items()}
    sizes = {k: v.count() for k, v in pinned.items()}
    rows = counted.select(key, F.explode("grams").alias("g")).select(key, F.col("g.gram").alias("abc"), F.col("g.n").alias("times"))
    rows = rows.withColumn("ab", F.shiftright("abc", BITS)).withColumn("bc", F.col("abc").bitwiseAND(F.lit(low2)))
    rows = rows.withColumn("b", F.shiftright("bc", BITS)).withColumn("c", F.col("abc").bitwiseAND(F.lit(low)))
    for table, on, name in (
        ("three", "abc", "p3"),
        ("back3", "ab", "g3"),
        ("two", "bc", "p2"),
        ("back2", "b", "g2"),
        ("one", "c", "p1"),
    ):
        rows = _joined(rows, pinned[table], on, name, sizes[table])
    back1 = pinned["back1"].first()
    uniform = (back1["back"] if back1 else 1.0) / (1 << BITS)
    p1 = F.coalesce("p1", F.lit(0.0)) + F.lit(uniform)
    p2 = F.coalesce("p2", F.lit(0.0)) + F.coalesce("g2", F.lit(1.0)) * p1
    p3 = F.coalesce("p3", F.lit(0.0)) + F.coalesce("g3", F.lit(1.0)) * p2
    return rows.groupBy(key).agg(F.sum(F.col("times") * F.log2(p3)).alias("log2p"))


def classify(
    documents: DataFrame,
    labels: DataFrame,
    most_documents: int | None = None,
    low: float = LOW,
    high: float = HIGH,
    margin: float = MARGIN,
) -> DataFrame:
    """``doc_id, lang, tokens, bits, least, most, word_bits, word_least, word_most, accepted`` for every row of ``documents``.

    ``bits`` is the mean -log2 probability of a token's shape (perplexity is 2 ** bits); ``least`` and ``most`` are
    the ``low`` and ``high`` quantiles of the trusted texts (``labels.quality`` 1) of the language, ``margin`` bits apart. ``word_bits``,
    ``word_least`` and ``word_most`` are the same of the words, each text scored by the trusted texts of the half of the ids that its own
    isn't in; they are null (and decide nothing) below ``LEAST_TRUSTED`` trusted texts. A document between both pairs of bounds is accepted. Quantiles are of all trusted rows. A language with fewer than ``LEAST_TRUSTED`` trusted texts (or null) takes the
    quantiles of all. Texts with no words are accepted as they hold nothing to judge; so is everything without
    trusted texts. The models are fitted on all trusted texts; with ``most_documents``, on so many of them, the least by a
    hash of the id. No rows give no rows. Runs jobs.
    """
    labelled = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
    all_trusted = kept(labelled.select(F.col("doc_id").alias("__id")).distinct(), "kn-trusted")
    trusted = all_trusted
    if most_documents is not None:
        trusted = kept(all_trusted.orderBy(F.xxhash64("__id"), "__id").limit(most_documents), "kn-fitted")
    docs = documents.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_hash"))
    # Equal texts of one id score alike: they meet their rows by both.
    words = word_scores(docs, trusted).toDF("__word_id", "__hash", "word_log2p").dropDuplicates(["__word_id", "__hash"])
    counted = kept(ngram_counts(docs, ["doc_id", "lang", "text_hash"]).withColumn("row", F.monotonically_increasing_id()), "kn-counted")
    # Ids of any number meet their rows by shuffle at every size; most rows that are not trusted stay out of it.
    learned = counted.where(in_sketch(trusted.select(F.col("__id").alias("doc_id")), "doc_id")).join(
        trusted.hint("merge"), F.col("doc_id") == F.col("__id"), "left_semi"
    )
    trigrams = kept(
        learned.select(F.explode("grams").alias("g")).groupBy(F.col("g.gram").alias("gram")).agg(F.sum("g.n").alias("n")), "kn-trigrams"
    )
    sums = log_probabilities(counted, "row", learn(trigrams))
    with_words = F.col("doc_id").eqNullSafe(F.col("__word_id")) & (F.col("text_hash") == F.col("__hash"))
    scored = kept(
        counted.select("row", "doc_id", "lang", "tokens", "text_hash")
        .join(sums, "row", "left")
        .join(words.hint("merge"), with_words, "left")
        .withColumn("bits", -F.col("log2p") / F.col("tokens"))
        .withColumn("word_bits", -F.col("word_log2p") / F.col("tokens"))
        .select("doc_id", "lang", "tokens", "bits", "word_bits"),
        "kn-scored",
    )
    good = scored.where("tokens > 1").join(all_trusted, F.col("doc_id") == F.col("__id"), "left_semi")
    ends = F.array(F.lit(low), F.lit(high))
    quantiles = [F.percentile_approx("bits", ends, 100_000).alias("q"), F.percentile_approx("word_bits", ends, 100_000).alias("w")]
    good = kept(good.select("lang", "bits", "word_bits"), "kn-good")
    by_lang = good.groupBy("lang").agg(*quantiles, F.count(F.lit(1)).alias("trusted")).where(F.col("trusted") >= LEAST_TRUSTED)
    overall = good.agg(*quantiles, F.count(F.lit(1))).first()
    none = F.lit(None).cast("array<double>")
    everywhere = none if overall[0] is None else F.array(*[F.lit(float(x)) for x in overall[0]])
    word_everywhere = none if overall[2] < LEAST_TRUSTED else F.array(*[F.lit(float(x)) for x in overall[1]])
    ranges = kept(by_lang.where("lang is not null").select(F.col("lang").alias("__lang"), "q", "w"), "kn-ranges")
    if ranges.count() <= BROADCAST_LANGUAGES:
        ranges = F.broadcast(ranges)

    def within(bits: str, least: str, most: str) -> Column:
        return F.coalesce(F.col(bits).between(F.col(least), F.col(most)), F.lit(True))

    return (
        scored.join(ranges, F.col("lang") == F.col("__lang"), "left")
        .withColumn("q", F.coalesce(F.col("q"), everywhere))
        .withColumn("w", F.coalesce(F.col("w"), word_everywhere))
        .select(
            "doc_id",
            "lang",
            "tokens",
            "bits",
            (F.col("q")[0] - margin).alias("least"),
            (F.col("q")[1] + margin).alias("most"),
            "word_bits",
            (F.col("w")[0] - margin).alias("word_least"),
            (F.col("w")[1] + margin).alias("word_most"),
        )
        .withColumn("accepted", (F.col("tokens") == 1) | (within("bits", "least", "most") & within("word_bits", "word_least", "word_most")))
    )


def accepted_documents(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that :func:`classify` accepts, with all their columns.

    Rows of one id (null is one) are one document: it goes if any of them is rejected.
    """
    rejected = kept(
        classify(documents, labels, **options).where(~F.col("accepted")).select(F.col("doc_id").alias("__id")).distinct(),
        "rejected",
    )
    marked = documents.withColumn("__maybe", in_sketch(rejected.select(F.col("__id").alias("doc_id")), "doc_id"))
    some = marked.where("__maybe").join(rejected, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    return marked.where(~F.col("__maybe")).unionByName(some).drop("__maybe")
