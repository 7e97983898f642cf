"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as word sequences. A line is a repeat if an earlier line (by document id, then place)
has the same words, or, from ``LEAST_WORDS`` words on, can be made from it by one word edit: a word put in, left
out or replaced.

Lines within one edit agree once a word is deleted from one or both, so every line emits the
hashes of itself and of all its variants with one word deleted, and equal hashes are joined: the same
variant with the word deleted at the same place is a replacement, a variant equal to a whole line
is an insertion. The earliest of each meeting is found by aggregation (no pairs are made), and the edit is
verified on the words. Only lines that can have a partner emit variants: one edit leaves
one half of a line as it is, so lines whose halves stand in no other line are left out first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quietwire.llm.common import Words, give_back, kept, mix, powers, slices
from quietwire.llm.sketches import in_sketch

LEAST_WORDS = 5
"""Shorter lines are compared exactly only: one edit would be more than a fifth of them."""

HOT_SHARE = 1000
"""A line that is at least one in so many of all lines (so there are at most so many) is dealt to several tasks."""

HOT_SALTS = 64

VARIANT_ROWS = 100_000
"""Variants in one Arrow batch, about; a longer line is a batch."""

LINE_BYTES = 200_000
"""Texts are cut into lines in slices of about so many bytes: several workers serve a task here."""

_SECOND = np.uint64(0xA24BAED4963EE407)


class Lines:
    """The lines of some texts that have at least so many words, as word sequences."""

    def __init__(self, words: Words, least: int = 1):
        breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
        lines = breaks[words.start]  # of all texts in a row
        hashes = words.hash
        opens = np.ones(len(lines), dtype=bool)
        opens[1:] = (lines[1:] != lines[:-1]) | (words.doc[1:] != words.doc[:-1])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(lines))[: len(first)]
        long = last - first >= least
        self.first, self.last = first[long], last[long]
        self.doc = words.doc[self.first]
        self.number = lines[self.first] - breaks[words.bounds[self.doc]]
        self.words = hashes
        self.sums = []
        up, _ = powers(len(hashes) + 2)
        with np.errstate(over="ignore"):
            for values in (hashes, mix(hashes ^ _SECOND)):
                total = np.zeros(len(hashes) + 1, dtype=np.uint64)
                np.cumsum(values * up[: len(hashes)], out=total[1:])
                self.sums.append(total)

    def run(self, start: np.ndarray, end: np.ndarray, side: int = 0) -> np.ndarray:
        """Hashes of word runs, by their words alone."""
        _, down = powers(len(self.words) + 2)
        with np.errstate(over="ignore"):
            value = (self.sums[side][end] - self.sums[side][start]) * down[start]
            return mix(value ^ (end - start).astype(np.uint64))

    def keys(self) -> list[bytes]:
        both = np.stack([self.run(self.first, self.last, 0), self.run(self.first, self.last, 1)], axis=1)
        return [x.tobytes() for x in both]

    def halves(self) -> np.ndarray:
        """Three hashes of each line; of two lines one edit apart, one is the same."""
        n = self.last - self.first
        out = []
        for size in (n // 2, (n - 1) // 2):
            out.append(mix(self.run(self.first, self.first + size) ^ np.uint64(1)))
        for size in (n - n // 2, (n - 1) - (n - 1) // 2):
            out.append(mix(self.run(self.last - size, self.last) ^ np.uint64(2)))
        return np.stack(out, axis=1).view(np.int64)


def variants(words: np.ndarray) -> np.ndarray:
    """Hashes of a word sequence with each word deleted in turn."""
    n = len(words)
    up, _ = powers(n + 2)
    with np.errstate(over="ignore"):
        before = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n])])
        later = np.concatenate([[np.uint64(0)], np.cumsum(words[1:] * up[: n - 1])]) if n else before
        value = before[:n] + (later[n - 1] - later[:n])
        return mix(value ^ np.uint64(n - 1))


def whole(words: np.ndarray) -> np.uint64:
    """Hash of a word sequence, comparable with :func:`variants`."""
    up, _ = powers(len(words) + 2)
    with np.errstate(over="ignore"):
        return mix(np.array([(words * up[: len(words)]).sum()], dtype=np.uint64) ^ np.uint64(len(words)))[0]


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether word sequences differ by one word put in, left out or replaced, at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = a == b[: len(a)]
    at = len(a) if same.all() else int(same.argmin())
    skip = 1 if len(a) == len(b) else 0
    return bool(np.array_equal(a[at + skip :], b[at + 1 :]))


def _lines(documents: DataFrame, least: int) -> DataFrame:
    """``doc_id, line, key, halves`` of every line that holds a word; shorter ones than ``least`` have no halves."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in slices(batch.column("text"), LINE_BYTES):
                found = Lines(Words(data, bounds))
                long = found.last - found.first >= least
                halves = found.halves()[long]
                ends = np.concatenate([[0], np.cumsum(long)]).astype(np.int32) * 4
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(found.doc + at)),
                        pa.array(found.number.astype(np.int64)),
                        pa.array(found.keys(), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(halves.ravel())),
                    ],
                    names=["doc_id", "line", "key", "halves"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line long, key binary, halves array<long>")


def _word_rows(documents: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``key, doc_id, line, words`` of the lines in ``wanted`` (``key, doc_id, line``), one row for each key.

    Texts meet ``wanted`` by the line's own key: ids may be null, or stand for several texts.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in slices(batch.column("text"), LINE_BYTES):
                found = Lines(Words(data, bounds), least)
                spans = zip(found.first.tolist(), found.last.tolist(), strict=True)
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(found.doc + at)),
                        pa.array(found.number.astype(np.int64)),
                        pa.array(found.keys(), pa.binary()),
                        pa.array([found.words[a:b].tobytes() for a, b in spans], pa.binary()),
                    ],
                    names=["doc_id", "line", "key", "words"],
                )

    near = documents.select("doc_id", "text").where(in_sketch(wanted, "doc_id"))
    rows = near.mapInArrow(run, f"doc_id {kind}, line long, key binary, words binary").where(in_sketch(wanted, "doc_id", "line"))
    return rows.select("key", "words").join(wanted.hint("merge"), "key").dropDuplicates(["key"])


def _variant_rows(lines: DataFrame) -> DataFrame:
    """``hash, n, at, key, doc_id, line``: ``at`` is the deleted place, -1 for the line itself."""
    kind = lines.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            size = 0
            for i, x in enumerate(batch.column("words")):
                words = np.frombuffer(x.as_py(), np.uint64)
                n = len(words)
                parts.append((np.full(n + 1, i), np.append(variants(words), whole(words)), np.full(n + 1, n), np.append(np.arange(n), -1)))
                size += n + 1
                if size >= VARIANT_ROWS:
                    yield batch_of(batch, parts)
                    parts, size = [], 0
            if parts:
                yield batch_of(batch, parts)
            parts = []
            give_back()

    def batch_of(batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
        rows, hashes, sizes, places = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.record_batch(
            [
                pa.array(hashes.view(np.int64)),
                pa.array(sizes.astype(np.int32)),
                pa.array(places.astype(np.int32)),
                *(batch.column(c).take(pa.array(rows)) for c in ("key", "doc_id", "line")),
            ],
            names=["hash", "n", "at", "key", "doc_id", "line"],
        )

    return lines.mapInArrow(run, f"hash long, n int, at int, key binary, doc_id {kind}, line long")


def _met(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose value of ``column`` stands in more than one row.

    Only the values are counted by shuffle; of the rows those go on that a sketch of the repeated values lets pass.
    Joins with texts and rows are merge joins at every size here, so that small trials show what large runs do.
    """
    often = kept(rows.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(column), "often")
    return rows.where(in_sketch(often, column)).join(often.hint("merge"), column, "left_semi")


def repeated_lines(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, line, near``: the lines (numbered from 0) that repeat an earlier one.

    ``near``: the earlier line differs by one word edit. Lines are parted at line feeds; A-Z are lower-cased and
    white space between words doesn't count. Lines with fewer than ``least_words`` words repeat equal lines only; null
    and empty texts and lines without words repeat nothing. No rows give no rows. Null ids come first. Rows of one id are one document: their equal lines at equal places
    are the same line. Runs jobs.
    """
    lines = kept(_lines(documents, least_words), "lines")
    first = F.min(F.struct("doc_id", "line", "halves")).alias("f")
    firsts = kept(lines.groupBy("key").agg(first, F.count(F.lit(1)).alias("times")).select("key", "f.*", "times"), "firsts")
    halves = firsts.select("key", "doc_id", "line", F.explode(F.array_distinct("halves")).alias("half"))
    wanted = kept(_met(halves, "half").select("key", "doc_id", "line").distinct(), "wanted")
    words = kept(_word_rows(documents, wanted, least_words), "words")
    rows = kept(_met(_variant_rows(words), "hash"), "variants")
    # Meetings: the earliest line of each deleted place (replacements), and of each hash as a whole line and as a variant.
    order = F.struct("doc_id", "line", "key")
    meetings = rows.groupBy("hash", "n", "at").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    replaced = meetings.where((F.col("at") >= 0) & (F.col("rows") > 1)).select("hash", "n", "at", F.col("first").alias("keeper"))
    sides = (
        meetings.groupBy("hash")
        .agg(
            F.min(F.when(F.col("at") < 0, F.col("first"))).alias("as_line"),
            F.min(F.when(F.col("at") >= 0, F.col("first"))).alias("as_variant"),
        )
        .where(F.col("as_line").isNotNull() & F.col("as_variant").isNotNull())
    )
    own = rows.withColumn("own", order)
    by_place = own.join(replaced, ["hash", "n", "at"]).select("own", "keeper")
    as_line = sides.select(F.col("as_line").alias("own"), F.col("as_variant").alias("keeper"))
    as_variant = own.where("at >= 0").join(sides, "hash").select("own", F.col("as_line").alias("keeper"))
    near = (
        by_place.unionByName(as_line)
        .unionByName(as_variant)
        .where(F.col("keeper") < F.col("own"))
        .select(F.col("own.key").alias("key"), F.col("keeper.key").alias("keeper"))
        .distinct()
    )
    return _decided(lines, firsts, kept(near, "near"), words)


def _decided(lines: DataFrame, firsts: DataFrame, near: DataFrame, words: DataFrame) -> DataFrame:
    sequences = words.select("key", "words")
    pairs = near.join(sequences, "key").join(sequences.toDF("keeper", "other"), "keeper").select("key", "words", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                within_one_edit(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64))
                for a, b in zip(batch.column("words"), batch.column("other"), strict=True)
            ]
            yield pa.record_batch([batch.column("key").filter(pa.array(good, pa.bool_()))], names=["key"])

    verified = pairs.mapInArrow(run, "key binary").distinct().withColumn("near", F.lit(True))
    total = firsts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    is_hot = F.col("times") * HOT_SHARE >= max(total, HOT_SHARE * HOT_SALTS)
    salts = F.explode(F.sequence(F.lit(0), F.when(is_hot, HOT_SALTS - 1).otherwise(0))).alias("salt")
    repeats = firsts.select("key", F.col("doc_id").alias("__id"), F.col("line").alias("__line"), salts).join(verified, "key", "left")
    hot = F.broadcast(firsts.where(is_hot).select("key", F.lit(HOT_SALTS).alias("salts")))  # at most HOT_SHARE keys
    salt = F.pmod(F.xxhash64("doc_id", "line"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    again = ~(F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("line") == F.col("__line")))
    return (
        lines.join(hot, "key", "left")
        .select("key", "doc_id", "line", salt)
        .join(repeats, ["key", "salt"])
        .where(again | F.coalesce("near", F.lit(False)))
        .select("doc_id", "line", F.coalesce("near", F.lit(False)).alias("near"))
        .distinct()
    )


def without_repeats(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without their repeated lines: all columns, and ``lines_dropped``, ``lines_near``.

    See :func:`repeated_lines`. Documents without repeats pass unchanged; a document may become empty. A
    column named ``n_chars`` is left as it is. Null ids are kept as they are where no repeat is found.
    """
    dropped = kept(
        repeated_lines(documents, least_words)
        .groupBy("doc_id")
        .agg(F.collect_list("line").alias("__lines"), F.sum(F.col("near").cast("long")).alias("__near"))
        .withColumnRenamed("doc_id", "__id"),
        "dropped",
    )
    columns = [c for c in documents.columns if c not in ("lines_dropped", "lines_near")]
    plain = documents.select(*columns)
    maybe = in_sketch(dropped.select(F.col("__id").alias("doc_id")), "doc_id")
    marked = plain.withColumn("__maybe", maybe)
    rest = marked.where(~F.col("__maybe")).drop("__maybe").select("*", F.lit(0).cast("long").alias("lines_dropped"), F.lit(0).cast("long").alias("lines_near"))
    some = marked.where("__maybe").drop("__maybe").join(dropped.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lines = batch.column("__lines").to_pylist()
            near = batch.column("__near").fill_null(0)
            out, counts = [], []
            for text, gone in zip(texts, lines, strict=True):
                if text is not None and gone:
                    drop = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                out.append(text)
                counts.append(len(gone or ()))
            keep = batch.drop_columns(["__lines", "__near"])
            at = keep.schema.get_field_index("text")
            keep = keep.set_column(at, "text", pa.array(out, keep.schema.field("text").type))
            yield pa.record_batch(
                [*keep.columns, pa.array(counts, pa.int64()), near.cast(pa.int64())],
                names=[*keep.schema.names, "lines_dropped", "lines_near"],
            )
            del texts, out, keep
            give_back()

    changed = some.mapInArrow(run, f"{fields}, lines_dropped long, lines_near long")
    return changed.unionByName(rest)

