"""Document fingerprints by spot signatures.

Every common word (an anchor) opens a chain with the content words that follow it; the distinct
chains are a text's fingerprint, written as sorted 32-bit hex numbers. Likeness is the Jaccard
measure of two fingerprints, left off where their lengths alone rule a pair out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quietwire.llm.common import SLICE_BYTES, Words, chains, mix

CHAIN = 2
SPARE = 8
"""Besides the common words one word in so many, by its hash, is an anchor: junk and short texts
hold few common words."""

#: Anchors: the most frequent function words of the languages at hand; a parameter of every function here.
ANCHORS = (
    "a an and are as at be by for from has he in is it its not of on or that the this to was were with",
    "aber als am an auch auf aus bei bis das dem den der des die durch ein eine einer es für im in ist",
    "mit nach nicht oder sich sie sind so und unter von vor war wie wird zu zum zur über",
    "a al como con de del el en es esta este la las lo los más no o para pero por que se su sus un una y ya",
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas pour",
    "qui sa se ses son sont sur un une vous",
)
_HASHES: dict[tuple[str, ...], np.ndarray] = {}


def anchor_hashes(anchors: tuple[str, ...]) -> np.ndarray:
    """Sorted hashes of the anchor words."""
    if anchors not in _HASHES:
        words = sorted({w for line in anchors for w in line.split()})
        data = " ".join(words).encode()
        _HASHES[anchors] = np.sort(
            Words(np.frombuffer(data, np.uint8), np.array([0, len(data)], dtype=np.int64)).hash
        )
    return _HASHES[anchors]


def signatures(texts: list[bytes], anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> list[np.ndarray]:
    """Sorted distinct signatures of each text.

    A chain shorter than ``chain`` at the end of a text counts as it is. In a text without anchors
    every word opens the chain of the words behind it; a text without words has no signature.
    """
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(texts), np.uint8), bounds)
    hashes, known = words.hash, anchor_hashes(anchors)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    anchor = (known[at] == hashes) | ((hashes >> np.uint64(20)) % np.uint64(SPARE) == 0)
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    value = hashes[spots].copy()
    pointer = np.searchsorted(content, spots)  # the first content word behind each anchor
    with np.errstate(over="ignore"):
        for k in range(chain):
            index = pointer + k
            there = index < len(content)
            word = content[np.minimum(index, max(len(content) - 1, 0))] if len(content) else np.zeros_like(spots)
            there &= words.doc[word] == words.doc[spots] if len(content) else False
            value = mix(value * np.uint64(31) + np.where(there, hashes[word], np.uint64(7)))
    owner = words.doc[spots]
    short = (value >> np.uint64(32)).astype(np.uint64)
    keyed = np.unique((owner.astype(np.uint64) << np.uint64(32)) | short)
    cuts = np.searchsorted(keyed >> np.uint64(32), np.arange(len(texts) + 1))
    low = (keyed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = [low[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
    for i in np.flatnonzero((np.diff(cuts) == 0) & (np.diff(words.first) > 0)):
        mine = hashes[words.first[i] : words.first[i + 1]]
        padded = np.concatenate([mine, np.full(chain, 7, dtype=np.uint64)])
        out[i] = np.unique((chains(padded, chain + 1) >> np.uint64(32)).astype(np.uint32))
    return out


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(one: np.ndarray, other: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two fingerprints; 0 where it is below ``least``.

    Two fingerprints whose lengths differ by more than ``least`` allows are not compared. Both empty: 1.
    """
    small, large = sorted((len(one), len(other)))
    if large == 0:
        return 1.0
    if small < least * large or small == 0:
        return 0.0
    same = len(np.intersect1d(one, other, assume_unique=True))
    value = same / (small + large - same)
    return value if value >= least else 0.0


def fingerprints(documents: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``doc_id, n_signatures, fingerprint`` of every document; a null text is empty."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a, b, some in _pieces(texts):
                found = signatures(some, anchors, chain)
                yield pa.record_batch(
                    [ids.slice(a, b - a), pa.array([len(x) for x in found], pa.int64()), pa.array(map(as_text, found))],
                    names=["doc_id", "n_signatures", "fingerprint"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_signatures long, fingerprint string")


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    whole = texts.cast(pa.binary()).fill_null(b"").to_pylist()
    at = 0
    while at < len(whole):
        to, size = at, 0
        while to < len(whole) and (to == at or size + len(whole[to]) <= SLICE_BYTES):
            size += len(whole[to])
            to += 1
        yield at, to, whole[at:to]
        at = to


def in_ranges(documents: DataFrame, ranges: int) -> DataFrame:
    """``doc_id, text`` dealt by id into ranges; every range ends with a copy of the document after it.

    Returns ``part, extra, doc_id, text``, each range in one partition and sorted; ``extra`` marks the
    copies. The last range is followed by the first document. Null ids come last. Runs a job over
    the ids; the driver sees one id for each range.
    """
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull())

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("doc_id").to_numpy().min()
                least = x if least is None else min(x, least)
        if least is not None:
            yield pa.record_batch([pa.array([least], pa.int64())], names=["doc_id"])

    found = ids.repartitionByRange(ranges, "doc_id").mapInArrow(lowest, "doc_id long").collect()
    starts = np.unique(np.array([r[0] for r in found], dtype=np.int64))
    last = max(len(starts) - 1, 0)
    kind = T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("extra", T.IntegerType())]))

    @F.pandas_udf(kind)
    def place(values: pd.Series) -> pd.Series:
        there = values.notna().to_numpy()
        numbers = values.fillna(0).astype(np.int64).to_numpy()
        part = np.where(there, np.maximum(np.searchsorted(starts, numbers, side="right") - 1, 0), last)
        out = []
        for p, x, ok in zip(part.tolist(), numbers.tolist(), there.tolist(), strict=True):
            mine = [{"part": p, "extra": 0}]
            if len(starts) and ok and x == starts[p]:
                mine.append({"part": p - 1, "extra": 1} if p else {"part": last, "extra": 2})
            elif not len(starts):
                mine.append({"part": 0, "extra": 2})
            out.append(mine)
        return pd.Series(out)

    return (
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), "text", F.explode(place(F.col("doc_id").cast("long"))).alias("__at")
        )
        .select(F.col("__at.part").alias("part"), F.col("__at.extra").alias("extra"), "doc_id", "text")
        .repartition("part")
        .sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_last(), "text")
    )


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def edited_fingerprints(
    documents: DataFrame,
    share: int = 4,
    anchors: tuple[str, ...] = ANCHORS,
    chain: int = CHAIN,
    least: float = 0.0,
    ranges: int | None = None,
) -> DataFrame:
    """How a fingerprint stands an edit: each document, its edited text, and the next document.

    The edited text has its last ``floor(n_chars / share)`` code points replaced by the first as many
    (or all) of the next document by ascending id; the first document follows the last. Equal ids
    are ordered by text; null ids come last; a null text is empty. No rows give no rows.
    """
    spark = documents.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next row is known, and the last one
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("part", "extra", "doc_id", "text")), strict=True):
                held.append((*row[:3], row[3] or ""))
                size += len(held[-1][3])
                if size >= SLICE_BYTES:
                    yield from compare(held)
                    held, size = held[-1:], 0
        if held:
            yield from compare(held)

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [r[3] for r in rows]
        # A row is answered if it is an own one and the row behind it is of its range.
        own = [i for i in range(len(rows) - 1) if rows[i][1] == 0 and rows[i + 1][0] == rows[i][0]]
        edited = []
        for i in own:
            cut = len(texts[i]) // share
            edited.append((texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut]).encode())
        plain = signatures([t.encode() for t in texts], anchors, chain)
        changed = signatures(edited, anchors, chain)
        if not own:
            return
        yield pa.record_batch(
            [
                pa.array([rows[i][2] for i in own], pa.int64()),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array([as_text(plain[i]) for i in own]),
                pa.array([as_text(c) for c in changed]),
                pa.array([likeness(plain[i], c, least) for i, c in zip(own, changed, strict=True)]),
                pa.array([likeness(plain[i], plain[i + 1], least) for i in own]),
            ],
            names=[c.split()[0] for c in EDITED.split(",")],
        )

    return in_ranges(documents, ranges).mapInArrow(run, EDITED)
