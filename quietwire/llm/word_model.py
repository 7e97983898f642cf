"""Interpolated modified Kneser-Ney over the words of trusted texts.

A word is its bytes, whatever it is; no word and no n-gram is left out. Trusted texts are dealt to two halves by a hash of their
id. There is a model of each half, and every document, trusted or not, is scored by the model of the half that its own id does not fall in: a text
is never scored by counts of itself, so that trusted texts tell how others like them score.

Texts are read once, in blocks, and words get numbers by shuffle. A block sends its distinct trigrams, pairs and words, packed, to
shards of them. A shard sums up the counts of an order, sends what they add to the next lower one (totals of contexts, and in how many
contexts a gram stands), and gives every block back the counts of what it asked for. A block puts the probabilities together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quietwire.llm.common import Words, give_back, kept_packed, slices
from quietwire.llm.suffix_tree import _mixed, _numbered, _open, _pack, _shard
from quietwire.scratch import unpin

ORDER = 3
BLOCK_BYTES = 8 << 20
SHARD_TOKENS = 1 << 20
"""Tokens for each shard, about."""

BEGIN, END, FIRST = 0, 1, 2
STATS = 10
"""Of a gram, for each of the two models: its count, and as a context its tokens and how many of its successors have a count of 1, of 2, and of more."""


def halves(ids: Column) -> Column:
    """The half that an id's text is fitted in, 0 or 1."""
    return F.pmod(F.xxhash64(ids), F.lit(2)).cast("int")


def _blocks(documents: DataFrame, block_bytes: int) -> DataFrame:
    """Per block: its documents (ids, hashes of the texts, halves, numbers of words), tokens as places in its list of words, and that list."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        parts: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ids = pa.concat_arrays([p[0] for p in parts])
            codes, words = pd.factorize(np.concatenate([p[3] for p in parts]))
            words = words.astype("<u8")
            row = {
                "block": pa.array([(task << 20) + number], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "texts": pa.array([np.concatenate([p[1] for p in parts]).tolist()], pa.list_(pa.int64())),
                "half": pa.array([_pack(np.concatenate([p[2] for p in parts]).astype(np.uint8))], pa.binary()),
                "lengths": pa.array([_pack(np.concatenate([p[4] for p in parts]).astype("<i8"))], pa.binary()),
                "tokens": pa.array([_pack(codes.astype("<i4"))], pa.binary()),
                "words": pa.array([_pack(words)], pa.binary()),
                "counts": pa.array([_pack(np.bincount(codes, minlength=len(words)).astype("<i8"))], pa.binary()),
                "n": pa.array([len(codes) + len(ids)], pa.int64()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            halves_, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("half", "hash"))
            for at, data, bounds in slices(batch.column("text")):
                words, n = Words(data, bounds, lower=False), len(bounds) - 1
                some = slice(at, at + n)
                parts.append((batch.column("doc_id").slice(at, n), hashes[some], halves_[some], words.hash, np.diff(words.first)))
                size += len(data)
                if size >= block_bytes:
                    yield closed()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield closed()
        parts = []
        give_back()

    schema = f"block long, ids array<{kind}>, texts array<long>, half binary, lengths binary, tokens binary, words binary, counts binary, n long"
    given = documents.select("doc_id", "text", halves(F.col("doc_id")).alias("half"), F.xxhash64("text").alias("hash"))
    return given.mapInArrow(run, schema)


def _numbered_texts(blocks: DataFrame, words: DataFrame, trusted: DataFrame) -> DataFrame:
    """Blocks with their tokens as numbers of words, and which documents are fitted."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    fitted = (
        blocks.select("block", F.posexplode("ids").alias("place", "__own"))
        .join(trusted.hint("merge"), F.col("__own") == F.col("__id"), "left_semi")
        .groupBy("block")
        .agg(F.collect_list("place").alias("fitted"))
    )
    right = words.select("block", "places", "numbers").unionByName(fitted, allowMissingColumns=True)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.select(["tokens", "lengths"]).to_pylist()[0]
        local, lengths = _open(row["tokens"], "<i4"), _open(row["lengths"], "<i8")
        own = np.zeros(int(local.max(initial=-1)) + 1, dtype="<i8")
        flags = np.zeros(len(lengths), dtype=np.uint8)
        for x in right.to_pylist():
            if x["fitted"] is not None:
                flags[x["fitted"]] = 1
            else:
                own[np.cumsum(_open(x["places"], "<i4"))] = _open(x["numbers"], "<i8")
        out = left.select(["block", "ids", "texts", "half", "lengths"])
        out = out.append_column("trusted", pa.array([_pack(flags)], pa.binary()))
        return out.append_column("tokens", pa.array([_pack(own[local] + FIRST)], pa.binary()))

    schema = f"block long, ids array<{kind}>, texts array<long>, half binary, lengths binary, trusted binary, tokens binary"
    return (
        blocks.select("block", "ids", "texts", "half", "lengths", "tokens").groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema)
    )


class _Text:
    """The symbols of a block's texts (two begins, words, an end), and for each place to be predicted its document and half."""

    def __init__(self, row: dict):
        self.lengths = _open(row["lengths"], "<i8")
        self.half = _open(row["half"], "<u1")
        self.trusted = _open(row["trusted"], "<u1").astype(bool)
        ends = np.cumsum(self.lengths + ORDER)
        starts = ends - self.lengths - ORDER
        self.symbols = np.full(int(ends[-1]) if len(ends) else 0, BEGIN, dtype=np.int64)
        inside = np.ones(len(self.symbols), dtype=bool)
        inside[starts], inside[starts + 1], inside[ends - 1] = False, False, False
        self.symbols[inside] = _open(row["tokens"], "<i8")
        self.symbols[ends - 1] = END
        inside[ends - 1] = True
        self.at = np.flatnonzero(inside)
        inside[starts + 1] = True
        self.after_first = np.flatnonzero(inside)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths + 1)

    def grams(self, order: int, shards: int) -> tuple[np.ndarray, ...]:
        """Distinct runs of ``order`` symbols as columns, in the order they are sent in, their shards, and for each place the run that
        ends there and, but for trigrams, the run that ends before it."""
        places = self.at if order == ORDER else self.after_first
        rows, shard, code = distinct([self.symbols[places - k] for k in range(order - 1, -1, -1)], shards)
        if order == ORDER:
            return rows, shard, code, None
        whole = np.zeros(len(self.symbols), dtype=np.int64)
        whole[places] = code
        return rows, shard, whole[self.at], whole[self.at - 1]


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        out = _mixed(out, c.view(np.uint64))
    return out


def distinct(columns: list[np.ndarray], shards: int = 0) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows, sorted by shard and first column where there are shards; their shards; and for each given row its place among them."""
    code, keys = pd.factorize(_hash(columns))
    first = np.empty(len(keys), dtype=np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    rows = [c[first] for c in columns]
    if not shards:
        return rows, np.zeros(len(first), dtype=np.int64), code
    shard = _shard(keys, shards)
    order = np.lexsort((rows[0], shard))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return [r[order] for r in rows], shard[order], place[code]


_SENT = "shard int, block long, keys binary, stats binary, sums array<long>"


def _sent(block: int | None, rows: list[np.ndarray], shard: np.ndarray, stats: np.ndarray | None) -> pa.Table:
    """Rows of a gram table for each shard: the first column by differences, which are mostly 0."""
    cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
    keys, packed = [], []
    for x, y in zip(cuts, cuts[1:], strict=False):
        keys.append(_pack(np.concatenate([np.diff(rows[0][x:y], prepend=0), *(r[x:y] for r in rows[1:])]).astype("<i8")))
        packed.append(None if stats is None else _pack(stats[:, x:y].astype("<i8").ravel()))
    n = len(keys)
    columns = [pa.array(shard[cuts[:-1]], pa.int32()), pa.array([block] * n, pa.int64()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())]
    return pa.table([*columns, pa.nulls(n, pa.list_(pa.int64()))], names=["shard", "block", "keys", "stats", "sums"])


def _asked(texts: DataFrame, order: int, shards: int) -> DataFrame:
    """What blocks ask for: their distinct runs of ``order`` symbols; trigrams with their counts in the fitted texts of each half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = _Text(row)
                rows, shard, place, _ = text.grams(order, shards)
                stats = None
                if order == ORDER:
                    fitted, half = text.trusted[text.doc], text.half[text.doc]
                    stats = np.stack([np.bincount(place[fitted & (half == m)], minlength=len(shard)) for m in (0, 1)])
                yield from _sent(row["block"], rows, shard, stats).to_batches()
                give_back()

    return texts.select("block", "half", "lengths", "trusted", "tokens").mapInArrow(run, _SENT)


def _summed(sent: DataFrame, order: int, shards: int) -> DataFrame:
    """Answers to blocks (rows with a block), what counts add to the next lower order (without one), and sums of each shard: of each
    model how many grams have a count of 1, 2, 3, 4, and any, and the total of the counts."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        # What adds to counts first: only its grams need a place in the sums, and those that are just asked for share an empty one.
        table = table.take(pa.array(np.argsort(table["stats"].is_null().to_numpy(), kind="stable")))
        keys = [_open(x.as_py(), "<i8").reshape(order, -1) for x in table["keys"]]
        cuts = np.cumsum([0, *(k.shape[1] for k in keys)])
        columns = [np.concatenate([np.cumsum(k[0]) if c == 0 else k[c] for k in keys]) for c in range(order)]
        del keys
        rows, _, place = distinct(columns)
        del columns
        blocks, given = table["block"].to_pylist(), len(table) - table["stats"].null_count
        met = int(place[: cuts[given]].max(initial=-1)) + 1
        rows = [r[:met] for r in rows]
        place = np.minimum(place, met)
        stats = np.zeros((2 if order == ORDER else STATS, met + 1), dtype=np.int64)
        for i in range(given):  # the rows of one sender are distinct
            stats[:, place[cuts[i] : cuts[i + 1]]] += _open(table["stats"][i].as_py(), "<i8").reshape(len(stats), -1)
        asked = [i for i, b in enumerate(blocks) if b is not None]
        answers = [_pack(stats[:, place[cuts[i] : cuts[i + 1]]].ravel()) for i in asked]
        sums = [int(x) for n in stats[:2] for x in (*((n == j).sum() for j in (1, 2, 3, 4)), (n > 0).sum(), n.sum())]
        n = len(asked)
        out = [
            pa.table(
                [
                    pa.array([shard] * n + [None], pa.int32()),
                    pa.array([blocks[i] for i in asked] + [None], pa.int64()),
                    pa.nulls(n + 1, pa.binary()),
                    pa.array([*answers, None], pa.binary()),
                    pa.array([None] * n + [sums], pa.list_(pa.int64())),
                ],
                names=["shard", "block", "keys", "stats", "sums"],
            )
        ]
        del answers, place
        known = np.flatnonzero(stats[0] + stats[1])
        if order > 1 and len(known):
            rows, own = [r[known] for r in rows], stats[:2, known]
            # First the contexts, then what is left without the oldest symbol.
            lower, to, code = distinct([np.concatenate([rows[c], rows[c + 1]]) for c in range(order - 1)], shards)
            context, rest = code[: len(known)], code[len(known) :]
            del rows, code, stats
            added = np.zeros((STATS, len(to)), dtype=np.int64)
            for m, c in enumerate(own):
                added[m] = np.bincount(rest, c > 0, len(to))
                for j, x in enumerate((c, c == 1, c == 2, c > 2)):
                    added[2 + 4 * m + j] = np.bincount(context, x, len(to))
            out.append(_sent(None, lower, to, added))
        give_back()
        return pa.concat_tables(out)

    return sent.groupBy("shard").applyInArrow(run, _SENT)


def discounts(sums: list[int]) -> tuple[float, float, float]:
    """Discounts of counts of 1, 2 and more, from how many grams have counts of 1 to 4."""
    n1, n2, n3, n4 = sums[:4]
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = min(max(1 - 2 * y * n2 / n1, 0.05), 0.95) if n1 else 0.5
    d2 = min(max(2 - 3 * y * n3 / n2, 0.05), 1.9) if n2 else 0.75
    d3 = min(max(3 - 4 * y * n4 / n3, 0.05), 2.8) if n3 else 0.9
    return d1, d2, d3


def _share(n: np.ndarray, total: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted share of counts in their context's total; ``d`` holds a column of discounts (of 0, 1, 2 and more) for each place."""
    return (n - d[np.minimum(n, 3), np.arange(len(n))]) / np.maximum(total, 1)


def _scores(texts: DataFrame, answers: DataFrame, sums: dict[int, list[int]], shards: int) -> DataFrame:
    """``doc_id, text_hash, word_log2p`` of all documents."""
    kind = texts.schema["ids"].dataType.elementType.simpleString()
    cut = {k: np.array([[0.0, *discounts(v[6 * m : 6 * m + 6])] for m in (0, 1)]).T for k, v in sums.items()}
    known, total = (np.array([sums[1][6 * m + j] for m in (0, 1)], dtype=np.float64) for j in (4, 5))
    n1, n2 = (np.array([sums[1][6 * m + j] for m in (0, 1)], dtype=np.float64) for j in (0, 1))
    left = np.where(total > 0, (cut[1][1:] * np.stack([n1, n2, known - n1 - n2])).sum(axis=0) / np.maximum(total, 1), 1.0)
    most = max(max(v) for v in sums.values())
    # What the words met leave over is shared among them and one that stands for all others.
    uniform = left / (known + 1)

    def run(key: tuple[pa.Scalar, ...], one: pa.Table, told: pa.Table) -> pa.Table:
        text = _Text(one.select(["half", "lengths", "trusted", "tokens"]).to_pylist()[0])
        model = (1 - text.half[text.doc]).astype(np.int64)
        p = uniform[model]
        found: tuple = ()
        for order in (1, 2, 3):
            _, _, place, before = text.grams(order, shards)
            mine = told.filter(pa.array(told["order"].to_numpy() == order)).sort_by("shard")
            width = 2 if order == ORDER else STATS
            stats = np.concatenate([_open(x.as_py(), "<i8").reshape(width, -1).astype("<i4" if most < 1 << 31 else "<i8") for x in mine["stats"]], axis=1)
            d = cut[order][:, model]
            n = stats[model, place]
            whole = total[model]
            if order > 1:
                lower, context = found  # the run of one symbol less that ends before the place
                rows = 2 + 4 * model
                whole, c1, c2, c3 = (lower[rows + j, context] for j in range(4))
                p *= np.where(whole > 0, (d[1] * c1 + d[2] * c2 + d[3] * c3) / np.maximum(whole, 1), 1.0)
            found = stats, before
            p = p + np.where(n > 0, _share(n, whole, d), 0.0)
        del found
        sums_ = np.bincount(text.doc, np.log2(p), len(text.lengths))
        out = {"doc_id": one["ids"].combine_chunks().flatten(), "text_hash": one["texts"].combine_chunks().flatten(), "word_log2p": pa.array(sums_)}
        give_back()
        return pa.table(out)

    told = answers.where("block is not null").select("block", "shard", "order", "stats")
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, f"doc_id {kind}, text_hash long, word_log2p double")


def word_scores(documents: DataFrame, trusted: DataFrame, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id, text_hash, word_log2p`` for every row of ``documents`` (``doc_id, text``): the sum of the log2 probabilities of its words and
    its end, under the model of the trusted texts whose ids are in the other half.

    ``trusted``: distinct ids, as ``__id``; rows of a trusted id count as often as they stand. ``text_hash`` is ``xxhash64(text)``. A null or empty text is
    its end. Without trusted texts in a half its model gives every word probability 1. No rows give no rows. Runs jobs.
    """
    blocks = kept_packed(_blocks(documents, block_bytes), "word-blocks")
    shards = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // shard_tokens + 1
    words = kept_packed(_numbered(blocks, shards), "word-numbers")
    texts = kept_packed(_numbered_texts(blocks, words, trusted), "word-texts")
    unpin(blocks)
    unpin(words)
    sums, answers, last = {}, [], None
    for order in (3, 2, 1):
        sent = _asked(texts, order, shards)
        if last is not None:
            sent = sent.unionByName(last.where("keys is not null"))
        out = kept_packed(_summed(sent, order, shards), f"word-order{order}")
        found = [r[0] for r in out.where("sums is not null").select("sums").toLocalIterator()]  # one row of each shard
        sums[order] = np.sum([[0] * 12, *found], axis=0).tolist()
        answers.append(kept_packed(out.where("block is not null").select("block", "shard", F.lit(order).alias("order"), "stats"), "word-answers"))
        if last is not None:
            unpin(last)
        last = out
    unpin(last)
    told = answers[0].unionByName(answers[1]).unionByName(answers[2])
    scores = kept_packed(_scores(texts, told, sums, shards), "word-scores")
    for table in (texts, *answers):
        unpin(table)
    return scores
