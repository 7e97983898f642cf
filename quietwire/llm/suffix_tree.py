"""Language-model scores by a probabilistic suffix tree over words.

The tree's states are contexts of words, of any length. A context that stands at least ``LEAST`` times before
another token is tested against its parent, the context without its oldest word, where that one is a state (the root always is): it becomes
a state if its next-token distribution gains more log-likelihood over the parent's than half a log of all training tokens for each
successor it keeps. A state keeps the successors met at least ``LEAST`` times, discounted; all others share what is left, by the
parent's distribution. Every token is predicted by the longest state that is a suffix of what came before. No share
of the corpus is asked of a word or a context, and lengths grow until no context passes.

Texts are read once, in blocks. Each level counts the (context, next) pairs of all blocks by shuffle: a block sends its distinct
pairs, packed, to the shards of the contexts (a context of many tokens is dealt to all shards by its pairs), and gets back
their new probabilities. Only places whose context is a state with something left to gain go on to the next level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quietwire.llm.common import Words, give_back, kept_packed, mix, slices
from quietwire.scratch import unpin

BLOCK_BYTES = 8 << 20
SHARD_TOKENS = 2 << 20
"""Tokens for each shard, about."""

LEAST = 2
"""What is met once is no evidence of a distribution."""

DISCOUNT = 0.5

HOT_SHARE = 1000
"""Contexts that are at least one in so many of all tokens (so there are at most so many) are dealt to all shards."""

END_WORD = np.uint64(0x0E0D0E0D0E0D0E0D)
"""Stands for the end token (no word's hash by any likelihood that matters)."""

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BEGIN = np.uint64(0xFFFFFFFFFFFFFFFF)
_ANY = np.uint64(0)
"""No word's number. Stands for the next tokens whose run with a shorter context was met once: no longer context keeps them, whichever they are."""

SCALE = 1 << 16
PIECE = 1 << 17
"""Places whose contexts are hashed at once."""

_GO_ON, _STATE, _ONCE, _MANY = 1, 2, 4, 8


def _pack(values: np.ndarray) -> bytes:
    """Compressed by byte planes: high bytes are mostly alike."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _open(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def _steps(logs: np.ndarray) -> np.ndarray:
    """Natural logs of probabilities as they are stored and sent: whole numbers of ``SCALE`` to one."""
    return np.rint(logs * SCALE).astype("<i4")


def _logs(steps: np.ndarray) -> np.ndarray:
    return steps.astype(np.float64) / SCALE


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _mixed(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(state * _STEP + word)


def _blocks(documents: DataFrame, held: Column, block_bytes: int) -> DataFrame:
    """Per block: its documents (ids, flags, ends), its tokens as numbers of words, the words' hashes and training counts."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    given = documents.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        parts: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ids = pa.concat_arrays([p[0] for p in parts])
            out, hashes = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            lengths = np.concatenate([p[3] for p in parts])
            codes, words = pd.factorize(hashes)
            counts = np.bincount(codes[np.repeat(~out, lengths)], minlength=len(words))
            order = np.argsort(-np.bincount(codes), kind="stable")  # small numbers for frequent words
            place = np.empty(len(words), dtype=np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            row = {
                "block": pa.array([(task << 20) + number], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "held": pa.array([_pack(out.astype(np.uint8))], pa.binary()),
                "lengths": pa.array([_pack(lengths.astype("<i8"))], pa.binary()),
                "tokens": pa.array([_pack(place[codes].astype("<i4"))], pa.binary()),
                "words": pa.array([_pack(words[order])], pa.binary()),
                "counts": pa.array([_pack(counts[order].astype("<i8"))], pa.binary()),
                "n": pa.array([int(lengths[~out].sum())], pa.int64()),
                "texts": pa.array([int((~out).sum())], pa.int64()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            flags = batch.column("held").fill_null(False).to_numpy(zero_copy_only=False)
            for at, data, bounds in slices(batch.column("text")):
                words, n = Words(data, bounds), len(bounds) - 1
                # Each text's words, then its end token.
                ends = words.first[1:] + np.arange(1, n + 1)
                place = np.ones(len(words.start) + n, dtype=bool)
                place[ends - 1] = False
                hashes = np.full(len(place), END_WORD)
                hashes[place] = words.hash
                parts.append((batch.column("doc_id").slice(at, n), flags[at : at + n], hashes, np.diff(np.concatenate([[0], ends]))))
                size += len(data)
                if size >= block_bytes:
                    yield closed()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield closed()
        parts = []
        give_back()

    schema = f"block long, ids array<{kind}>, held binary, lengths binary, tokens binary, words binary, counts binary, n long, texts long"
    return documents.select(given.name, "text", held.alias("held")).mapInArrow(run, schema)


def _numbered(blocks: DataFrame, shards: int) -> DataFrame:
    """``block, shard, places, numbers, totals, known``: of the words at those places of a block's list, a number that is the word's own and
    the count in all training texts; ``known``: on one row of each shard, its words met in training."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, w, c in zip(batch.column("block"), batch.column("words"), batch.column("counts"), strict=True):
                words, counts = _open(w.as_py(), "<u8"), _open(c.as_py(), "<i8")
                shard = _shard(words, shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts))
                places = [order[cuts[s] : cuts[s + 1]] for s in some]
                yield pa.record_batch(
                    [
                        pa.array(some.astype(np.int32)),
                        pa.array(np.full(len(some), block.as_py())),
                        pa.array([_pack(np.diff(x, prepend=0).astype("<i4")) for x in places], pa.binary()),
                        pa.array([_pack(words[x]) for x in places], pa.binary()),
                        pa.array([_pack(counts[x]) for x in places], pa.binary()),
                    ],
                    names=["shard", "block", "places", "words", "counts"],
                )

    def number(table: pa.Table) -> pa.Table:
        words = [_open(x.as_py(), "<u8") for x in table["words"]]
        counts = np.concatenate([_open(x.as_py(), "<i8") for x in table["counts"]])
        codes, distinct = pd.factorize(np.concatenate(words))
        totals = np.bincount(codes, counts, len(distinct)).astype(np.int64)
        rank = np.empty(len(distinct), dtype=np.int64)
        rank[np.argsort(-totals, kind="stable")] = np.arange(len(distinct))
        own = rank[codes] * shards + table["shard"][0].as_py()
        cuts = np.cumsum([len(x) for x in words])[:-1]
        known = np.zeros(len(words), dtype=np.int64)
        known[0] = (totals > 0).sum()
        return pa.table(
            {
                "block": table["block"],
                "shard": table["shard"],
                "places": table["places"],
                "numbers": pa.array([_pack(x) for x in np.split(own, cuts)], pa.binary()),
                "totals": pa.array([_pack(x) for x in np.split(totals[codes], cuts)], pa.binary()),
                "known": pa.array(known),
            }
        )

    sent = blocks.select("block", "words", "counts").mapInArrow(send, "shard int, block long, places binary, words binary, counts binary")
    return sent.groupBy("shard").applyInArrow(number, "block long, shard int, places binary, numbers binary, totals binary, known long")


class _Block:
    """A block's tokens and what is known of its places: the natural log of each one's probability, and which go on.

    ``once``: places where a run of tokens ends that is met less than ``LEAST`` times in training, so longer ones are, too.
    ``many``: places where a run of ``length`` tokens ends that is a hot context.
    """

    def __init__(self, tokens: pa.Table, words: pa.Table):
        row = {c: tokens[c][0].as_py() for c in ("held", "lengths", "tokens")}
        places = np.concatenate([np.cumsum(_open(x.as_py(), "<i4")) for x in words["places"]])
        numbers, totals = np.empty(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        numbers[places] = np.concatenate([_open(x.as_py(), "<i8") for x in words["numbers"]])
        if "totals" in words.column_names:  # they are used up with the first length
            totals[places] = np.concatenate([_open(x.as_py(), "<i8") for x in words["totals"]])
        local = _open(row["tokens"], "<i4")
        self.word = numbers[local].view(np.uint64) + np.uint64(1)
        self.total = totals[local]
        self.lengths = _open(row["lengths"], "<i8")
        self.held = _open(row["held"], "<u1").astype(bool)
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        self.learned = np.repeat(~self.held, self.lengths)
        self.offset = np.arange(len(self.word), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.lengths)

    def root(self, total: int, known: int) -> np.ndarray:
        return np.log(self.total + 1.0) - np.log(total + known + 1.0)

    def contexts(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the ``length`` tokens before the places ``at``, of which the begin of the text may be the first."""
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(1, length + 1):
            older = np.where(self.offset[at] >= k, self.word[np.maximum(at - k, 0)], _BEGIN)
            out = _mixed(out, older)
        return out

    def pairs(self, at: np.ndarray, once: np.ndarray, hot: np.ndarray, length: int, shards: int) -> tuple[np.ndarray, ...]:
        """Distinct (context, next) pairs in the order they are sent in: first place of each, its context, next, shard (odd: of a hot
        context) and training count; and the pair of each place.

        Sorted, not hashed: a table of a block's pairs would be several times as large as they are.
        """
        context, key = np.empty(len(at), dtype=np.uint64), np.empty(len(at), dtype=np.uint64)
        word = self.word[at]
        word[once[at]] = _ANY
        for x in range(0, len(at), PIECE):
            part = slice(x, x + PIECE)
            context[part] = self.contexts(at[part], length)
            key[part] = _mixed(context[part], word[part])
        by_key = np.argsort(key)
        key = key[by_key]
        opens = np.append(True, key[1:] != key[:-1])
        first, key = by_key[opens], key[opens]
        pair = np.empty(len(at), dtype=np.int32)
        pair[by_key] = np.cumsum(opens, dtype=np.int32) - 1
        del by_key, opens
        # Sent by shard, then context, then key: the same order wherever it is found again. Shards follow contexts where these aren't hot.
        context, word, many = context[first], word[first], hot[first]
        shard = _shard(np.where(many, key, context), shards).astype(np.int32) * 2 + many
        cold, dealt = np.flatnonzero(~many), np.flatnonzero(many)
        cold = cold[np.argsort(context[cold], kind="stable")]
        dealt = dealt[np.lexsort((context[dealt], shard[dealt]))]
        order = np.concatenate([cold, dealt])
        order = order[np.argsort(shard[order], kind="stable")]
        del cold, dealt, many, key
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        pair = place[pair]
        counts = np.bincount(pair, self.learned[at], len(order)).astype(np.int32)
        return first[order], context[order], word[order], shard[order], counts, pair


_SENT = "block long, state binary, places binary, logs binary, once binary, hot binary, going long, shard int, contexts binary, sizes binary, next binary, counts binary"


def _level_rows(block: int, state: np.ndarray, b: _Block, at: np.ndarray, logs: np.ndarray, once: np.ndarray, hot: np.ndarray, length: int, shards: int) -> pa.Table:
    """What a block carries on (one row without a shard), and its pairs for each shard. Logs are sent negated; those of a pair of one next
    token come back with the answer, so only the others are carried on."""
    rows: dict[str, list] = {f.split()[0]: [] for f in _SENT.split(", ")}

    def add(**values: object) -> None:
        for name, column in rows.items():
            column.append(values.get(name))

    add(
        block=block,
        state=_pack(state),
        places=_pack(np.diff(at, prepend=0).astype("<i8")),
        logs=_pack(-logs[once[at]]) if length > 1 else None,
        once=_pack(np.packbits(once)),
        hot=_pack(np.packbits(hot)),
        going=len(at),
    )
    if len(at):
        first, context, word, shard, counts = b.pairs(at, once, hot, length, shards)[:-1]
        value = np.where(word == _ANY, 0, -logs[first]).astype("<i4")
        del first
        cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
        for x, y in zip(cuts, cuts[1:], strict=False):
            c = context[x:y]
            opens = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            add(
                block=block,
                shard=int(shard[x]),
                contexts=_pack(np.diff(c[opens], prepend=np.uint64(0))),
                sizes=_pack(np.diff(np.append(opens, y - x)).astype("<i4")),
                next=_pack(word[x:y]),
                counts=_pack(counts[x:y].astype("<i4")),
                logs=_pack(value[x:y]),
            )
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = dict(f.split() for f in _SENT.split(", "))
    return pa.table({c: pa.array(v, kinds[types[c]]) for c, v in rows.items()})


def _first_level(tokens: DataFrame, words: DataFrame, total: int, known: int, texts: int, shards: int) -> DataFrame:
    """State of the documents (rows: known tokens, base score, score of the finished places) and all pairs of a word and the next."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(left, right)
        logs = b.root(total, known)
        state = np.stack([np.add.reduceat((b.total > 0).astype(np.float64), b.starts), np.add.reduceat(logs, b.starts), np.zeros(len(b.starts))])
        once = b.total < LEAST
        before = np.append(False, once[:-1])
        before[b.starts] = texts < LEAST
        going = ~before
        state[2] = np.add.reduceat(np.where(going, 0.0, logs), b.starts)
        least = hot_least(total)
        hot = np.append(False, b.total[:-1] >= least)
        hot[b.starts] = texts >= least
        at = np.flatnonzero(going)
        return _level_rows(key[0].as_py(), state.ravel(), b, at, _steps(logs[at]), once, hot[at], 1, shards)

    return tokens.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, _SENT)


def hot_least(total: int) -> int:
    return max(LEAST, -(-total // HOT_SHARE))


def _shard_counts(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a shard's rows: the pair of each sent one, and of each pair the context's number, training count, log under the parent, and whether
    it is of one next token; contexts."""
    sizes = np.concatenate([_open(x.as_py(), "<i4") for x in table["sizes"]])
    context = np.repeat(np.concatenate([np.cumsum(_open(x.as_py(), "<u8"), dtype=np.uint64) for x in table["contexts"]]), sizes)
    words = np.concatenate([_open(x.as_py(), "<u8") for x in table["next"]])
    counts = np.concatenate([_open(x.as_py(), "<i4") for x in table["counts"]])
    logs = -np.concatenate([_open(x.as_py(), "<i4") for x in table["logs"]])
    codes, distinct = pd.factorize(_mixed(context, words))
    first = np.empty(len(distinct), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    totals = np.bincount(codes, counts, len(distinct)).astype(np.int64)
    of, contexts = pd.factorize(context[first])
    return codes, of, totals, _logs(logs[first]), words[first] != _ANY, contexts


_SUMS = ("met", "kept", "held", "gain", "left", "parent")


def _sums(of: np.ndarray, totals: np.ndarray, logs: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
    """Of each context: its tokens, kept successors, their tokens, and sums over them of n log(n - discount) less n log(parent),
    n log(n - discount), and the parent's probabilities."""
    some = one & (totals >= LEAST)
    o, n, x = of[some], totals[some].astype(np.float64), logs[some]
    own = n * np.log(n - DISCOUNT)
    columns = [(of, totals), (o, np.ones(len(o))), (o, n), (o, own - n * x), (o, own), (o, np.exp(x))]
    return np.stack([np.bincount(a, w, size) for a, w in columns])


def decide(sums: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts with those sums: whether they are states, log of what goes to other successors than the kept ones (times the
    parent's probability), and whether longer contexts may gain more than the least penalty."""
    met, kinds, held, gain, left, parent = sums
    n, unit = np.maximum(met, 1.0), 0.5 * np.log(max(total, 2))
    rest = np.log(np.maximum(1.0 - (held - DISCOUNT * kinds) / n, 1e-12)) - np.log(np.maximum(1.0 - parent, 1e-12))
    gained = gain - held * np.log(n) + (met - held) * rest
    state = (met >= LEAST) & (kinds > 0) & (gained > kinds * unit)
    return state, rest, state & (held * np.log(n) - left > unit)


def _answers(sent: DataFrame, total: int, length: int) -> DataFrame:
    """``block, shard, flags, logs``: of each block's pairs in the order sent, flags, and for those whose context is a state the new logs (of
    tokens that no longer context keeps, what is added to them). Other pairs of one next token get back the logs they came with, but with
    the first length, where these are the root's."""
    pairs = sent.where("shard is not null").select("block", "shard", "contexts", "sizes", "next", "counts", "logs")

    def partial(table: pa.Table) -> pa.Table:
        _, of, totals, logs, one, contexts = _shard_counts(table)
        sums = _sums(of, totals, logs, one, len(contexts))
        give_back()
        return pa.table({"context": pa.array(contexts.view(np.int64))} | {c: pa.array(x) for c, x in zip(_SUMS, sums, strict=True)})

    schema = ", ".join(["context long", *(f"{c} double" for c in _SUMS)])
    hot = pairs.where("shard % 2 = 1").groupBy("shard").applyInArrow(partial, schema)
    found = hot.groupBy("context").agg(*(F.sum(c).alias(c) for c in _SUMS)).toArrow()  # at most HOT_SHARE contexts
    keys = found["context"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, whole = keys[order], np.stack([found[c].to_numpy()[order] for c in _SUMS])
    least = hot_least(total)

    def run(table: pa.Table) -> pa.Table:
        codes, of, totals, logs, one, contexts = _shard_counts(table)
        if table["shard"][0].as_py() % 2:
            sums = whole[:, np.searchsorted(keys, contexts)]
        else:
            sums = _sums(of, totals, logs, one, len(contexts))
        state, rest, more = decide(sums, total)
        own = np.log(np.maximum(totals - DISCOUNT, DISCOUNT)) - np.log(np.maximum(sums[0], 1.0))[of]
        some = one & (totals >= LEAST)
        new = np.where(some, own, np.where(one, np.minimum(logs + rest[of], 0.0), rest[of]))
        new = _steps(np.where(state[of], new, logs))
        flags = (_GO_ON * more[of] + _STATE * state[of] + _ONCE * ~some + _MANY * (one & (totals >= least))).astype(np.uint8)
        of_row = [int(_open(x.as_py(), "<i4").sum()) for x in table["sizes"]]
        cuts = np.cumsum(of_row)[:-1]
        told = state[of] | (one & (length > 1))
        del logs, own, some, of, one, totals, state
        out = [(_pack(flags[c]), _pack(-new[c[told[c]]])) for c in np.split(codes, cuts)]
        give_back()
        return pa.table(
            {
                "block": table["block"],
                "shard": table["shard"],
                "flags": pa.array([f for f, _ in out], pa.binary()),
                "logs": pa.array([v for _, v in out], pa.binary()),
            }
        )

    return pairs.groupBy("shard").applyInArrow(run, "block long, shard int, flags binary, logs binary")


def _next_level(tokens: DataFrame, words: DataFrame, state: DataFrame, answers: DataFrame, length: int, shards: int, total: int, known: int) -> DataFrame:
    """Blocks with the answers to their pairs of ``length`` words and the next, and their pairs of one word more."""
    carried = state.select("block", "state", "places", "logs", "once", "hot", F.lit(0).alias("kind"))
    told = answers.select("block", "shard", "flags", F.col("logs").alias("logs"), F.lit(1).alias("kind"))
    own = words.select("block", "shard", F.col("places").alias("at"), "numbers", *(["totals"] if length == 1 else []), F.lit(2).alias("kind"))
    right = carried.unionByName(told, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        row = table.filter(pa.array(kinds == 0)).to_pylist()[0]
        b = _Block(left, table.filter(pa.array(kinds == 2)).drop_columns(["places"]).rename_columns({"at": "places"}))
        told = table.filter(pa.array(kinds == 1))
        state = _open(row["state"], "<f8").copy().reshape(3, -1)
        at = np.cumsum(_open(row["places"], "<i8"))
        once = np.unpackbits(_open(row["once"], "<u1"), count=len(b.word)).astype(bool)
        if length == 1:
            logs = _steps(b.root(total, known)[at])
        else:
            logs = np.zeros(len(at), dtype="<i4")
            logs[once[at]] = -_open(row["logs"], "<i4")
        b.total = np.zeros(0, dtype=np.int64)
        hot = np.unpackbits(_open(row["hot"], "<u1"), count=len(at)).astype(bool)
        go_on, many = np.zeros(len(b.word), dtype=bool), np.zeros(len(b.word), dtype=bool)
        value = np.zeros(len(b.word))
        if len(at):
            _, _, word, _, _, pair = b.pairs(at, once, hot, length, shards)
            order = np.argsort(told["shard"].to_numpy())
            flags = np.concatenate([_open(told["flags"][int(i)].as_py(), "<u1") for i in order])
            given = ((flags & _STATE) > 0) | ((word != _ANY) & (length > 1))
            new = np.zeros(len(flags), dtype="<i4")
            new[given] = -np.concatenate([_open(told["logs"][int(i)].as_py(), "<i4") for i in order])
            flags, new, given = flags[pair], new[pair], given[pair]
            logs = np.where(given, np.where(once[at], np.minimum(logs + new, 0), new), logs)
            del new, pair, given, word
            go_on[at], many[at], value[at] = (flags & _GO_ON) > 0, (flags & _MANY) > 0, _logs(logs)
            once[at] |= (flags & _ONCE) > 0
        # A longer context stands before the begin of no text, and not where the run that it is was met once.
        go_on &= (b.offset >= length) & ~np.append(False, once[:-1])
        finished = at[~go_on[at]]
        np.add.at(state[2], np.searchsorted(b.starts, finished, side="right") - 1, value[finished])
        going = np.flatnonzero(go_on)
        steps, hot = _steps(value[going]), np.append(False, many)[going]
        del table, told, at, logs, finished, go_on, many, value
        give_back()
        return _level_rows(key[0].as_py(), state.ravel(), b, going, steps, once, hot, length + 1, shards)

    return tokens.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, _SENT)


def score_texts(documents: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Log10 probabilities of all texts, under a tree learned from the rows where ``held_out`` isn't true.

    Input: ``doc_id, text``; other columns are not read. Returns one row per input row: ``doc_id,
    held_out, n_tokens`` (words and the end), ``n_known`` (tokens met in training), ``train_tokens``,
    ``base_score`` (add-one unigram model, which is the tree's root) and ``score``.

    A null or empty text is its end token. Repeated rows count as often as they stand. Without training
    rows every token is unknown; no rows give no rows. Runs jobs, some for each length of contexts.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    blocks = kept_packed(_blocks(documents, F.coalesce(held_out, F.lit(False)), block_bytes), "blocks")
    total, texts = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    shards = total // shard_tokens + 1
    words = kept_packed(_numbered(blocks, shards), "words")
    known = words.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    counted, blocks = blocks, kept_packed(blocks.select("block", "ids", "held", "lengths", "tokens"), "tokens")
    unpin(counted)
    tokens = blocks.select("block", "held", "lengths", "tokens")
    sent, length = kept_packed(_first_level(tokens, words, total, known, texts, shards), "level"), 1
    while sent.where("going > 0").limit(1).count():
        # Pairs are many: they go before the next ones are written.
        answers, state = kept_packed(_answers(sent, total, length), "answers"), kept_packed(sent.where("shard is null"), "state")
        unpin(sent)
        sent, length = kept_packed(_next_level(tokens, words, state, answers, length, shards, total, known), "level"), length + 1
        unpin(answers)
        unpin(state)
    ended = sent.where("shard is null").select("block", "state")

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["ids"].combine_chunks().flatten()
        met, base, score = _open(right["state"][0].as_py(), "<f8").reshape(3, -1)
        n = len(ids)
        columns = {
            "doc_id": ids,
            "held_out": pa.array(_open(left["held"][0].as_py(), "<u1").astype(bool)),
            "n_tokens": pa.array(_open(left["lengths"][0].as_py(), "<i8")),
            "n_known": pa.array(met.astype(np.int64)),
            "train_tokens": pa.array(np.full(n, total, dtype=np.int64)),
            "base_score": pa.array(base / np.log(10)),
            "score": pa.array(score / np.log(10)),
        }
        return pa.table(columns)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select("block", "ids", "held", "lengths").groupBy("block").cogroup(ended.groupBy("block")).applyInArrow(run, schema)
