"""Alignment of two tokenizers' tokens by the bytes they cover.

Both tokenizers cut the same bytes (a space and the text). Offsets where tokens of both end cut them into groups; the
tokens of a group are linked, all with all. The cuts come from the two arrays of token ends by diagonal run skipping: while the ends
agree at the current shift of indices, probes of doubling length jump the one-to-one stretch; where they disagree, the
irregular group is resolved by stepping the smaller end, which sets the new shift.

Neither tokenizer joins across a space that follows a non-space and leads an ASCII letter, so a text's tokens are those
of its stretches between such places, and every such place is a cut. A worker encodes and aligns the distinct stretches
it meets once and puts texts together from them.

Corpus-wide numbers are sharded: a block of texts sends each of its distinct id pairs once, with its number of documents;
pairs are summed, joined with the highest sum of their A id, and sent back to the blocks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quietwire.llm.common import kept, slices

KNOWN_BYTES = 100 << 20
"""A worker forgets its stretches when they take about so much memory; results don't depend on it."""

BLOCK_BYTES = 4 << 20
SMALL_GROUP = 1024
"""Links of a group beyond so many are counted by distinct ids instead of one by one."""

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""How a byte-level tokenizer splits text before it merges (a fixed value of that format)."""

CHUNK = 2_000
"""Stretches that are encoded as one text: a call has its price, a place between two of them none."""

# Between a byte that is no white space and a space that leads an ASCII letter.
_CUT = re.compile(rb"(?<=[^\x09-\x0D\x20])(?= [A-Za-z])")
# Bytes of ASCII and of Latin-1 letters.
_LATIN = bytes([*range(128), 0xC3, *range(0x80, 0xC0)])
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def diagonal_runs(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups of two increasing lists of ends with the same last end.

    Returns ``(i, j, na, nb)``: a group of ``na`` and ``nb`` tokens from ``i`` and ``j``, or, where ``na`` is negative, a
    run of ``-na`` groups of one token each.
    """
    out, i, j, n = [], 0, 0, len(a)
    while i < n:
        if a[i] == b[j]:
            size = 1
            while a[i + size : i + 2 * size] == b[j + size : j + 2 * size] and i + size < n:
                size = min(2 * size, n - i)
            # All of the first ``size`` agree; the first disagreement lies within as many more.
            low, high = size, min(2 * size, n - i, len(b) - j)
            while low < high:
                mid = (low + high + 1) // 2
                if a[i + low : i + mid] == b[j + low : j + mid]:
                    low = mid
                else:
                    high = mid - 1
            out.append((i, j, -low, low))
            i, j = i + low, j + low
        else:
            p, q = i, j
            while a[p] != b[q]:
                if a[p] < b[q]:
                    p += 1
                else:
                    q += 1
            out.append((i, j, p + 1 - i, q + 1 - j))
            i, j = p + 1, q + 1
    return out


def _is_plain(unit: bytes) -> bool:
    """Leads with a space and a letter, ends in no white space, all ASCII or Latin-1 letters."""
    return unit[1:2].isalpha() and unit[:1] == b" " and not unit[-1:].isspace() and not unit.translate(None, _LATIN)


class _Vocabulary:
    """Bytes of every id, one after another."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.names = [str(i) for i in range(len(tokens))]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)]


class Aligner:
    """Aligned stretches of text, by their number; ``meet`` learns those of some texts."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_words = _Vocabulary(
            [bytes(alphabet.get(c, 0x3F) for c in names.get(i, "")) for i in range(max(names) + 1)]
        )
        with open(a_path, encoding="utf-8") as file:
            merges = [m.split(" ") if isinstance(m, str) else m for m in json.load(file)["model"]["merges"]]
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        # Where ids follow the merges, ranks give the same ids, several times faster. Both split Latin text alike; other
        # scripts, whose character classes depend on the version of Unicode, go through the tokenizer itself.
        self.ranks = None
        if all(vocabulary[x + y] == len(alphabet) + i for i, (x, y) in enumerate(merges)):
            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if all(c in alphabet for c in t)}
            ranks = {t: i for t, i in ranks.items() if i < len(alphabet) + len(merges)}
            self.ranks = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on behind a space: texts can't be cut there")
        self.b_words = _Vocabulary(
            [
                bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(pieces)
            ]
        )
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.spent = 0
        self.groups: list[bytes] = []  # as text
        self.numbers = np.zeros((5, 0), dtype=np.int64)  # differs, A tokens, B tokens, groups, links
        self.pairs, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.first, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def meet(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of all texts, and bounds of the texts in them; an empty text has none."""
        if self.spent > KNOWN_BYTES:
            self.forget()
        known, new, found, bounds = self.known, [], [], [0]
        for text in texts:
            if text:
                for unit in _CUT.split(b" " + text):
                    k = known.get(unit)
                    if k is None:
                        k = known[unit] = len(known)
                        new.append(unit)
                    found.append(k)
            bounds.append(len(found))
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        return np.array(found, dtype=np.int64), np.array(bounds, dtype=np.int64)

    def _a_ids(self, texts: list[str], plain: bool) -> list[list[int]]:
        if plain and self.ranks is not None:
            return [self.ranks.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _b_ids(self, texts: list[str], plain: bool) -> list[list[int]]:
        return self.b.encode([t[1:] for t in texts], num_threads=1)

    def _encoded(self, units: list[bytes], plain: int, words: _Vocabulary, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all stretches in a row, how many each has, and which ones' ids don't give back its bytes.

        The first ``plain`` stretches lead with a space and a letter and end in no white space, so they can be
        encoded in one text. A text that doesn't come back as it was is encoded stretch by stretch.
        """
        cuts = [(at, min(at + CHUNK, plain)) for at in range(0, plain, CHUNK)]
        cuts += [(at, at + 1) for at in range(plain, len(units))]
        texts = [b"".join(units[x:y]) for x, y in cuts]
        parts, counts, differs = [], np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=bool)
        several = -(-plain // CHUNK)
        found = encode([t.decode() for t in texts[:several]], True)
        found += encode([t.decode() for t in texts[several:]], False)
        for (x, y), text, ids in zip(cuts, texts, found, strict=True):
            ids = np.array(ids, dtype=np.int64)
            if words.joined(ids).tobytes() == text:
                at = np.searchsorted(np.cumsum(words.size[ids]), np.cumsum([len(u) for u in units[x:y]]))
                counts[x:y] = np.diff(at, prepend=-1)
                parts.append(ids)
                continue
            for k, own in zip(range(x, y), [ids] if y - x == 1 else encode([u.decode() for u in units[x:y]], False), strict=True):
                own = np.array(own, dtype=np.int64)
                counts[k], differs[k] = len(own), words.joined(own).tobytes() != units[k]
                parts.append(own)
        return np.concatenate(parts), counts, differs

    def _learn(self, units: list[bytes]) -> None:
        simple = np.array([_is_plain(u) for u in units])
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        units, plain = [units[k] for k in order.tolist()], int(simple.sum())
        a, a_n, differs = self._encoded(units, plain, self.a_words, self._a_ids)
        b, b_n, unlike = self._encoded(units, plain, self.b_words, self._b_ids)
        differs |= unlike
        good = ~differs
        a_own, b_own = np.repeat(np.arange(len(units)), a_n), np.repeat(np.arange(len(units)), b_n)
        a, a_own, b, b_own = a[good[a_own]], a_own[good[a_own]], b[good[b_own]], b_own[good[b_own]]
        # All good stretches in a row: each ends where tokens of both end.
        runs = diagonal_runs(np.cumsum(self.a_words.size[a]).tolist(), np.cumsum(self.b_words.size[b]).tolist())
        i, j, na, nb = np.array(runs, dtype=np.int64).reshape(-1, 4).T
        many = np.where(na < 0, -na, 1)
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        i, j = np.repeat(i, many) + within, np.repeat(j, many) + within
        na, nb = np.repeat(np.where(na < 0, 1, na), many), np.repeat(np.where(na < 0, 1, nb), many)
        own = a_own[i]
        links = na * nb
        small = links <= SMALL_GROUP
        step = np.repeat(np.cumsum(links * small) - links * small, links * small)
        step = np.arange(len(step)) - step
        g = np.repeat(np.arange(len(i)), links * small)
        codes = a[i[g] + step // nb[g]] << 32 | b[j[g] + step % nb[g]]
        parts, times, owners = [codes], [np.ones(len(codes), dtype=np.int64)], [own[g]]
        for k in np.flatnonzero(~small).tolist():
            x, xn = np.unique(a[i[k] : i[k] + na[k]], return_counts=True)
            y, yn = np.unique(b[j[k] : j[k] + nb[k]], return_counts=True)
            parts.append((x[:, None] << 32 | y[None, :]).ravel())
            times.append((xn[:, None] * yn[None, :]).ravel())
            owners.append(np.full(len(x) * len(y), own[k]))
        codes, mult, owner = np.concatenate(parts), np.concatenate(times), np.concatenate(owners)
        sort = np.argsort(owner, kind="stable") if not small.all() else slice(None)
        count = np.bincount(owner, minlength=len(units))
        self.first = np.concatenate([self.first, (len(self.pairs) + np.cumsum(count) - count)[place]])
        self.count = np.concatenate([self.count, count[place]])
        self.pairs = np.concatenate([self.pairs, codes[sort]])
        self.times = np.concatenate([self.times, mult[sort]])
        per = lambda w: np.bincount(own, w, len(units)).astype(np.int64)
        numbers = np.stack([differs.astype(np.int64), per(na), per(nb), per(np.ones(len(own))), per(links)])
        self.numbers = np.concatenate([self.numbers, numbers[:, place]], axis=1)
        names_a, names_b = self.a_words.names, self.b_words.names
        a_names, b_names = [names_a[x] for x in a.tolist()], [names_b[x] for x in b.tolist()]
        shown = [
            f"{a_names[p]}|{b_names[q]}"
            if m == n == 1
            else f"{','.join(a_names[p : p + m])}|{','.join(b_names[q : q + n])}"
            for p, q, m, n in zip(i.tolist(), j.tolist(), na.tolist(), nb.tolist(), strict=True)
        ]
        cuts = np.searchsorted(own, np.arange(len(units) + 1)).tolist()
        self.groups += [";".join(shown[cuts[k] : cuts[k + 1]]).encode() for k in place.tolist()]
        self.spent += sum(map(len, units)) + sum(map(len, shown)) + 16 * len(codes) + 300 * len(units)


def aligner(a_path: str, b_path: str) -> Aligner:
    key = (a_path, b_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_path, b_path)
    return _ALIGNERS[key]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = (
    "block long, doc_id array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, links binary, pair array<long>, docs array<long>"
)


def _block(own: Aligner, texts: list[bytes]) -> tuple[list[np.ndarray], list[str], bytes, np.ndarray, np.ndarray]:
    """Of some texts: their numbers, group hashes, links (packed), distinct pairs and in how many texts those are."""
    found, bounds = own.meet(texts)
    bad = _sums(own.numbers[0][found], bounds) > 0
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    numbers = [np.where(bad, 0, _sums(own.numbers[k][found], bounds)) for k in range(1, 5)]
    shown = [
        hashlib.sha256(b";".join([own.groups[k] for k in found[x:y].tolist()])).hexdigest() if y > x and not b else ""
        for x, y, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), bad.tolist(), strict=True)
    ]
    use = ~bad[doc]
    found, doc = found[use], doc[use]
    count = own.count[found]
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(own.first[found] - (ends - count), count)
    pairs, inverse = np.unique(own.pairs[at], return_inverse=True)
    key = np.repeat(doc, count) * max(len(pairs), 1) + inverse
    key, place = np.unique(key, return_inverse=True)
    times = np.bincount(place, own.times[at], len(key)).astype(np.int64)
    of, pair = np.divmod(key, max(len(pairs), 1))
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    packed = np.concatenate([[len(key)], first, pair, times]).astype("<i8").tobytes()
    return numbers, shown, zstandard.ZstdCompressor(level=1).compress(packed), pairs, np.bincount(pair, minlength=len(pairs))


def align_documents(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Both tokenizers' tokens of every text, aligned, with how common their links are in the corpus.

    ``a_path``: a byte-level vocabulary for ``tokenizers``; ``b_path``: a model for ``sentencepiece`` that puts a space in
    front. Input: ``doc_id, text``; other columns are not read. Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256``: a pair's count is the number of rows whose text links it, ``n_best`` are links whose count is the highest of
    their A id (ties included), ``count_sum`` adds up the counts of all links.

    A null or empty text, and one whose tokens don't give back its bytes, has zeros and an empty hash. Repeated rows count
    each; a null id stays null. Texts of any length are aligned whole. An empty table gives an empty table. Runs
    jobs: the blocks are written to the shared scratch folder.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for at, data, bounds in slices(batch.column("text"), BLOCK_BYTES):
                whole, cut = data.tobytes(), bounds.tolist()
                texts = [whole[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                numbers, shown, links, pairs, docs = _block(own, texts)
                ids = batch.column("doc_id").slice(at, len(texts))
                one = lambda x, t=pa.int64(): pa.array([x], pa.list_(t))
                yield pa.record_batch(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), ids),
                        *[one(x) for x in numbers],
                        one(shown, pa.string()),
                        pa.array([links], pa.binary()),
                        one(pairs),
                        one(docs),
                    ],
                    names=["block", "doc_id", *NUMBERS, "groups_sha256", "links", "pair", "docs"],
                )
                number += 1

    blocks = kept(
        documents.select("doc_id", "text").mapInArrow(align, BLOCKS.format(id=kind)), "aligned-blocks"
    )
    met = blocks.select("block", F.posexplode(F.arrays_zip("pair", "docs")).alias("at", "x")).select(
        "block", "at", "x.pair", "x.docs"
    )
    totals = kept(met.groupBy("pair").agg(F.sum("docs").alias("total")), "pair-totals")
    a_id = F.shiftright("pair", 32)
    # At most one row for each id of the first vocabulary.
    best = totals.groupBy(a_id.alias("a")).agg(F.max("total").alias("highest"))
    marked = totals.join(F.broadcast(best), a_id == F.col("a")).select(
        "pair", F.when(F.col("total") == F.col("highest"), -F.col("total")).otherwise(F.col("total")).alias("total")
    )
    back = met.drop("docs").join(marked.hint("merge"), "pair").select(F.col("block").alias("of"), "at", "total")

    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def finish(own: pa.Table, totals: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        total = np.zeros(totals.num_rows, dtype=np.int64)
        total[totals["at"].to_numpy()] = totals["total"].to_numpy()
        (links,) = own["links"].to_pylist()
        packed = np.frombuffer(zstandard.ZstdDecompressor().decompress(links), dtype="<i8")
        ids = own["doc_id"].chunk(0).flatten()
        n, size = int(packed[0]), len(ids)
        first, pair, times = packed[1 : size + 2], packed[size + 2 : size + 2 + n], packed[size + 2 + n :]
        lists = [own[c].chunk(0).flatten() for c in (*NUMBERS, "groups_sha256")]
        return pa.table(
            {
                "doc_id": ids,
                **dict(zip(NUMBERS, lists, strict=False)),
                "n_best": pa.array(_sums(times * (total[pair] < 0), first), pa.int64()),
                "count_sum": pa.array(_sums(times * np.abs(total[pair]), first), pa.int64()),
                "groups_sha256": lists[-1],
            }
        )

    given = blocks.select("block", "doc_id", *NUMBERS, "groups_sha256", "links")
    return given.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(finish, out)
