"""Token ids of whole texts, word by word.

The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in
a row; the same holds between a letter or digit and the punctuation that ends a word. Each worker
keeps the ids of the words it has met, which saves most of the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quietwire.llm.common import Words, slices

MOST_WORDS = 300_000
"""A worker forgets its words when it holds so many; ids don't depend on it."""

_MARK = "\x01"
_ENCODERS: dict[str, WordEncoder] = {}

_POINT = np.zeros(256, dtype=bool)
_POINT[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_C3 = 0xC3  # leads the two bytes of the Latin-1 letters (and of two signs)


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and for each text the first unit: words, with closing points apart.

    Points are parted only from an ASCII letter or digit or a Latin-1 letter, where the pre-tokenizer
    parts them as well.
    """
    data, end = words.data, words.end.copy()
    ending = np.flatnonzero(_POINT[data[end - 1]])
    left, right, some = words.start[ending], end[ending], np.arange(len(ending))
    for _ in range(8):
        some = some[(right[some] - left[some] > 1) & _POINT[data[right[some] - 1]]]
        right[some] -= 1
    last = data[right - 1]
    plain = _LETTER[last] | _DIGIT[last]
    plain |= (right - left > 1) & (data[np.maximum(right - 2, 0)] == _C3) & (last != 0x97) & (last != 0xB7)
    end[ending] = right
    cut = np.zeros(len(end), dtype=bool)
    cut[ending] = plain & (right < words.end[ending])
    n = len(end)
    place = np.arange(n) + np.cumsum(cut) - cut
    starts = np.empty(n + int(cut.sum()), dtype=np.int64)
    ends = np.empty_like(starts)
    starts[place], ends[place] = words.start, np.where(cut, end, words.end)
    starts[place[cut] + 1], ends[place[cut] + 1] = end[cut], words.end[cut]
    firsts = np.append(place, len(starts))[words.first]
    return starts, ends, firsts


def _all_in(good: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether all bytes of each span are good."""
    order = np.argsort(start)
    cuts = np.stack([start[order], end[order]], axis=1).ravel()
    out = np.empty(len(start), dtype=bool)
    out[order] = np.logical_and.reduceat(np.append(good, False), cuts)[::2]
    return out


class WordEncoder:
    """Encodes texts with a lower-casing tokenizer file whose pre-tokenizer removes white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._plain(_MARK)
        if len(mark) != 1:
            raise ValueError("the tokenizer has no single id for the mark between words")
        self.mark = mark[0]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted unit hashes
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _plain(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype=np.uint32)

    def _pure(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Units of one pre-token each: their ids end with a closing one."""
        ids = self._plain(b" ".join(some).decode())
        closing = np.flatnonzero(self.closes[ids])
        if len(closing) != len(some):
            raise AssertionError("units and closing ids differ")
        return ids, np.diff(closing, prepend=-1)

    def _mixed(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Any units, told apart by a mark behind each."""
        if any(b"\x01" in w for w in some):
            parts = [self._plain(w.decode()) for w in some]
            return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        flat = self._plain(b" \x01 ".join(some).decode() + " " + _MARK)
        marks = np.flatnonzero(flat == self.mark)
        if len(marks) != len(some):
            raise AssertionError("units and marks differ")
        return np.delete(flat, marks), np.diff(marks, prepend=-1) - 1

    def _learn(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Add units, given in the order of their hashes."""
        sign = data == _C3
        later = np.zeros(len(data), dtype=bool)
        later[1:] = sign[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
        pure = _all_in(_LETTER[data] | sign | later, start, end) | _all_in(_POINT[data], start, end)
        whole = data.tobytes()
        begin, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        parts, size = [self.ids], len(self.ids)
        for rows, encode in ((np.flatnonzero(pure), self._pure), (np.flatnonzero(~pure), self._mixed)):
            for at in range(0, len(rows), 20_000):
                some = rows[at : at + 20_000]
                texts = [whole[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
                ids, n = encode(texts)
                begin[some], count[some] = size + np.cumsum(n) - n, n
                parts.append(ids)
                size += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.begin = np.insert(self.begin, at, begin)
        self.count = np.insert(self.count, at, count)
        self.ids = np.concatenate(parts)

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and bounds of the texts in them."""
        start, end, firsts = units(words)
        hashes = words.span_hash(start, end)
        coded = pa.array(hashes).dictionary_encode()
        inverse, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        at = np.empty(len(distinct), dtype=np.int64)
        at[inverse[::-1]] = np.arange(len(hashes) - 1, -1, -1)
        if len(self.known) > MOST_WORDS:
            self.forget()
        pos = np.searchsorted(self.known, distinct)
        found = np.zeros(len(distinct), dtype=bool)
        inside = pos < len(self.known)
        found[inside] = self.known[pos[inside]] == distinct[inside]
        if not found.all():
            unknown = np.flatnonzero(~found)
            unknown = unknown[np.argsort(distinct[unknown])]
            new = at[unknown]
            self._learn(words.data, distinct[unknown], start[new], end[new])
            pos = np.searchsorted(self.known, distinct)
        begin, count = self.begin[pos][inverse], self.count[pos][inverse]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(begin - (ends - count), count)
        bounds = np.concatenate([[0], ends])[firsts]
        return self.ids[source], bounds


def encode_column(texts: pa.Array, path: str):
    """Yields ``(index of the first text, ids, bounds)`` for pieces of a text column; null is empty."""
    encoder = word_encoder(path)
    for at, data, bounds in slices(texts):
        # Special tokens ("<|...|>") are looked for before the tokenizer lower-cases.
        lower = b"<|" not in data.tobytes()
        yield at, *encoder.encode(Words(data, bounds, lower=lower))
