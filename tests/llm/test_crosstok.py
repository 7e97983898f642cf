"""Cross-tokenizer alignment against plain encoding of whole texts, and on odd input."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from quietwire.llm import crosstok, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ZERO = (0, 0, 0, 0, 0, 0, "")


def groups_of(a_ends, b_ends):
    """Groups by stepping through all common ends."""
    both = sorted(set(a_ends) & set(b_ends))
    out, i, j = [], 0, 0
    for end in both:
        p, q = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
        out.append((i, p, j, q))
        i, j = p, q
    return out


def ends_of(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    alphabet = crosstok.byte_alphabet()
    found, counts = [], Counter()
    for name, text in rows:
        found.append([name, None])
        if not text:
            continue
        whole = (" " + text).encode()
        enc = a_tok.encode(" " + text, add_special_tokens=False)
        b = b_tok.encode(text)
        a_parts = [bytes(alphabet[c] for c in t) for t in enc.tokens]
        pieces = [b_tok.id_to_piece(i) for i in b]
        b_parts = [
            bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(b, pieces, strict=True)
        ]
        if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            continue
        groups, links, shown = groups_of(ends_of(a_parts), ends_of(b_parts)), Counter(), []
        for i, p, j, q in groups:
            for x in enc.ids[i:p]:
                for y in b[j:q]:
                    links[x, y] += 1
            shown.append(",".join(map(str, enc.ids[i:p])) + "|" + ",".join(map(str, b[j:q])))
        counts.update(links.keys())
        digest = hashlib.sha256(";".join(shown).encode()).hexdigest()
        found[-1][1] = (len(enc.ids), len(b), len(groups), links, digest)
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for name, got in found:
        if got is None:
            out.append((name, *ZERO))
            continue
        n_a, n_b, n_groups, links, digest = got
        best = sum(n for (x, y), n in links.items() if counts[x, y] == highest[x])
        out.append((name, n_a, n_b, n_groups, sum(links.values()), best, sum(n * counts[k] for k, n in links.items()), digest))
    return sorted(out, key=str)


def run(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_diagonal_runs_are_the_common_ends():
    r = random.Random(3)
    for _ in range(400):
        n = r.choice([1, 2, 5, 40, 300])
        both = sorted(r.sample(range(1, 4 * n + 1), n))
        keep = r.choice([0.3, 0.9, 1.0])
        a = [x for x in both[:-1] if r.random() < keep] + both[-1:]
        b = [x for x in both[:-1] if r.random() < keep] + both[-1:]
        want = [(i, p - i, j, q - j) for i, p, j, q in groups_of(a, b)]
        got = []
        for i, j, na, nb in crosstok.diagonal_runs(a, b):
            got += [(i + k, 1, j + k, 1) for k in range(-na)] if na < 0 else [(i, na, j, nb)]
        assert got == want
    assert crosstok.diagonal_runs([], []) == []


def test_one_to_one_stretches_are_jumped():
    ends = list(range(1, 100_001))
    assert crosstok.diagonal_runs(ends, ends) == [(0, 0, -100_000, 100_000)]


@pytest.mark.parametrize("known", [40 << 20, 0])
def test_odd_texts(spark, monkeypatch, known):
    monkeypatch.setattr(crosstok, "KNOWN_BYTES", known)
    r = random.Random(5)
    letters = ["a", "B", " ", "  ", "\n", "\t", "é", "日本", "😀", "'s", "1234", ".", "▁", "<s>", "<|endoftext|>", "\x00", " ", "́", "the", " of", "▁▁"]
    texts = ["", None, " ", "a", " a", "a ", "a  b c", "x▁ y", "<|endoftext|> <s></s>", "日本語" * 700, "word " * 900, "no_space" * 300]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(150)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "the end of it"), (None, "the end of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS pair", "3 AS at")
    assert run(crosstok.align_documents(df, A, B)) == brute(rows)


def test_large_groups_are_counted_by_distinct_ids(spark, monkeypatch):
    monkeypatch.setattr(crosstok, "SMALL_GROUP", 1)
    crosstok._ALIGNERS.clear()
    rows = [(i, t) for i, t in enumerate(["日本語の文 " * 20, "😀😀é é thou thertion", "abc"])]
    own = crosstok.Aligner(A, B)
    _, _, _, pairs, docs = crosstok._block(own, [t.encode() for _, t in rows])
    monkeypatch.setattr(crosstok, "SMALL_GROUP", 1 << 20)
    own = crosstok.Aligner(A, B)
    _, _, _, same, times = crosstok._block(own, [t.encode() for _, t in rows])
    assert (pairs == same).all() and (docs == times).all()


def test_no_rows(spark):
    assert run(crosstok.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []


def test_op11_on_the_table(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(queries.op11_token_alignment(spark, SF)) == brute(rows)
