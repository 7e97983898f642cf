"""The training-data operators against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, rows_of
from quietwire.llm import chat, jaccard, kneser_ney, line_dedup, mixing, packing, queries, spotsigs
from quietwire.llm import sketches, suffix_tree, tokens, topk, toxicity, word_model
from quietwire.llm.common import Words, chains, kept_packed, slices
from quietwire.llm.components import components

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- shared parts -----------------------------------------------------------------------------


def test_words_and_chains_follow_the_bytes():
    texts = ["A b\x0bC  d", "", None, "é\x85x y", "one"]
    seen = []
    for _, data, bounds in slices(pa.array(texts)):
        found = Words(data, bounds)
        for i in range(len(bounds) - 1):
            a, b = found.first[i], found.first[i + 1]
            seen.append([found.data[s:e].tobytes() for s, e in zip(found.start[a:b], found.end[a:b], strict=True)])
        again = Words(data, bounds)
        assert (again.hash == found.hash).all()
    assert seen == [words_of(t) for t in texts]
    values = np.arange(10, dtype=np.uint64)
    assert len(chains(values, 4)) == 7 and len(chains(values[:3], 4)) == 0
    assert len(set(chains(np.array([1, 2, 1, 2, 3], np.uint64), 2).tolist())) == 3


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    got = {x[0]: x[1] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least


# -- 1: Jaccard join ----------------------------------------------------------------------------


def brute_jaccard(rows, size, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    head, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                links[i] += 1
                links[j] += 1
                head[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), name), name)
    return sorted((name, len(sets[i]), least[find(i)], links[i]) for i, (name, _) in enumerate(rows))


@pytest.mark.parametrize("visits", [4.0, 1000.0, 0.0])
def test_jaccard_is_exact_by_pivots_and_by_blocks(spark, visits):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    bases = [[r.choice(vocabulary) for _ in range(n)] for n in (120, 90, 60, 40, 9)]
    rows = []
    for i in range(220):
        words = list(r.choice(bases) if r.random() < 0.8 else [r.choice(vocabulary) for _ in range(r.randint(0, 50))])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
            if words:
                words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i * 3, " ".join(words)))
    rows += [(5000, ""), (5001, None), (5002, "a b"), (5003, "A  b"), (5004, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.jaccard_components(df, 4, 85, most_members=16, pivots=3, most_visits=visits)
    assert sorted(map(tuple, found.collect())) == brute_jaccard(rows, 4, 85)


def test_op1_on_the_table(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    got = queries.op1_ngram_jaccard(spark, SF).select("doc_id", "n_shingles", "component_id", "n_links")
    assert sorted(map(tuple, got.collect())) == brute_jaccard(rows, 4, 85)


def test_one_of_each_keeps_odd_rows(spark, odd_documents):
    kept = jaccard.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted([r[0] for r in kept.select("doc_id").collect()], key=str)
    assert ids == sorted([1, 3, 4, 5, 6, 7, None, 9], key=str)


# -- 2: top-k -----------------------------------------------------------------------------------


@pytest.mark.parametrize(("shard_rows", "block_queries"), [(64, 2), (4096, 256)])
def test_top_k_equals_sql(spark, shard_rows, block_queries):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = topk.top_k(vectors, F.col("vec_id") % 100 == 0, shard_rows=shard_rows, block_queries=block_queries)
    want = connect(SF).execute(topk.TOP_K_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None)]
    rows += [(6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 0.5]), (None, [9.0, 9.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, shard int, dim int")
    got = topk.top_k(df, F.col("vec_id") == 0, k=3).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 1, 1 << 20), (0, 2, 1, 1 << 20), (0, 3, 2, 1 << 20)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_top_k_broadcasts_no_queries(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = topk.top_k(vectors, F.col("vec_id") % 100 == 0, shard_rows=64, block_queries=2)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_top_k_in_groups_of_shards_and_queries(spark, monkeypatch):
    r = random.Random(3)
    scales = [1.0, 1.0, 1000.0, 1e6]
    rows = [(r.randrange(60), [r.choice(scales[: 2 + 2 * (i % 9 == 0)]) * r.uniform(-1, 1) for _ in range(r.choice([3, 3, 5]))]) for i in range(300)]
    rows += rows[:5] + [(7, [0.5, 0.5, 0.5])] * 80  # repeated rows, and one id that many rows have
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 10 == 0:
            others = [(-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i and len(v) == len(q)]
            want += [(i, at + 1, j, -s) for at, (s, j) in enumerate(sorted(others)[:4])]
    for group_bytes in (500, 1 << 20):
        monkeypatch.setattr(topk, "COLUMNS", 3)
        monkeypatch.setattr(topk, "GROUP_BYTES", group_bytes)
        got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=4, scale=64, shard_rows=20, block_queries=4)
        assert sorted(map(tuple, got.collect())) == sorted(want)


# -- 3: quality ---------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one(spark):
    r = random.Random(1)
    grams = Counter()
    for _ in range(60):
        text = [kneser_ney.BEGIN] * 2 + [r.choice([1, 2, 3, 4]) for _ in range(r.randint(1, 9))] + [kneser_ney.END]
        for a, b, c in zip(text, text[1:], text[2:], strict=False):
            grams[(a << 20) | (b << 10) | c] += 1
    model = kneser_ney.learn(spark.createDataFrame(list(grams.items()), "gram long, n long"))
    context = (1 << 20) | (2 << 10)
    rows = [(c, [(context | c, 1)]) for c in range(1 << kneser_ney.BITS)]
    counted = spark.createDataFrame(rows, "row long, grams array<struct<gram: long, n: long>>")
    total = sum(2 ** r["log2p"] for r in kneser_ney.log_probabilities(counted, "row", model).collect())
    assert total == pytest.approx(1.0, abs=1e-6)


def test_quality_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = queries.op3_quality(spark, folder).join(labels, "doc_id").collect()
    good, bad = [r for r in found if r["quality"] == 1], [r for r in found if r["quality"] == 0]
    assert sum(r["accepted"] for r in good) >= 0.99 * len(good)
    assert sum(not r["accepted"] for r in bad) >= 0.9 * len(bad)


def test_quality_quantiles_are_of_all_trusted_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = kneser_ney.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels, most_documents=20)
    rows = found.join(labels.where("quality = 1").select("doc_id"), "doc_id").where("tokens > 1").collect()
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    large = [x for lang, x in by_lang.items() if lang is not None and len(x) >= kneser_ney.LEAST_TRUSTED]
    assert large
    for x in large:
        bits = sorted(r["bits"] for r in x)
        assert x[0]["least"] == pytest.approx(bits[0] - kneser_ney.MARGIN)
        assert x[0]["most"] == pytest.approx(bits[-1] + kneser_ney.MARGIN)


def test_quality_learns_from_every_trusted_text(spark, monkeypatch):
    given, learn = [], kneser_ney.learn
    monkeypatch.setattr(kneser_ney, "learn", lambda trigrams: given.append(trigrams) or learn(trigrams))
    ids = spark.range(20_500).withColumnRenamed("id", "doc_id")
    documents = ids.select("doc_id", F.lit("en").alias("lang"), F.lit("two words").alias("text"))
    labels = ids.union(ids.limit(10)).withColumn("quality", F.when(F.col("doc_id") % 41 == 0, 0).otherwise(1))
    assert kneser_ney.classify(documents, labels).count() == 20_500
    assert given[0].agg(F.sum("n")).first()[0] == 3 * 20_000


def test_quality_on_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (4, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert kneser_ney.classify(odd_documents, labels).count() == 10
    assert kneser_ney.accepted_documents(odd_documents, labels).columns == odd_documents.columns
    assert kneser_ney.classify(odd_documents.limit(0), labels.limit(0)).collect() == []
    assert kneser_ney.accepted_documents(odd_documents, labels.limit(0)).count() == 10


def kneser_ney_of_words(trusted, text):
    """Log2 probability of the words of a text and its end, by the formulas, from the words of trusted texts."""
    counts = {3: Counter(), 2: Counter(), 1: Counter()}
    for words in trusted:
        seen = ["<", "<", *words, ">"]
        counts[3].update(zip(seen, seen[1:], seen[2:], strict=False))
    for order in (2, 1):
        counts[order].update(g[1:] for g in counts[order + 1])
    contexts = {k: defaultdict(list) for k in counts}
    cut = {}
    for order, c in counts.items():
        for g, n in c.items():
            contexts[order][g[:-1]].append(n)
        cut[order] = (0.0, *word_model.discounts([sum(n == j for n in c.values()) for j in (1, 2, 3, 4)]))

    def p(order, g):
        if order == 0:
            return 1 / (len(counts[1]) + 1)
        n, d, all_ = counts[order][g], cut[order], contexts[order].get(g[:-1], [])
        lower = p(order - 1, g[1:])
        return (n - d[min(n, 3)] + sum(d[min(x, 3)] for x in all_) * lower) / sum(all_) if all_ else lower

    seen = ["<", "<", *text, ">"]
    return sum(math.log2(p(3, g)) for g in zip(seen, seen[1:], seen[2:], strict=False))


def test_word_model_equals_brute_force(spark):
    r = random.Random(5)
    words = ["a", "b", "A", "b,", "café", "dd", "zz9"]
    texts = [(i % 37 if i % 10 else None, " ".join(r.choices(words, range(7, 0, -1), k=r.randint(0, 12)))) for i in range(80)]
    texts += [(5, texts[3][1]), (50, None), (51, "a unmet words of b"), (51, ""), (52, " \n ")]
    documents = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in (*range(0, 30, 2), 51, 99)], "__id long")
    half = {r[0]: r[1] for r in documents.select("doc_id", word_model.halves(F.col("doc_id"))).distinct().collect()}
    fitted = [[(t or "").split() for i, t in texts if i is not None and i in {*range(0, 30, 2), 51} and half[i] == m] for m in (0, 1)]
    hashes = {r[0]: r[1] for r in documents.select("text", F.xxhash64("text")).distinct().collect()}
    want = sorted((i or -1, hashes[t], kneser_ney_of_words(fitted[1 - half[i]], (t or "").split())) for i, t in texts)
    for block_bytes, shard_tokens in ((40, 50), (1 << 20, 1 << 20)):
        got = word_model.word_scores(documents, trusted, block_bytes, shard_tokens).collect()
        got = sorted((r["doc_id"] or -1, r["text_hash"], r["word_log2p"]) for r in got)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)


def test_quality_tells_words_of_the_same_shapes_apart(spark):
    """Lengths, case and marks are those of the trusted texts; the words are not."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(150)]
    invented = {w: "".join(r.choices("stuvwxyz", k=len(w))) for w in words}
    texts = [r.choices(words, k=80) for _ in range(240)]
    rows = [(i, "en", " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, "en", " ".join(invented[w] for w in t)) for i, t in enumerate(texts[:40])]
    labels = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    found = kneser_ney.classify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), labels).collect()
    assert len(found) == 280
    assert all(r["least"] <= r["bits"] <= r["most"] for r in found)
    assert {r["doc_id"] for r in found if not r["accepted"]} == {1000 + i for i in range(40)}


# -- 4: toxicity --------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = [r for r in queries.op4_toxicity(spark, folder).where("held_out").collect() if r["doc_id"] in labels]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    assert right >= 0.97 * len(rows)
    assert any(r["offending"] for r in rows if labels[r["doc_id"]] == 1)


def test_toxicity_locates_sentences_and_takes_odd_rows(spark, odd_documents):
    texts = [(i, "All is well here. " + ("You vile beast! " if i % 2 else "A good day! ") + "Nothing more.") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels, F.lit(True))
    row = toxicity.score(docs.where("doc_id = 1"), model).first()
    assert [texts[1][1][s["start"] : s["end"]] for s in row["offending"]] == ["You vile beast!"]
    assert toxicity.score(odd_documents, model).count() == 10
    assert toxicity.train(odd_documents, labels.limit(0), F.lit(True)).features.size == 0
    assert toxicity.score(odd_documents.limit(0), model).collect() == []


# -- 5: line dedup ------------------------------------------------------------------------------


def brute_lines(rows, least=5):
    lines = [(i, k, tuple(words_of(x))) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    first = {}
    for i, k, w in lines:
        first.setdefault(w, (i, k))
    near, order = set(), sorted(first, key=first.get)
    for n, w in enumerate(order):
        for v in order[:n]:
            a, b = sorted((v, w), key=len)
            if len(a) < least:
                continue
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                near.add(w)
            if len(a) + 1 == len(b) and any(b[:j] + b[j + 1 :] == a for j in range(len(b))):
                near.add(w)
    return sorted((i, k, w in near) for i, k, w in lines if first[w] != (i, k) or w in near)


def test_repeated_lines(spark, odd_documents):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 12))] for _ in range(40)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(r.randint(0, 6)):
            words, kind = list(r.choice(base)), r.random()
            if kind < 0.3:
                words[r.randrange(len(words))] = r.choice(vocabulary)
            elif kind < 0.5:
                words.insert(r.randint(0, len(words)), r.choice(vocabulary))
            elif kind < 0.6:
                del words[r.randrange(len(words))]
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "Share this page\n\nown"), (904, "share  this page"), (905, "x\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.repeated_lines(df).collect())) == brute_lines(rows)
    out = {(x["doc_id"], x["text"]) for x in line_dedup.without_repeats(odd_documents).collect()}
    assert (2, "") in out and (3, "another one") in out and (5, None) in out and (4, "") in out
    assert line_dedup.without_repeats(odd_documents).count() == 10
    assert line_dedup.without_repeats(odd_documents.limit(0)).collect() == []


def test_repeated_lines_of_null_and_shared_ids(spark):
    rows = [
        (None, "one two three four five six"),
        (None, "a b c d e f\nshort"),
        (4, "one two three FOUR five seven"),
        (5, "a b c d e"),
        (5, "nothing like it at all here"),
        (6, "nothing like it at all there\nshort"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in line_dedup.repeated_lines(df).collect()}
    assert got == {(4, 0, True), (5, 0, True), (6, 0, True), (6, 1, False)}


def test_hot_lines_are_dealt_to_several_tasks(spark):
    rows = [(i, f"Share this page\nown {i}") for i in range(70_000)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = line_dedup.repeated_lines(df).agg(F.count(F.lit(1)), F.min("doc_id"), F.max("line"), F.max(F.col("near").cast("int"))).first()
    assert tuple(got) == (69_999, 1, 0, 0)


def test_lines_stage_keeps_columns_of_the_counts_names(spark):
    df = spark.createDataFrame([(1, "same", 7, "x"), (2, "same\nown", 8, "y")], "doc_id long, text string, lines_dropped long, lines_near string")
    out = corpus_pipeline.lines(spark, df, SF)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "same", 7, "x"), (2, "own", 8, "y")]


# -- 6: packing ---------------------------------------------------------------------------------


def test_word_encoder_is_the_tokenizer():
    encoder, r = tokens.word_encoder(WORD_BPE), random.Random(1)
    parts = ["a", "B", "é", "É", "×", "ß", "Σ", "ς", "́", " ", "\u0085", "1", ".", ",", "!", "'s", "'", "\x01"]
    parts += ["<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "日", "한", "»", ")", "-", " ", "ﬁ", "İ", "\x1c", "😀", ";"]
    for _ in range(300):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(5)]
        got = [
            ids[bounds[i] : bounds[i + 1]].tolist()
            for _, ids, bounds in tokens.encode_column(pa.array(texts), WORD_BPE)
            for i in range(len(bounds) - 1)
        ]
        assert got == [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, odd_documents):
    for source in (documents(spark), odd_documents):
        pieces = packing.token_pieces(source, WORD_BPE)
        rows = packing.pack(pieces).collect()
        places = defaultdict(list)
        for r in rows:
            assert len(r["ids"]) == 4 * r["length"] <= 4 * packing.SEQUENCE_TOKENS
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for spans in places.values():
            spans.sort()
            assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
            assert sum(n for _, n in spans) <= packing.SEQUENCE_TOKENS
        total = sum(r["length"] for r in rows)
        assert len(places) <= math.ceil(total / packing.SEQUENCE_TOKENS) + 1
    assert {r["length"] for r in rows if r["doc_id"] in (4, 5, 6)} == {1}
    assert packing.pack(packing.token_pieces(odd_documents.limit(0), WORD_BPE)).collect() == []


def test_fullest_combination():
    r = random.Random(4)
    for _ in range(200):
        counts = {r.randint(1, 40): r.randint(1, 3) for _ in range(r.randint(0, 6))}
        room = r.randint(0, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        found = packing.fullest(counts, room)
        assert all(found[x] <= counts[x] for x in found)
        assert sum(x * n for x, n in found.items()) == max(s for s in sums if s <= room)


# -- 7: mixing ----------------------------------------------------------------------------------


def test_mixing_equals_sql(spark):
    for name in ("op7_mixing",):
        df = queries.registered()[name](spark, SF)
        cursor = connect(SF).execute(queries.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_mixing_targets_and_odd_rows(spark, odd_documents):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20.0 and got[None] == 180.0 and sum(got.values()) == pytest.approx(2400.0)
    assert got["c"] == 1000.0 and got["b"] == pytest.approx(1200.0)
    rows = mixing.mix_sources(odd_documents).collect()
    assert len(rows) == 10 and all(r["taken"] <= 2 * r["size"] for r in rows)
    again = mixing.mix_sources(odd_documents).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(odd_documents.limit(0)).collect() == []


# -- 8: suffix tree -----------------------------------------------------------------------------


def test_suffix_tree_scores(spark, odd_documents):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter()
    for i, text in rows:
        if i not in held:
            counts.update([*words_of(text), "end"])
    total, kinds = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in queries.op8_suffix_tree(spark, SF).collect()}
    for i, text in rows:
        seen = [*words_of(text), "end"]
        r = got[i]
        assert r["held_out"] == (i in held) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(seen), sum(counts[w] > 0 for w in seen))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in seen))
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert suffix_tree.score_texts(odd_documents, F.col("doc_id") == 3).count() == 10
    assert suffix_tree.score_texts(odd_documents, F.lit(True)).count() == 10
    assert suffix_tree.score_texts(odd_documents.limit(0), F.lit(False)).collect() == []


def brute_suffix_tree(texts, learned):
    """Natural logs of the texts' probabilities, and the states, by a plain tree of counted contexts."""
    sequences = [["<", *words_of(text), "end"] for text in texts]
    training = [s for s, own in zip(sequences, learned, strict=True) if own]
    unigrams = Counter(w for s in training for w in s[1:])
    total, kinds = sum(unigrams.values()), len(unigrams)
    states, grown, length = {}, {()}, 0

    def log_p(before, word):
        value = math.log((unigrams[word] + 1) / (total + kinds + 1))
        for k in range(1, len(before) + 1):
            if (state := states.get(tuple(before[-k:]))) is None:
                break
            kept, rest = state
            value = kept.get(word, value + rest)
        return value

    while grown:
        length += 1
        found = {}
        for s in training:
            for i in range(max(1, length), len(s)):
                if tuple(s[i - length + 1 : i]) in grown:
                    found.setdefault(tuple(s[i - length : i]), Counter())[s[i]] += 1
        grown, new = set(), {}
        for context, counts in found.items():
            n, some = sum(counts.values()), {w: c for w, c in counts.items() if c >= 2}
            if n < 2 or not some:
                continue
            under = {w: log_p(context[1:], w) for w in some}
            left = 1 - sum(c - 0.5 for c in some.values()) / n
            rest = math.log(left / (1 - sum(map(math.exp, under.values()))))
            own = {w: math.log((c - 0.5) / n) for w, c in some.items()}
            gain = sum(c * (own[w] - under[w]) for w, c in some.items()) + (n - sum(some.values())) * rest
            if gain > len(some) * 0.5 * math.log(total):
                new[context] = own, rest
                if -sum(c * own[w] for w, c in some.items()) > 0.5 * math.log(total):
                    grown.add(context)
        states |= new
    return [sum(log_p(s[:i], s[i]) for i in range(1, len(s))) for s in sequences], states


def test_suffix_tree_equals_brute_force(spark):
    """Contexts of any length and of rare words are states, in blocks and shards of any number, whether hot or not."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3_000)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(400)]
    follows: dict[tuple[str, ...], str] = defaultdict(lambda: rng.choice("abc"))
    for i in range(0, 400, 5):
        # What comes next depends on one to four letters before, by turns.
        letters = ["a", "b", "c", "a"]
        for _ in range(150):
            letters.append(follows[tuple(letters[-rng.randint(1, 4) :])])
        texts[i] += " " + " ".join(letters)
    texts[0] += " Quite rare and odd" * 2
    texts[7] += " quite rare AND odd"
    texts += [texts[1], texts[1], "", None, "here", "c a b a b x"]
    learned = [i % 7 != 2 for i in range(len(texts))]
    expected, states = brute_suffix_tree([t or "" for t in texts], learned)
    assert max(map(len, states)) >= 4 and (b"rare",) in states
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block_bytes, shard_tokens in ((1 << 23, 1 << 21), (9_000, 3_000)):
        found = suffix_tree.score_texts(docs, F.col("doc_id") % 7 == 2, block_bytes, shard_tokens).collect()
        got = {r["doc_id"]: r["score"] * math.log(10) for r in found}
        assert [got[i] for i in range(len(texts))] == pytest.approx(expected, rel=1e-4)
    # A text that stands twice in training is likelier than one of like words that stands once.
    base = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in found}
    assert base[1] > base[3] + 0.5


def test_suffix_tree_pairs_take_little_memory():
    """The pairs of a block are found in a few arrays of its length: 76 bytes a token, where hashing them took 104."""
    rng = np.random.default_rng(3)
    n, block = 500_000, object.__new__(suffix_tree._Block)
    block.word = rng.integers(1, 20_000, n).astype(np.uint64)
    block.offset = np.arange(n, dtype=np.int32) % 400
    block.learned = rng.random(n) < 0.8
    at, once, hot = np.arange(n), rng.random(n) < 0.1, block.word % np.uint64(1000) == 0
    tracemalloc.start()
    first, context, word, shard, counts, pair = block.pairs(at, once, hot, 2, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * n
    assert counts.sum() == block.learned.sum() and (np.diff(shard) >= 0).all()
    assert (context[pair] == block.contexts(at, 2)).all() and ((word[pair] == block.word) | once).all()
    assert (pair[first] == np.arange(len(first))).all() and (word[pair][once] == suffix_tree._ANY).all()


def test_packed_rows_stand_in_small_row_groups(spark):
    """A task holds a row group when it writes and when it reads; with rows of 1 MB a hundred rows were one."""
    rows = spark.range(60).coalesce(1).select("id", F.expr("cast(repeat(md5(cast(id as string)), 32768) as binary)").alias("packed"))
    found = kept_packed(rows, "packed-rows")
    (file,) = [f.removeprefix("file:") for f in found.inputFiles()]
    meta = pq.ParquetFile(re.sub("^/+", "/", file)).metadata
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 16 << 20
    assert found.agg(F.count("id"), F.sum(F.length("packed"))).first() == (60, 60 << 20)


# -- 9: fingerprints ----------------------------------------------------------------------------


def test_fingerprints(spark, odd_documents):
    rows = sorted((r[0], r[1] or "") for r in documents(spark).select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, SF).collect()}
    for k, (i, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        one, two, three = (spotsigs.signatures([t.encode()])[0] for t in (text, edited, other))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (spotsigs.as_text(one), spotsigs.as_text(two))
        a, b, c = set(one.tolist()), set(two.tolist()), set(three.tolist())
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    assert spotsigs.edited_fingerprints(odd_documents).count() == 10
    assert spotsigs.edited_fingerprints(odd_documents.limit(0)).collect() == []
    assert spotsigs.fingerprints(odd_documents).count() == 10


def test_likeness_is_pruned_by_length():
    one, two = np.arange(10, dtype=np.uint32), np.arange(8, dtype=np.uint32)
    assert spotsigs.likeness(one, two) == 0.8
    assert spotsigs.likeness(one, two, 0.8) == 0.8
    assert spotsigs.likeness(one, two, 0.81) == 0.0
    assert spotsigs.likeness(one[:0], two[:0]) == 1.0
    assert (spotsigs.from_text(spotsigs.as_text(one)) == one).all()


# -- 10: chats ----------------------------------------------------------------------------------


def test_chats_read_back(spark):
    got = {r["conv_id"]: r for r in queries.op10_chat_formatting(spark, SF).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    control = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", control), (1, "assistant", control)]
    assert set(got) == set(turns)
    for name, rows in turns.items():
        rows.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in rows)
        learned = "".join(text for _, role, text in rows if role == "assistant")
        r = got[name]
        assert (r["n_turns"], r["turns_sha256"]) == (len(rows), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_escapes_and_odd_turns(spark):
    for text in ("</s>", "<\\/s>", "[INST]\\[/INST]", "<\\\\s>", "<<TEXT>>", "a\\b", "", "<<s>>"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (None, 0, "user", "é\n"), (1, 1, "assistant", ""), (2, None, "<s>", "t")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, ids string, loss string")
    segments = chat.format_chats(df, RANKS, PATTERN)
    got = {r["conv_id"]: r for r in chat.digest_chats(segments, RANKS, PATTERN).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[2]["turns_sha256"] == hashlib.sha256(b"<s>\nt\n").hexdigest()
    assert chat.digest_chats(chat.format_chats(df.limit(0), RANKS, PATTERN), RANKS, PATTERN).collect() == []


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, odd_documents):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sequences":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0
    rows = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        assert name == "sequences" or out.columns == rows.columns
        rows = out
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_mixing_with_sources_without_words(spark):
    rows = [(1, "a", "x y z"), (2, "a", None), (3, "b", None), (4, "b", ""), (5, None, " "), (6, "c", "1 2 3 4")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.doc_id: (r.target, r.taken) for r in mixing.mix_sources(docs).collect()}
    assert found == {1: (6.0, 6), 2: (6.0, 0), 3: (0.0, 0), 4: (0.0, 0), 5: (0.0, 0), 6: (4.5, 4)}
    assert sorted(r.doc_id for r in mixing.mixed_documents(docs).collect()) == [1, 1, 6]


# -- sketches -----------------------------------------------------------------------------------


def test_sketches_of_few_rows_are_small(spark):
    bits = np.zeros(sketches.BLOOM_BITS, dtype=bool)
    at = np.random.default_rng(0).integers(0, len(bits), 5_000)
    bits[at] = True
    small = sketches.folded(np.packbits(bits))
    assert len(small) * 16 <= len(bits) // 8 and np.unpackbits(small)[at % (len(small) * 8)].all()
    assert len(sketches.folded(np.full(len(bits) // 8, 255, np.uint8))) == len(bits) // 8
    few = spark.range(0, 30_000, 10).withColumnRenamed("id", "x")
    asked = spark.range(30_000).withColumnRenamed("id", "x").where(sketches.in_sketch(few, "x"))
    found = {r[0] for r in asked.collect()}
    assert found >= set(range(0, 30_000, 10)) and len(found) < 4_000
