"""Token counts, SentencePiece, fingerprints and packing against the libraries and plain loops."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import fingerprints, packing, sentencepiece_table, token_counts

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b ", "Hello, World!", "don't  stop\n\nnow", "<|endoftext|> x <|STARTOFTEXT|>", "ΑΣ ΣΑΣ.", "J̌ ǰ İ", "é é", "日本語 text", "a\x00b", "x" * 5000, "A B " * 3000, "😀👍🏽", " non breaking space", "▁ ▁▁x", "  \n \t "]
DOCS = "doc_id bigint, text string, n_tokens string, score double"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0.0) for i, t in enumerate(texts)], DOCS)


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_token_counts_are_the_library_s(spark):
    texts = ODD + ODD[3:8] + ["hello, world!", "HELLO,  world! "]
    got = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, texts), WORDS).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == library_counts(texts)
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert got[texts.index("A B " * 3000)].over_limit and not got[0].over_limit


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_token_counts_of_any_text(texts):
    counter = token_counts.counter_of(WORDS)
    assert counter.count([t.encode() for t in texts]) == library_counts(texts)


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 50)
    monkeypatch.setattr(token_counts, "RELEARN_WORDS", 200)
    counter, rng, cleared = token_counts.PieceCounter(WORDS), random.Random(3), 0
    for k in range(60):
        letters = "abcdefgh" if k < 30 else "éßijk"  # other texts come
        texts = [" ".join(rng.choice(letters) * rng.randint(1, 60) + "z" * rng.randint(0, 30) for _ in range(20)) + " <|endoftext|> " for _ in range(3)]
        before = len(counter.memo)
        assert counter.count([t.encode() for t in texts]) == library_counts(texts)
        cleared += len(counter.memo) < before
        assert len(counter.memo) <= 50 and all(len(w) <= 64 for w in counter.memo)
    assert cleared


def test_cache_encodes_misses_only_and_is_appended_to(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    token_counts.count_tokens(documents(spark, ["a b", "A  b", "c"]), WORDS, path).collect()
    first = spark.read.parquet(path)
    assert first.count() == 2  # equal after normalisation
    wrong = first.withColumn("n_tokens", first.n_tokens + 100)
    wrong.write.parquet(f"{path}-2")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(spark, ["a b", "d e f"]), WORDS, f"{path}-2").collect()}
    assert got == {0: 102, 1: 3}  # a stored count is taken as it is; the new text is encoded
    assert spark.read.parquet(f"{path}-2").count() == 3


def test_null_and_repeated_ids_each_get_a_row(spark, processor):
    rows = [(None, "a b"), (None, None), (4, "a b"), (4, "a b"), (4, "c" * 100_000), (5, "")]
    frame = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id bigint, text string, n_tokens string, content_digest double")
    counts = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame, WORDS).collect()), key=repr)
    assert counts == sorted(((i, len(t or ""), n) for (i, t), n in zip(rows, library_counts([t for _, t in rows]))), key=repr)
    found = sorted(((r.doc_id, r.n_tokens) for r in sentencepiece_table.encode_digests(frame, PIECES).collect()), key=repr)
    assert found == sorted(((i, len(processor.encode(t or "")) + 1) for i, t in rows), key=repr)


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert token_counts.count_tokens(empty, WORDS).count() == 0
    assert sentencepiece_table.encode_digests(empty, PIECES).count() == 0
    assert fingerprints.edit_probe(empty).count() == 0
    assert packing.pack(empty.select("doc_id", packing.words("text").alias("length"))).count() == 0


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_are_the_library_s(processor):
    table, rng = sentencepiece_table.piece_table(PIECES), random.Random(5)
    vocabulary = [p.replace("▁", " ") for p, t in zip(table.pieces, table.types) if t == 1]
    texts = [t or "" for t in ODD]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts += ["".join(rng.choice("aabeethin .,\n▁é中😀\x00<s>/") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [" " * n for n in range(120)] + ["a" + " " * n + "b" for n in range(60)]
    for text in texts:
        ids = table.encode(text)
        assert ids == processor.encode(text), text
        assert table.decode(ids + [2]) == processor.decode(ids + [2]), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_pieces_of_any_text(text):
    import sentencepiece

    table = sentencepiece_table.piece_table(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES) if not hasattr(test_pieces_of_any_text, "sp") else test_pieces_of_any_text.sp
    test_pieces_of_any_text.sp = library
    assert table.encode(text) == library.encode(text)


def test_decoding_any_ids(processor):
    table, rng = sentencepiece_table.piece_table(PIECES), random.Random(6)
    for _ in range(3000):
        ids = [rng.randint(0, 600) if rng.random() < 0.7 else rng.randint(0, len(table.pieces) - 1) for _ in range(rng.randint(0, 9))]
        assert table.decode(ids) == processor.decode(ids), ids


def test_encode_queries(spark, processor):
    got = {r.doc_id: r for r in sentencepiece_table.encode_digests(documents(spark, ODD), PIECES).collect()}
    for i, t in enumerate(ODD):
        ids = processor.encode(t or "") + [2]
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()
    ids = sentencepiece_table.encode_texts(documents(spark, ODD), PIECES)
    back = {r.doc_id: r.text for r in sentencepiece_table.decode_ids(ids, PIECES).collect()}
    assert back == {i: processor.decode(processor.encode(t or "")) for i, t in enumerate(ODD)}


def plain_boundaries(data):
    """The boundaries from hashes of the last 16 bytes, one byte after another."""
    ends, start = [], 0
    for at in range(1, len(data) + 1):
        h = sum(int(fingerprints.GEAR[b]) << age for age, b in enumerate(reversed(data[max(0, at - 16) : at]))) & 0xFFFF
        size = at - start
        bits = fingerprints.STRICT_BITS if size < fingerprints.NORMAL else fingerprints.LOOSE_BITS
        if (size >= fingerprints.LEAST and h < 1 << (16 - bits)) or size == fingerprints.LARGEST or at == len(data):
            ends.append(at)
            start = at
    return ends


def test_boundaries_against_a_loop():
    rng = random.Random(7)
    for n in [0, 1, 7, 8, 9, 40, 300, 1500]:
        for data in (bytes(rng.randrange(97, 123) for _ in range(n)), b"a" * n):
            assert fingerprints.boundaries(data) == plain_boundaries(data)


def test_chunks_survive_an_insertion():
    rng = random.Random(8)
    text = bytes(rng.randrange(97, 123) for _ in range(4000))
    a, b = fingerprints.chunks(text), fingerprints.chunks(text[:1000] + b"something new" + text[1000:])
    assert fingerprints.likeness(a, b) > 0.93
    assert fingerprints.read(fingerprints.show(a)) == a
    assert fingerprints.likeness(a, fingerprints.chunks(bytes(rng.randrange(97, 123) for _ in range(4000)))) == 0


def test_edit_probe_against_a_loop(spark):
    rng = random.Random(9)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abc déf\n") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(7 * i % 500, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "same id"), (3, "same id"), (3, "a same id")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fingerprint string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    expected = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        n = len(t) // 4
        e = t[: len(t) - n] + u[:n]
        f, g, h = (fingerprints.chunks(x.encode()) for x in (t, e, u))
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.show(f), fingerprints.show(g), fingerprints.likeness(f, g), fingerprints.likeness(f, h)))
    for ranges in (1, 5, 40):
        got = [tuple(r) for r in fingerprints.edit_probe(frame, ranges=ranges).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_edit_probe_cuts_rows_without_id_and_rows_of_one_id(spark, monkeypatch):
    """Rows of one id or none are spread over ranges, and each still meets the next one."""
    texts = [f"{i:05d} text" for i in range(400)]
    for ids in ([None] * 400, [7] * 400):
        frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
        probe = fingerprints.edit_probe(frame, ranges=16)
        spread = probe.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(spread) == 400 and max(spread) < 250
        edited = {hashlib.sha256((t[: len(t) - 2] + u[:2]).encode()).hexdigest() for t, u in zip(texts, texts[1:] + texts[:1])}
        assert {r.edited_sha256 for r in probe.collect()} == edited
    same = spark.createDataFrame([(None, "same")] * 300 + [(1, "other")], "doc_id bigint, text string")
    found = [r.edited_sha256 for r in fingerprints.edit_probe(same, ranges=8).collect()]
    assert sorted(found).count(hashlib.sha256(b"sams").hexdigest()) == 299 and len(found) == 301


def test_edits_stay_near_and_next_texts_do_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars >= 400")
    found = fingerprints.edit_probe(docs).toPandas()
    assert found.near_edited.mean() > 0.7 and found.near_edited.min() > 0.4
    assert found.near_next.mean() < 0.01


def test_bucket_bounds_against_all_choices():
    rng = np.random.RandomState(10)
    for _ in range(30):
        lengths = np.sort(rng.choice(60, rng.randint(1, 9), replace=False))
        counts, k = rng.randint(1, 20, len(lengths)), rng.randint(1, 5)

        def padding(bounds):
            return sum(int(c) * (min(b for b in bounds if b >= n) - int(n)) for n, c in zip(lengths, counts))

        best = min(padding(set(c) | {lengths[-1]}) for r in range(k) for c in itertools.combinations(lengths, min(r, len(lengths))))
        found = packing.bucket_bounds(lengths, counts, k)
        assert len(found) <= k and found[-1] == lengths[-1] and padding(found) == best


def test_bucket_bounds_of_long_lengths_and_many_bins():
    """Lengths far above 1,024 are no coarser than others; halved ranges find what all starts give."""
    rng = np.random.RandomState(12)
    lengths = np.sort(rng.choice(np.arange(900, 60_000), 9, replace=False))
    counts = rng.randint(1, 20, len(lengths))
    padding = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= n) - int(n)) for n, c in zip(lengths, counts))
    best = min(padding({*c, lengths[-1]}) for c in itertools.combinations(lengths, 3))
    assert padding(packing.bucket_bounds(lengths, counts, 4)) == best
    for n in (1, 2, 3, 17, 200):
        size, before = np.sort(rng.choice(10_000, n, replace=False)), np.concatenate([[0], np.cumsum(rng.randint(1, 9, n))])
        tail = np.concatenate([[0], size[:-1] * before[1:-1]])
        options = np.where(np.tri(n, dtype=bool), tail + size[:, None] * (before[1:][:, None] - before[:-1]), 1 << 60)
        assert (packing.best_starts(tail, size, before) == options.argmin(1)).all()
    every = np.arange(65_537)
    assert len(packing.bucket_bounds(every, np.ones_like(every), 16)) == 16


def test_packing_spreads_repeated_rows_and_null_ids(spark):
    from pyspark.sql import functions as F

    rows = spark.range(12_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(7).alias("length"))
    found = packing.pack(rows, budget=70)
    assert found.groupBy("batch").count().where("count <> 10").count() == 0
    assert found.select("batch", "slot").distinct().count() == 12_000
    # the window over shards gets about a thousand rows for each
    written = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "pmod(xxhash64(" in x and "row" in x]
    assert written


def test_packing_places_every_row_once(spark):
    rng = np.random.RandomState(11)
    lengths = [0, 1, 5, 5000, 99_999] + [int(x) for x in rng.lognormal(5, 1, 3000)]
    rows = [(i if i else None, n, "x") for i, n in enumerate(lengths)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, length bigint, bucket string"), buckets=8, budget=20_000).toPandas()
    assert len(found) == len(rows) and sorted(found.length) == sorted(lengths)
    assert (found.length <= found.padded_length).all() and found.over_budget.sum() == 1
    for (bucket, batch), group in found.groupby(["bucket", "batch"]):
        assert sorted(group.slot) == list(range(len(group)))
        assert len(group) == 1 or group.padded_length.iloc[0] * len(group) <= 20_000
        last = found[found.bucket == bucket].batch.max()
        full = max(1, 20_000 // max(1, group.padded_length.iloc[0]))
        assert batch == last or len(group) == full  # only a bucket's last batch has room


def test_words(spark):
    frame = spark.createDataFrame([(t,) for t in (None, "", "  ", "a", " a  b\tc\n")], "text string")
    assert [r[0] for r in frame.select(packing.words("text")).collect()] == [0, 0, 0, 1, 3]


def test_packing_counts_tokens(spark):
    from weft.llm import queries

    texts = ODD + ["x1" * 40_000]
    got = {r.doc_id: r.length for r in token_counts.lengths(documents(spark, texts), WORDS).collect()}
    assert [got[i] for i in range(len(texts))] == library_counts(texts)
    packed = packing.pack(token_counts.lengths(documents(spark, texts), WORDS)).where("over_budget").collect()
    assert [r.doc_id for r in packed] == [len(texts) - 1]  # one word, but more tokens than the budget
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, WORDS).collect())
    assert sorted((r.doc_id, r.length) for r in queries.op10_packing(spark, "/root/testdata/sf0.001").collect()) == want
