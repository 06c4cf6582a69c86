import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import packing
from tallyloom.llm.queries import tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(tokenizer_path())
    return [*ids_of.t.encode(text or "", add_special_tokens=False).ids, 0]


def corpus(rng):
    words = ["hello", "World", "naïve", "the", "12", "345", "don't", "x=1;", "日本語", "émigré", "ﬁn", "<|endoftext|>", "'s", "a_b", "--"]
    texts = [None, "", " ", "  two  spaces ", "tail ", "\n\nlines\n", "\tx", "a\u00a0b", "zero\u200bwidth", "e\u0301 combining", "🙂 emoji🙂"]
    for _ in range(150):
        texts.append(rng.choice([" ", " ", " ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 300))))
    texts.append(" ".join(rng.choice(words) for _ in range(9000)))
    texts += [texts[20], texts[20]]
    return texts


def check(rows, truth, tokens=packing.TOKENS, segments=packing.SEGMENTS, loss=packing.LOSS):
    """Every id in exactly one piece, sequences gapless from 0, and no limit broken."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(truth)
    for i, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(truth[i])
            assert p.ids_crc32 == zlib.crc32(np.array(truth[i][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(truth[i])
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= tokens and len(ps) <= segments and sum(p.loss_tokens for p in ps) <= loss
    return len(sequences)


def test_whole_texts_are_packed_once_with_little_padding(spark):
    texts = corpus(random.Random(6))
    truth = {i: ids_of(t) for i, t in enumerate(texts)}
    frame = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, id string, prompt int").repartition(2)
    n = check(packing.pack(frame, tokenizer_path()).collect(), truth)
    assert n <= -(-sum(map(len, truth.values())) // 1024) + 4


def test_every_limit_binds_in_the_query(spark):
    """On a given table all three limits are met, and few ids of padding are left."""
    from tallyloom.llm.queries import op3_vector_packing

    out = op3_vector_packing(spark, "/root/testdata/sf0.01")
    rows = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l")).collect()
    assert max(r.n for r in rows) == packing.TOKENS and max(r.s for r in rows) == packing.SEGMENTS and max(r.l for r in rows) == packing.LOSS
    assert sum(r.n < packing.TOKENS and r.l == packing.LOSS for r in rows) > 0
    assert sum(r.n < packing.TOKENS and r.s == packing.SEGMENTS for r in rows) > 0
    assert sum(r.n for r in rows) > 0.95 * packing.TOKENS * len(rows)


def test_leading_ids_bear_no_loss(spark):
    texts = ["one two three four " * 30, "", None, "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = packing.pack(frame, tokenizer_path(), lead=25).groupBy("id").agg(F.sum("length").alias("n"), F.sum("loss_tokens").alias("l"))
    assert {r.id: r.l for r in out.collect()} == {i: len(ids_of(t)) - len(ids_of(t)) * 25 // 100 for i, t in enumerate(texts)}


def test_memory_of_words_may_be_small():
    texts = [t or "" for t in corpus(random.Random(3))]
    encode = packing.Encoder(tokenizer_path(), most=10)
    assert [[*ids.tolist(), 0] for ids in encode(texts)] == [ids_of(t) for t in texts]


def test_three_limits_hold_at_once(spark):
    rng = random.Random(7)
    rows = [(i, "ask " * rng.randint(1, 40), "say " * rng.randint(1, 60)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, q string, a string").withColumn("text", F.concat("q", "a")).coalesce(1)
    out = packing.pack(frame, tokenizer_path(), prompt=F.col("q"), tokens=256, segments=5, loss=120, pool=64).collect()
    check(out, {i: ids_of(q + a) for i, q, a in rows}, 256, 5, 120)
    assert 0 < sum(r.loss_tokens for r in out) < sum(r.length for r in out)


def test_empty_table_and_limits(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(frame, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame, tokenizer_path(), tokens=0)


def test_null_ids_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r.id or 0, r.length) for r in packing.pack(frame, tokenizer_path()).collect()) == [(0, len(ids_of("a b")))] + [(1, len(ids_of("a b")))] * 2


def test_words_of_one_text_are_looked_up_and_not_remembered():
    encode = packing.Encoder(tokenizer_path())
    texts = ["one two one\nthree\nthree four", "\nthree a\tb\n", "once only", "x  y once", "a<|endoftext|>b c"]
    assert [[*ids, 0] for ids in map(np.ndarray.tolist, encode(texts))] == [ids_of(t) for t in texts]
    assert set(encode.known) == {"\nthree"}
    assert [[*ids, 0] for ids in map(np.ndarray.tolist, encode(texts))] == [ids_of(t) for t in texts]
