import os
import random

import pytest

from lexloom.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="the public vocabulary isn't here")
TEXTS = ["", "Hello world", "  two  spaces \n\n tabs\t", "don't we'll IT'S", "<|endoftext|> stays", "每份工作坊都编码两次。", "ผู้เข้าร่วม", "🇽🇽🏳️‍🌈🧪", "a​b﻿c\xa0d", "x" * 50_000, "0123456789 1,2.3", "\x00\x01\x7f", "é é", "١٢٣ हिन्दी 한국어"]


def test_matches_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(encode.VOCABULARY.replace(".tiktoken", ".json"))
    reference.encode_special_tokens = True
    rng = random.Random(1)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randint(1, 0x7F), rng.randint(0xA0, 0x2FFF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1FAFF)])) for _ in range(60)) for _ in range(80)]
    df = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in encode.encode_texts(df).collect()}
    assert got[900] == [] and got[0] == []
    assert all(got[i] == reference.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in encode.decode_ids(encode.encode_texts(df)).collect()}
    assert all(back[i] == t for i, t in enumerate(texts))


def test_repeated_rows_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y")], "doc_id bigint, text string, ids string")
    rows = encode.encode_texts(df).collect()
    assert len(rows) == 2 and rows[0].ids == rows[1].ids
    assert encode.encode_texts(df.limit(0)).count() == 0


def test_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 3)
    encoder = encode.Encoder(encode.serialise_model(encode.read_ranks(encode.VOCABULARY)))
    assert [encoder.encode([t]) for t in ("a b c", "d e f", "a b c")][0] == encoder.encode(["a b c"])
