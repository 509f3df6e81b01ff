import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from rfmspark.llm import bpe, packing
from rfmspark.llm.byte_level import byte_level

POOL = "aAbBéİΣς '’\n\t \x85 ́.,!1２<|endoftext|>漢😀'sll"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = [None, "", "  a  b", "don't I'LL  12345 ñ!!..\n\n x", " lead", " tail ", "a \n b", "a" * 9000, "word " * 5000,
           "x<|endoftext|>y <|startoftext|> z", "x ᠎ y\tz\r\n 漢字"]
    return odd + ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(800)]


def library(name):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_is_the_librarys(spark, texts):
    t = library("word_bpe_49k")
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    rows = {r["doc_id"]: r for r in bpe.encode_documents(docs).collect()}
    assert len(rows) == len(texts)
    coder = bpe.PairIndexEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        shown = t.decode(ids, skip_special_tokens=False)
        r = rows[i]
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (ids, shown, len(ids)) and coder.decode(np.array(ids, int)) == shown
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(docs.where("false")).count() == 0


def test_full_store_is_emptied_without_harm(monkeypatch, texts):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    plain = [x or "" for x in texts[:200]]
    t, b = library("word_bpe_49k"), library("byte_bpe_50k")
    got = bpe.PairIndexEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for lo in range(0, 200, 7):
        part = plain[lo:lo + 7]
        assert [x for x, _ in got.encode(part)] == [np.array(t.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in part]
        assert [byte_level().encode(p) for p in part] == [b.encode(p, add_special_tokens=False).ids for p in part]


def test_packing_holds_every_id_once(spark, texts):
    b = library("byte_bpe_50k")
    docs = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack_documents(docs).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == set(range(len(texts)))
    for i, x in enumerate(texts):
        ids, at = [*b.encode(x or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:at], "<u4").tobytes())
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_best_fit_against_a_plain_search():
    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 120))), reverse=True)
        window, offset = packing.best_fit(lengths, 64)
        rooms: list[int] = []
        for n, w, o in zip(lengths, window, offset):
            fit = [r for r in rooms if r >= n]
            if not fit:
                rooms.append(64)
                assert w == len(rooms) - 1
            else:
                assert rooms[w] == min(fit)
            assert o == 64 - rooms[w]
            rooms[w] -= n


def test_equal_rows_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 64)
    docs = spark.createDataFrame([(None if i % 3 == 0 else i % 5, "same text") for i in range(900)], "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(docs).collect()
    shards = {}
    for r in rows:
        shards[r["sequence_id"] >> 32] = shards.get(r["sequence_id"] >> 32, 0) + 1
    assert len(rows) == 900 and max(shards.values()) < 120 and sum(r["doc_id"] is None for r in rows) == 300
