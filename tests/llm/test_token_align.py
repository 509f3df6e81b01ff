"""Operator 13 against a plain two-pointer alignment, and the rank encoder against the tokenizers library."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rfmspark.llm import token_align
from rfmspark.llm.byte_level import byte_level, unicode_bytes

SCHEMA = "doc_id long, text string, n_a string, pairs long"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(rows, tokenizers):
    """Result of every (doc_id, text) by spans compared one with another."""
    a, b = tokenizers
    byte = unicode_bytes()
    per_doc, held = [], Counter()
    for doc, text in rows:
        ta, tb = [], []
        if text:
            ta = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if not b"".join(x for _, x in ta) == b"".join(x for _, x in tb) == (" " + text).encode():
                ta, tb = [], []

        def spans(tokens):
            at = 0
            for i, x in tokens:
                yield i, at, at + len(x)
                at += len(x)
        sa, sb = list(spans(ta)), list(spans(tb))
        cuts = sorted({e for *_, e in sa} & {e for *_, e in sb})
        groups = [",".join(str(i) for i, s, e in sa if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in sb if lo <= s and e <= hi)
                  for lo, hi in zip([0, *cuts], cuts)]
        links = [(i, j) for i, s, e in sa for j, t, f in sb if s < f and t < e]
        held.update(set(links))
        per_doc.append((doc, len(sa), len(sb), groups, links))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return sorted(((d, na, nb, len(g), len(l), sum(held[p] == top[p[0]] for p in l), sum(held[p] for p in l),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, l in per_doc), key=str)


TEXTS = ["The quick brown fox", "The quick brown fox", "", None, "  leading and  double  blanks ", "tabs\tand\nlines\r\n", "Ünïcödé und Straße, 東京 🙂🙂",
         "a ▁ literal mark", "<s> <|endoftext|> <0x41> </s>", "x", " ", "\x00nul", "1234567890 " * 30, "aaaa" * 400, "The " * 50, "ciónñ de los ñandúes " * 12]


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.mark.parametrize("hot", [1 << 20, 40, 1])
def test_equals_brute_force(spark, tokenizers, hot):
    rng = np.random.default_rng(3)
    rows = [(i % 11 if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "".join(rng.choice(list("ab eñ,.\n東0"), 60))) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    assert result(token_align.alignment_report(docs, hot_pairs=hot)) == brute(rows, tokenizers)


def test_given_documents(spark, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 1500").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(token_align.alignment_report(docs)) == brute(rows, tokenizers)


def test_groups_are_the_operators_own_output(spark):
    made = token_align.align(spark.createDataFrame([(1, "to be"), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert made[0]["n_groups"] == made[0]["groups"].count(";") + 1 and made[1]["groups"] == ""


def test_empty_table_and_empty_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.alignment_report(docs).count() == 0
    docs = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert result(token_align.alignment_report(docs)) == [(1, *[0] * 6, ""), (None, *[0] * 6, "")]


def test_very_long_text(spark):
    text = "word " * 60_000 + " " * 3000 + "x" * 5000
    row = token_align.alignment_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"]


def test_gallop_ranks():
    rng = np.random.default_rng(5)
    for n, m in ((0, 5), (1, 1), (70, 3000), (500, 510), (1000, 200_000)):
        short, long = (np.unique(rng.integers(0, 400_000, k)) for k in (n, m))
        assert (token_align.gallop(short, long) == np.searchsorted(long, short)).all()


def test_rank_encoder_is_the_library(tokenizers):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}x '{chr(c)}" for c in [*range(0x3000), *range(0x1F300, 0x1F600)]]
    encoder = byte_level(None, specials_as_text=True)
    assert [encoder.encode(t) for t in texts] == [e.ids for e in tokenizers[0].encode_batch(texts, add_special_tokens=False)]
    for text in (" " * 5000 + "x", "\n" * 3000, "a<|endoftext|>b"):
        assert encoder.encode(text) == tokenizers[0].encode(text, add_special_tokens=False).ids
    as_token = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert byte_level(None).encode("a<|endoftext|>b") == as_token.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_words_encode_as_the_whole(tokenizers, monkeypatch):
    monkeypatch.setattr(token_align, "STORE_WORDS", 50)
    model = token_align.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(8)
    texts = [t for t in TEXTS if t and "▁" not in t] + ["".join(rng.choice(list("ab  eñ,.\n東0\u3000\xa0é"), 80)) for _ in range(300)]
    texts += [f"a{chr(c)} b {chr(c)}{chr(c)}  1{chr(c)}x" for c in range(1, 0x3000) if c != 0x2581]
    for lo in range(0, len(texts), 100):
        part = texts[lo:lo + 100]
        assert [x.tolist() for x in model.encode([" " + t for t in part])] == tokenizers[1].encode(part)
    assert token_align.OTHER in model.encode([" a ▁ b"])[0]
