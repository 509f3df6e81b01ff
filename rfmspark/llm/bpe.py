"""Operator 7: byte-pair encoding and decoding through a pair occurrence index.

Each task takes the distinct pre-tokens of its batches, splits them into symbols, and indexes every
adjacent pair that has a merge rank by all its positions. The smallest active rank is taken from a
heap, all its positions are merged from left to right, the neighbours' old pairs drop out and the
new pairs enter the index, until no ranked pair is left. Their ids are kept in a bounded store of the worker
(emptied when full), so a text is the concatenation of its pre-tokens' ids.

Normalising and pre-splitting follow the tokenizer file through the library's own components; the
merging and decoding are done here. Defined results: null and empty texts have no ids; their hash
is that of no bytes; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from rfmspark.llm.common import setup

CACHE_WORDS = 600_000
# White space by Unicode's property; no pre-token spans it.
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
# Texts of this alphabet are normalised by lower() and split by the file's own pattern restricted to it;
# any other text goes through the library's normaliser and splitter.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ž"
_RARE = re.compile(f"[^\n\x20-\x7e{_LETTERS}]|<\\|")
_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \n0-9{_LETTERS}]+")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself if printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class PairIndexEncoder:
    """Vocabulary, merge ranks and the distinct words met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in {**self.vocab, **self.special}.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (r, self.vocab[a + b]))
        self.pair = {r: (*k, new) for k, (r, new) in self.ranks.items()}
        self.letters = byte_letters()
        self.store: dict[str, tuple[bytes, str]] = {}

    def merge(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each pre-token, all merged together through one pair occurrence index."""
        symbol: list[int] = []
        left: list[int] = []
        right: list[int] = []
        heads = []
        vocab, ranks = self.vocab, self.ranks
        for p in pieces:
            syms = [vocab[c] for c in p[:-1] if c in vocab]
            last = p[-1] + self.suffix
            if last in vocab:
                syms.append(vocab[last])
            at, n = len(symbol), len(syms)
            heads.append(at if n else -1)
            symbol += syms
            left += [-1, *range(at, at + n - 1)][:n]
            right += [*range(at + 1, at + n), -1][:n]
        index: dict[int, list[int]] = {}
        for i, j in enumerate(right):
            if j >= 0 and (m := ranks.get((symbol[i], symbol[j]))):
                index.setdefault(m[0], []).append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places = index.pop(rank, None)
            if not places:
                continue
            a, b, new = self.pair[rank]
            for i in sorted(places):
                j = right[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:  # an earlier merge took one of them
                    continue
                k, h = right[j], left[i]
                symbol[i], symbol[j], right[i] = new, -1, k
                if k >= 0:
                    left[k] = i
                    if m := ranks.get((new, symbol[k])):
                        if m[0] not in index:
                            index[m[0]] = []
                            heapq.heappush(active, m[0])
                        index[m[0]].append(i)
                if h >= 0 and (m := ranks.get((symbol[h], new))):
                    if m[0] not in index:
                        index[m[0]] = []
                        heapq.heappush(active, m[0])
                    index[m[0]].append(h)
        out = []
        for i in heads:
            ids = []
            while i >= 0:
                ids.append(symbol[i])
                i = right[i]
            out.append(ids)
        return out

    def learn(self, keys: set[str]) -> None:
        """Merge the pre-tokens that the store lacks, all through one index."""
        new = list(keys)
        if len(self.store) + len(new) > CACHE_WORDS:
            self.store.clear()
        letters = self.letters
        pieces = [k[1:] if k[0] == "\0" else k if k.isascii() else "".join([letters[b] for b in k.encode()]) for k in new]
        for k, ids in zip(new, self.merge(pieces)):
            self.store[k] = np.array(ids, "<u4").tobytes(), " ".join([self.strings[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Keys of the text's pre-tokens: as they are, or after a zero character in the vocabulary's own letters;
        special tokens after two."""
        if not _RARE.search(text):
            return _TOKEN.findall(text.lower())
        out = []
        norm, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append("\0\0" + part)
                continue
            for w in _BLANKS.split(part):
                out += ["\0" + p for p, _ in pre.pre_tokenize_str(norm.normalize_str(w) if norm else w) if p] if w else []
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        lists = [self.split(t) for t in texts]
        got = [list(map(self.store.get, ks)) for ks in lists]
        new = {k for ks, g in zip(lists, got) if None in g for k, x in zip(ks, g) if x is None}
        special = {"\0\0" + s for s in self.special} & new
        self.learn(new - special)
        for k in special:
            self.store[k] = np.array([self.special[k[2:]]], "<u4").tobytes(), k[2:]
        out = []
        for ks, g in zip(lists, got):
            if None in g:
                g = [self.store[k] if x is None else x for k, x in zip(ks, g)]
            ids, shown = zip(*g) if g else ((), ())
            out.append((b"".join(ids), " ".join(shown if "" not in shown else filter(None, shown))))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As the library joins tokens where the file names no decoder, special tokens kept."""
        return " ".join([self.strings[i] for i in ids.tolist() if i in self.strings])


_CODERS: dict[str, PairIndexEncoder] = {}


def _coder_for(path: str) -> PairIndexEncoder:
    """A worker's encoder and its store last over its tasks."""
    if path not in _CODERS:
        _CODERS[path] = PairIndexEncoder(path)
    return _CODERS[path]


def _coder(path: str, full: bool):
    def fn(batches):
        coder = _coder_for(path)
        for batch in batches:
            doc, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            for lo in range(0, len(texts), 512):
                got = coder.encode(texts[lo:lo + 512])
                cols = {"doc_id": doc.slice(lo, len(got)), "n_tokens": pa.array([len(b) // 4 for b, _ in got], pa.int64())}
                if full:
                    cols |= {"ids": pa.array([np.frombuffer(b, "<u4").astype("i8") for b, _ in got], pa.list_(pa.int64())), "decoded": pa.array([d for _, d in got])}
                cols |= {"ids_sha256": pa.array([hashlib.sha256(b).hexdigest() for b, _ in got]),
                         "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got])}
                yield pa.RecordBatch.from_pydict(cols)
    return fn


def encode_documents(docs: DataFrame, tokenizer: str | None = None, full: bool = True) -> DataFrame:
    """doc_id, n_tokens, the ids and the decoded text (if ``full``), and the hashes of both."""
    setup(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, " + "ids array<long>, decoded string, " * full + "ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_coder(tokenizer or public_tokenizers.path("word_bpe_49k.json"), full), schema)
