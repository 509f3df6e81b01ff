"""Operator 12: ranked lexical search by an Aho-Corasick scan of the documents.

The terms of all items form one automaton; a term's pattern is the term between two blanks. A text's
delimiters become blanks before the scan, so a pattern matches exactly where the term is a maximal run.
There is no index of documents: one scan adds up how many documents hold each term (and N and L), a
second one counts each document's terms again, scores the items that the automaton's outputs map to,
and keeps the k best documents of each item within the task. These lists are merged as a tree.

The automaton is broadcast in blocks of whole items with about ``BLOCK_TERMS`` distinct terms each;
the number of blocks follows the items, and each block scans the documents anew. A task holds one
automaton, the texts of one slice and ``HELD_ROWS`` list rows at most.

Defined results: a null or empty text has no terms and counts nowhere; very long texts are scanned
whole; rows that share a doc_id (null included) are documents of their own, a null doc_id sorts last;
items with one item_id (null included) are one item with the terms of its distinct texts; equal
scores go by ascending doc_id; items without a document above 0 have no rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rfmspark.llm.common import setup, slices
from rfmspark.llm.toplists import merge_tree

BLOCK_TERMS = 100_000
HELD_ROWS = 200_000
SLICE_DOCS = 1_024
#: Tasks are numbered modulo this when their lists are merged.
NODES = 4_096
LAST = (1 << 63) - 1
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def folded(text: bytes) -> bytes:
    """UTF-8 text with A-Z in lower case and every delimiter as a blank."""
    return text.translate(_FOLD)


def _item_terms(batches):
    for batch in batches:
        items, terms = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            found = folded((text or "").encode()).split(b" ")
            found = [t for t in found if t]
            items += [item] * len(found)
            terms += found
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(items, batch.schema.field("item_id").type), "term": pa.array(terms, pa.binary())})


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and times of every item."""
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").distinct().mapInArrow(_item_terms, f"item_id {kind}, term binary") \
        .groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


class Terms:
    """Distinct terms of a block of items, and which items have each of them how often."""

    def __init__(self, rows: pa.Table):
        self.key = uuid.uuid4().hex
        # items and terms numbered as they come; a null item is one of them
        items, terms = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode"), rows.column("term").combine_chunks().dictionary_encode()
        self.items, self.terms = items.dictionary, terms.dictionary.to_pylist()
        item, term = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (items, terms))
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order], rows.column("times").to_numpy()[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))


_AUTOMATA: dict[str, object] = {}


def _automaton(terms: Terms):
    """A worker keeps the automaton of one block."""
    if terms.key not in _AUTOMATA:
        import ahocorasick
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms.terms):
            made.add_word(f" {term.decode('latin-1')} ", i)
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[terms.key] = made
    return _AUTOMATA[terms.key]


def _scan(batches, terms: Terms):
    """Of each slice of documents: the slice, its documents' numbers of terms, and (document, term, tf) of the block's terms."""
    width = max(1, len(terms.terms))
    find = _automaton(terms).iter if terms.terms else lambda _: ()
    for batch in batches:
        for part in (s for lo in range(0, batch.num_rows, SLICE_DOCS) for s in slices(batch.slice(lo, SLICE_DOCS), "text")):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            flat = folded(b"".join((b" ", b" ".join(texts), b" ")))
            begin = np.cumsum([0, *(len(t) + 1 for t in texts)])  # the blank before each text
            solid = np.frombuffer(flat, np.uint8) != 32
            starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
            n = np.diff(np.searchsorted(starts, begin))
            hits = np.fromiter(chain.from_iterable(find(flat.decode("latin-1"))), np.int64)
            doc = np.searchsorted(begin, hits[::2] - 1, side="right") - 1
            cell, tf = np.unique(doc * width + hits[1::2], return_counts=True)
            yield part, n, cell // width, cell % width, tf


def _statistics(shared):
    def fn(batches):
        terms = shared.value
        df, docs, total = np.zeros(len(terms.terms), np.int64), 0, 0
        for _, n, _, term, _ in _scan(batches, terms):
            df += np.bincount(term, minlength=len(df))
            docs += int((n > 0).sum())
            total += int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.r_[-2, -1, some].astype(np.int32)), "n": pa.array(np.r_[docs, total, df[some]].astype(np.int64))})
    return fn


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)


def _scores(n, doc, term, tf, terms: Terms, weight, docs: int, total: int) -> np.ndarray:
    """Score of every document (row) for every item (column), in whole numbers."""
    n = n.astype(object) if len(n) and 75 * int(n.max()) * docs >= 1 << 63 else n
    m = (100 - 75 + (75 * n * docs) // max(total, 1)).astype(np.int64)
    gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    size = terms.first[term + 1] - terms.first[term]
    at = np.repeat(terms.first[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
    part = np.repeat(gain, size) * terms.times[at]
    cell = np.repeat(doc, size) * len(terms.items) + terms.item[at]
    cells = len(n) * len(terms.items)
    if part.sum(dtype=np.float64) < 1 << 52:  # sums of doubles are exact there
        out = np.bincount(cell, weights=part, minlength=cells).astype(np.int64)
    else:
        out = np.zeros(cells, np.int64)
        np.add.at(out, cell, part)
    return out.reshape(len(n), len(terms.items))


def _ranker(shared, k: int):
    def fn(batches):
        terms, weight, docs, total = shared.value
        floor = np.ones(len(terms.items), np.int64)  # a lower score can't be among an item's best any more
        held: list[tuple] = []

        def compact():
            item, score, doc = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, -score, item))
            item = item[order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            order = order[place < k]
            full = np.flatnonzero(place == k - 1)
            floor[item[full]] = score[order][np.searchsorted(item[place < k], item[full], side="right") - 1]
            held[:] = [tuple(np.concatenate(x)[order] for x in zip(*held))]

        for part, n, doc, term, tf in _scan(batches, terms):
            scores = _scores(n, doc, term, tf, terms, weight, docs, total)
            row, item = np.nonzero(scores >= floor)
            ids = part.column("doc_id").fill_null(LAST).to_numpy()
            held.append((item, scores[row, item], ids[row]))
            if sum(len(h[0]) for h in held) > HELD_ROWS:
                compact()
        if held:
            compact()
            item, score, doc = held[0]
            yield pa.RecordBatch.from_pydict({"item_id": terms.items.take(pa.array(item)), "score": pa.array(score), "doc_id": pa.array(doc, mask=doc == LAST)})
    return fn


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item."""
    spark = docs.sparkSession
    setup(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = item_terms(items).checkpoint()
    blocks = max(1, -(-wanted.count() // block_terms))
    lists = []
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows and (lists or b < blocks - 1):
            continue
        terms = Terms(rows)
        counts = texts.mapInArrow(_statistics(spark.sparkContext.broadcast(terms)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        n = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist()))
        df = np.array([n.get(i, 0) for i in range(len(terms.terms))], np.int64)
        shared = spark.sparkContext.broadcast((terms, weights(df, n.get(-2, 0)), n.get(-2, 0), n.get(-1, 0)))
        lists.append(texts.mapInArrow(_ranker(shared, k), f"item_id {kind}, score long, doc_id long"))
    found = lists[0]
    for more in lists[1:]:
        found = found.unionAll(more)
    found = found.withColumn("node", F.pmod(F.spark_partition_id(), F.lit(NODES)))
    return merge_tree(found, ["item_id"], "node", [F.desc("score"), F.asc_nulls_last("doc_id")], k, NODES).select("item_id", "rank", "doc_id", "score")


#: The query's own result in DuckDB.
SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, a GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // total) AS m FROM n, a),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM f JOIN w USING (term) JOIN m USING (doc_id) JOIN i USING (term) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
