"""Operator 10: base rules, and a length-normalised log-likelihood ratio between two hashed n-gram multinomials.

One multinomial is counted over all trusted documents (labelled of good quality and not toxic), the
other over the whole raw corpus, both over words and word pairs hashed into ``BUCKETS`` cells. Rare cells
are pulled together by a share of the target's mass, so a larger corpus of the same kind gives the same ratios.
A document's verdict is the mean of its n-grams' log ratios against a fixed threshold, so every
document is judged alike. Counting sums a fixed-size table in each task and the tables by cell;
the model that scoring tasks carry has ``BUCKETS`` numbers whatever the corpus.

Defined results: null and empty texts have no words, so the base rules fail them; duplicate rows
are each judged and counted; without any trusted document the ratio is flat zero and only the base
rules decide; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rfmspark.llm.common import U64, setup, slices, utf8
from rfmspark.llm.textstats import Texts

BUCKETS = 1 << 16
#: Pseudo-count of a cell as a share of the target's n-grams (50 in the 2.4 million of sf0.1), so that cells seldom met say nothing.
PRIOR = 2e-5
THRESHOLD = -0.1


def _cells(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    keys, doc = t.grams()
    return (keys >> U64(48)).astype(np.int64), doc


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            total += np.bincount(_cells(Texts(*utf8(part.column("text"))))[0], minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"cell": pa.array(used, pa.int64()), "n": pa.array(total[used])})


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratio of every cell; ``trusted`` holds the doc_ids of the target."""
    setup(docs.sparkSession)
    marks = trusted.select("doc_id").where("doc_id is not null").distinct()
    # the ids grow with the corpus, so they are never broadcast; hashed, not sorted: the texts don't spill
    target = docs.select("doc_id", "text").join(marks.hint("shuffle_hash"), "doc_id", "left_semi").select("text")
    counts = [rows.mapInArrow(_count, "cell long, n long").withColumn("trusted", F.lit(t)) for rows, t in ((docs.select("text"), False), (target, True))]
    n = lambda t: F.sum(F.when(F.col("trusted") == t, F.col("n")).otherwise(0))
    sums = counts[0].union(counts[1]).groupBy("cell").agg(n(True).alias("target"), n(False).alias("raw"))
    rows = sums.toPandas()  # at most BUCKETS rows
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    target[rows["cell"]], raw[rows["cell"]] = rows["target"], rows["raw"]
    if not target.sum():
        return np.zeros(BUCKETS, np.float32)
    expected = raw * (target.sum() / raw.sum())
    prior = PRIOR * target.sum()
    return np.log((target + prior) / (expected + prior)).astype(np.float32)


def _judge(ratio: np.ndarray, threshold: float):
    def fn(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                t = Texts(*utf8(part.column("text")))
                cells, doc = _cells(t)
                n = np.bincount(doc, minlength=t.n)
                score = t.by_doc(ratio[cells].astype(np.float64), doc) / np.maximum(n, 1)
                repeat = t.repeat_words()
                failed = (t.n_words < 50) | (100 * repeat > 50 * t.n_words)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_words": pa.array(t.n_words, pa.int64()), "word_chars": pa.array(t.word_chars()),
                    "n_symbols": pa.array(t.n_symbols()), "n_dup_lines": pa.array(t.n_dup_lines()), "n_repeat_words": pa.array(repeat),
                    "base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= threshold)), "score": pa.array(score)})
    return fn


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    setup(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_judge(ratio, threshold), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, "
                                                    "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return judge(docs, fit(docs, labels.where("quality = 1 and coalesce(toxic, 0) = 0")), threshold)
