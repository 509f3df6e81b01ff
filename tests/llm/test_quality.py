import random
import re
import zlib

import numpy as np

from rfmspark.llm import quality_gam as G
from rfmspark.llm import quality_rules as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    mark = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            mark |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(mark))


def test_rules_against_brute_force(spark):
    rng = random.Random(2)
    pool = ["the", "of", "é", "😀x", "a|b", "#", " ", "  ", "\n", "\t", "\x0b", "\x85", "the of é ", "line one\n", "line one \n"]
    texts = [None, "", " ", "\n", "a\n\na\n", "x " * 3000] + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, None), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in R.quality_rules(docs, labels).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, want = rows[i], brute(t or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert R.quality_rules(docs.where("false"), labels).count() == 0
    assert {r["kept"] for r in R.quality_rules(docs, labels.where("false")).collect() if not r["base_failed"]} == {True}


def _corpus(rng, n):
    good = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "walks", "and", "over"]) for _ in range(120)) + "."
    bad = lambda: " ".join(rng.choice(["###", "buy|now", "$$$", "CLICK", "!!"]) for _ in range(120))
    return [(i, bad() if i % 4 == 0 else good()) for i in range(n)]


def test_ratio_separates_junk(spark):
    rows = _corpus(random.Random(3), 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int")
    ratio = R.fit(docs, labels.where("quality = 1"))
    score = {r["doc_id"]: r["score"] for r in R.judge(docs, ratio).collect()}
    assert min(score[i] for i, _ in rows if i % 4) > max(score[i] for i, _ in rows if i % 4 == 0)


def test_target_is_counted_whole_and_ratios_do_not_depend_on_size(spark):
    rows = _corpus(random.Random(6), 60)
    once = spark.createDataFrame(rows, "doc_id long, text string")
    copies = spark.createDataFrame([(i + 1000 * k, t) for k in range(40) for i, t in rows], "doc_id long, text string")
    ids = lambda df: df.where("doc_id % 4 != 0").select("doc_id")
    assert not hasattr(R, "TRUSTED_ROWS")
    assert np.allclose(R.fit(once, ids(once)), R.fit(copies, ids(copies)), atol=1e-5)
    target, raw = np.zeros(R.BUCKETS), np.zeros(R.BUCKETS)
    for i, t in rows:
        buf = np.frombuffer(t.encode(), np.uint8)
        n = np.bincount(R._cells(R.Texts(buf, np.array([0, len(buf)])))[0], minlength=R.BUCKETS)
        raw += n
        target += n * (i % 4 != 0)
    expected, prior = raw * target.sum() / raw.sum(), R.PRIOR * target.sum()
    assert np.allclose(R.fit(once, ids(once)), np.log((target + prior) / (expected + prior)), atol=1e-5)


def test_gam_learns_held_out_labels_and_is_repeatable(spark):
    rows = _corpus(random.Random(4), 400) + [(400, None), (401, "")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows[:400]] + [(3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = G.fit(docs, labels)
    got = {r["doc_id"]: r for r in G.score(docs, model).collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held) | {i for i in (400, 401) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(got[i]["predicted"] == int(i % 4 != 0) for i in held)
    again = G.fit(docs.repartition(7), labels.repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables))
    assert G.score(docs.where("false"), model).count() == 0
    assert {r["score"] for r in G.score(docs, G.fit(docs, labels.where("false"))).collect()} == {0.5}


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = G.train(x, y)
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.9 and m.pairs
