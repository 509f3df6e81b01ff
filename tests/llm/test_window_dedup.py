import hashlib
import random
import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from rfmspark.llm.common import RELEASE, releasing
from rfmspark.llm import window_dedup as W

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, w=W.WINDOW):
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    big = 1 << 63
    for (d, _), ws in zip(rows, split):
        for i in range(len(ws) - w + 1):
            g = tuple(ws[i:i + w])
            first[g] = min(first.get(g, big), big if d is None else d)
    out = []
    for (d, _), ws in zip(rows, split):
        gone = set()
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i:i + w])] < (big if d is None else d):
                gone |= set(range(i, i + w))
        kept = " ".join(x for i, x in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(rng):
    vocab = [f"v{i}é" for i in range(30)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    p = make(60)
    texts = [None, "", " \n ", "a b", " ".join(p), " ".join(p), "  " + "\t".join(p[:13]) + " ", " ".join(p[:12]), "x " * 40, "x " * 50]
    for _ in range(60):
        a = rng.randint(0, 40)
        texts.append("\n".join(make(rng.randint(0, 30)) + p[a:a + rng.randint(5, 30)] + make(rng.randint(0, 30))))
    return texts


def test_windows_against_brute_force(spark):
    rng = random.Random(12)
    texts = corpus(rng)
    ids = rng.sample(range(500), len(texts))
    rows = [*zip(ids, texts), (None, texts[4] + " more"), (ids[4], texts[4])]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, first int, key int").repartition(5)
    got = sorted((tuple(r) for r in W.dedup_report(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert W.dedup_report(docs.where("false")).count() == 0


def test_null_and_repeated_ids_with_different_texts(spark):
    rng = random.Random(5)
    make = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = make(40), make(60), make(30)
    rows = [(1, a), (2, b), (None, a), (None, make(50)), (None, make(20) + " " + b), (None, make(3)), (None, make(14)), (None, c), (None, c),
            (7, a), (7, make(45)), (7, make(30) + " " + b), (7, make(13)), (7, "x"), (7, c), (7, c), (9, make(25) + " " + c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 4):
        got = sorted((tuple(r) for r in W.dedup_report(docs.coalesce(1).repartition(n)).collect()), key=str)
        assert got == sorted(brute(rows), key=str)


def test_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, W.dedup_report(docs).collect())) == sorted(brute(rows))


def test_levels_double_until_none_survives(spark):
    p = [f"w{i}" for i in range(70)]
    docs = spark.createDataFrame([(0, " ".join(p)), (1, "a " + " ".join(p[:60]) + " b"), (2, " ".join(p[:20]))], "doc_id long, text string")
    got = W.levels(docs)
    assert [n for n, _ in got] == [13, 26, 52]
    assert {n: df.where("key = 1").count() for n, df in got} == {13: 48, 26: 35, 52: 9}


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    folders = [Path(p) for p in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f.name for p in folders for f in p.rglob("shuffle_*.data")}

    def gone():  # Spark deletes them in the background
        end = time.monotonic() + 30
        while files() - before and time.monotonic() < end:
            time.sleep(0.2)
        return not files() - before
    before = files()
    with releasing(spark):
        kept = spark.range(5000).groupBy(F.col("id") % 700).count().checkpoint()
    assert gone() and kept.count() == 700 and spark.conf.get(RELEASE, None) is None
