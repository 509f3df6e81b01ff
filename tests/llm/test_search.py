"""Operators 11 and 12 against brute force, and the DuckDB twins on whole small tables."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from rfmspark.llm import exact_topk, lexical
from rfmspark.llm.toplists import merge_tree

VECTORS = "vec_id long, embedding array<double>, query_id int, score string, shard int, vec binary"


def brute_products(rows, k=10):
    ok = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in ok:
        if q % 100 == 0:
            found = [(sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v)]
            found = [(max(min(s, 2**63 - 1), -2**63 + 1), i) for s, i in found]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def products(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "x", 2, b"") for i, v in rows], VECTORS).repartition(4)
    return sorted(tuple(r) for r in exact_topk.top_products(df, df.where("vec_id % 100 = 0"), **how).collect())


@pytest.mark.parametrize("how", [{}, {"shard_rows": 64, "block_rows": 2}, {"shard_rows": 7, "k": 3}])
def test_products_equal_brute_force(spark, how, monkeypatch):
    monkeypatch.setattr(exact_topk, "SUB_ROWS", 16)
    monkeypatch.setattr(exact_topk, "SUB_QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 6).round(2)]) for i in range(700)]
    rows += [(i, [0.5] * 6) for i in range(1000, 1300)]                                  # one vector that very many rows share
    rows += [(i, [0.0] * 6) for i in range(1300, 1310)] + rows[:20]                      # zeros, repeated rows
    rows += [(None, [0.1] * 6), (2000, None), (2001, [None] * 6), (2100, [math.nan] * 6), (2200, [math.inf] * 6)]
    rows += [(2300, [0.5] * 3), (2301, [0.25] * 3), (2400, []), (2401, [])]              # other lengths
    rows += [(100, [0.3] * 6), (101, [0.4] * 6)]                                         # ids with a second vector
    assert products(spark, rows, **how) == brute_products(rows, how.get("k", 10))


def test_products_stay_exact_for_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 10.0 ** (i % 8), 4)]) for i in range(300)] + [(400, [1e12] * 4), (401, [-1e12] * 4)]
    assert products(spark, rows) == brute_products(rows)


def test_products_of_nothing(spark):
    assert products(spark, []) == []
    assert products(spark, [(100, [1.0])]) == []
    assert products(spark, [(1, [1.0]), (3, [1.0])]) == []


def test_select_ties_to_the_left():
    scores = np.array([[5, 7, 5, 7, 5], [1, 1, 1, 1, 1]])
    row, col = exact_topk.select(scores, np.array([[True, True, True, True, True], [False, True, True, True, True]]), 3)
    assert list(zip(row, col)) == [(0, 0), (0, 1), (0, 3), (1, 1), (1, 2), (1, 3)]


def test_merge_tree_is_a_plain_top_list(spark):
    rows = [(q, n, (7 * n + 3 * i + q) % 50, n * 10 + i) for q in range(3) for n in range(300) for i in range(4)]
    df = spark.createDataFrame(rows, "q int, node int, score int, id int")
    from pyspark.sql import functions as F
    got = merge_tree(df, ["q"], "node", [F.desc("score"), F.asc("id")], 5, 300).select("q", "rank", "id").collect()
    want = [(q, r + 1, x[1]) for q in range(3) for r, x in enumerate(sorted(((s, i) for p, _, s, i in rows if p == q), key=lambda x: (-x[0], x[1]))[:5])]
    assert sorted(map(tuple, got)) == want


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_ranks(docs, items, k=10):
    def terms(text):
        return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        scores = []
        for d, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, times in q.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def ranks(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], "doc_id long, text string, item_id long, node int, term string").repartition(4)
    i = spark.createDataFrame([(*r, 1, 2.0) for r in items], "item_id long, text string, doc_id long, score double")
    return sorted((tuple(r) for r in lexical.ranked(d, i, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"k": 2, "block_terms": 5}, {"block_terms": 40}])
def test_ranks_equal_brute_force(spark, how, monkeypatch):
    monkeypatch.setattr(lexical, "HELD_ROWS", 50)
    monkeypatch.setattr(lexical, "SLICE_DOCS", 7)
    rng = np.random.default_rng(4)
    vocab = ["the", "The", "a", "über", "naïve", "x1", "42", "東京", "don", "t", "zebra", "Ärger", "foo", "bar", " ", "ſ"]

    def text(n):
        return "".join(str(w) + rng.choice([" ", "  ", "-", "'", ".\n", "\t", "@[`{\x7f"]) for w in rng.choice(vocab, n))
    docs = [(i, text(rng.integers(1, 60))) for i in range(120)] + [(i, "the the zebra") for i in range(500, 540)]
    docs += [(7, "zebra zebra"), (None, "zebra 東京"), (None, None), (900, ""), (901, " ... \n"), (902, text(20_000))]
    items = [(i, text(8)) for i in range(12)] + [(3, "zebra zebra zebra"), (3, "zebra zebra zebra"), (20, None), (21, ""), (22, "missing words"), (None, "東京 x1"), (23, "東京東京")]
    assert ranks(spark, docs, items, **how) == brute_ranks(docs, items, how.get("k", 10))


def test_ranks_of_nothing(spark):
    assert ranks(spark, [], [(1, "a")]) == [] and ranks(spark, [(1, "a")], []) == [] and ranks(spark, [(1, None)], [(1, None)]) == []


def test_terms_share_their_guards():
    found = lexical.folded("A-a B,a__a9é/É".encode()).decode()
    assert found.split() == ["a", "a", "b", "a", "a9é", "É"]


@pytest.mark.parametrize("name", ["op11_tiled_topk", "op12_lexical_scan"])
def test_equal_their_sql(spark, name):
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()[name](spark, folder).collect()) == want and want
