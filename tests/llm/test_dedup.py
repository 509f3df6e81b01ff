import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rfmspark.llm import minhash as M
from rfmspark.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001/documents.parquet"


def brute_bytes(texts, w=S.WINDOW):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + w] for r in raws for i in range(len(r) - w + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - w + 1):
            if seen[r[i:i + w]] > 1:
                gone[i:i + w] = b"\1" * w
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(rng):
    letters = "abcdefghij é\n"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    p, q = make(420), make(230)
    texts = [None, "", "x", make(199), make(200), "a" * 1000, "ab" * 400, make(500), p, p, p[:300] + make(100), make(50) + p[100:] + make(70)]
    texts += [make(rng.randint(0, 300)) + q[rng.randint(0, 30):] + make(rng.randint(0, 300)) for _ in range(60)]
    return texts + [make(100) + q[:200] + make(100), make(100) + q[:199] + make(100), "é" * 300 + p[:210]]


@pytest.mark.parametrize("group", [S.GROUP, 3])
def test_repeats_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    texts = passages(random.Random(8))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "z" * 50 + texts[8], 1), (7, texts[7], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(5)
    want = Counter(zip([r[0] for r in rows], brute_bytes([r[1] for r in rows])))
    got = Counter((r[0], tuple(r)[1:]) for r in S.dedup_report(docs).collect())
    assert got == want
    cut = {r["doc_id"]: r for r in S.remove_repeats(docs.where("doc_id is not null")).collect()}
    assert cut[0]["text"] is None and cut[2]["text"] == "x" and cut[8]["text"] == "" and cut[8]["spans"] == 1
    assert S.dedup_report(docs.where("false")).count() == 0


def test_repeats_on_the_given_table(spark):
    docs = spark.read.parquet(SF)
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: b for r, b in zip(rows, brute_bytes([r["text"] for r in rows]))}
    assert {r[0]: tuple(r)[1:] for r in S.dedup_report(docs).collect()} == want


def test_removed_runs_give_one_row_per_anchor(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    p = make(900)
    # nested parts of one passage: its anchors lie in many repeats each
    texts = [make(20) + p[2 * i:900 - 3 * i] + make(20) for i in range(40)] + [p] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    everything, runs = S.repeats(docs).collect(), S.repeated_runs(docs).collect()
    assert len(runs) == len(S._found(docs)[0].join(S._found(docs)[1].select("g", "s").distinct(), F.expr("h = g and seg = s")).collect())
    assert len(runs) * 3 < len(everything)
    bytes_of = lambda rows: {(r["rid"], i) for r in rows for i in range(r["start"], r["end"])}
    assert bytes_of(runs) == bytes_of(everything)
    assert Counter((r[0], tuple(r)[1:]) for r in S.dedup_report(docs).collect()) == Counter(zip(range(len(texts)), brute_bytes(texts)))


def test_long_text_is_read_in_chunks(monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", 300)
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 123, 2000).astype(np.uint8)
    doc, at, start, end, h, _ = S.anchors(buf, np.array([0, len(buf)]))
    windows = sorted(w for s, e in zip(start, end) for w in range(s, e - S.WINDOW + 1))
    assert windows == list(range(len(buf) - S.WINDOW + 1)) and (start <= at).all() and (at + S.GRAM <= end).all()


def test_maximal_repeats_name_all_occurrences():
    before, after = [b"ba", b"bc", b"xa", b"ba"], [b"ggaaaa", b"ggaaaa", b"ggaaaa", b"ggzzzz"]
    groups = [(b, a, {m for m, _ in mem}) for b, a, mem in S.maximal_repeats(before, after, 7)]
    assert groups == [(1, 6, {0, 1})]
    assert any(len(mem) == 3 for _, _, mem in S.maximal_repeats(before, after, 6))


def test_bands_do_not_depend_on_the_slices(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "one two", "a b c d e"] + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 90))) for _ in range(120)]
    batch = pa.RecordBatch.from_pydict({"rid": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})

    def signed(size):
        monkeypatch.setattr(M, "SIGNED_BYTES", size)
        got = [list(f(iter([batch]))) for f in (M._signer, M._sets)]
        return [len(x) for x in got], [pa.Table.from_batches(x).to_pylist() for x in got]
    parts, rows = signed(1 << 20)
    small, same = signed(500)
    assert parts == [1, 1] and min(small) > 5 and rows == same


def test_draws_against_plain_numbers():
    rng = np.random.default_rng(2)
    s, h = M.Sampler(), rng.integers(0, 1 << 63, 60).astype(M.U64) * M.U64(2) + M.U64(1)
    w = rng.choice([0.3, 1.0, 2.5], 60)
    got = s.draw(np.array([0, 25, 26]), h, w)
    for k, odd in enumerate(s.odd):
        keys = []
        for x, weight in zip(h.tolist(), w.tolist()):
            a = (x * odd % (1 << 64)) >> (64 - M.DRAW_BITS)
            t = np.floor(np.log(weight) / s.r[a] + s.beta[a]) if weight != 1 else 0.0
            own = x >> 32 if weight == 1 else (x >> 32) ^ (int(M.mix(np.array([t]).astype(np.int64).astype(M.U64))[0]) >> 32)
            keys.append(int(M._ordered(np.array([s.ln_c[a] - s.r[a] * (t - s.beta[a] + 1)]))[0]) << 32 | own)
        assert got[k].tolist() == [min(keys[:25]), keys[25], min(keys[26:])]


def near_copies(rng):
    vocab = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [None, "", "  \n", "one two", "one two", "one  two\n", "a b c d e", "a b c d f"]
    for _ in range(12):
        base = make(rng.randint(60, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    chain = make(150)
    for i in range(12):
        chain = [*chain]
        chain[12 * i] = f"n{i}"
        texts.append(" ".join(chain))
    return texts


@pytest.mark.parametrize("pairs, chunk", [(M.PAIRS, M.CHUNK), (1, 8)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, pairs, chunk):
    monkeypatch.setattr(M, "PAIRS", pairs)
    monkeypatch.setattr(M, "CHUNK", chunk)
    texts = near_copies(random.Random(6))
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id int, bucket string").repartition(6)
    common = M.common_shingles(docs)
    sets = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        _, h, tf = M.shingles(raw, np.array([0, len(raw)]))
        sets.append((h, M.weigh(h, tf, common).astype("<f4")))
    part = list(range(len(texts)))

    def find(a):
        while part[a] != a:
            a = part[a]
        return a
    for i, (h, w) in enumerate(sets):
        for j in range(i):
            if len(h) and M.weighted_jaccard(h.tobytes(), w.tobytes(), sets[j][0].tobytes(), sets[j][1].tobytes()) >= M.LEVEL:
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in M.classes(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = M.deduplicate(docs.union(docs.where("doc_id = 20")))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert M.classes(docs.where("false")).count() == 0


def test_rows_with_null_or_repeated_ids_are_deduplicated_one_by_one(spark):
    rng = random.Random(11)
    make = lambda: [f"q{rng.randrange(10**6)}" for _ in range(60)]
    a, b, c, d = make(), make(), make(), make()
    near = [*c]
    near[30] = "other"
    a, b, c, d, near = (" ".join(x) for x in (a, b, c, d, near))
    # a null-id copy goes, near copies without ids leave one, and the unique text that shares its id with a copy stays
    rows = [(1, a), (None, a), (None, c), (None, near), (5, b), (6, b), (6, d), (None, ""), (None, "")]
    got = [tuple(r) for r in M.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len([t for _, t in got if t in (c, near)]) == 1
    assert sorted((x for x in got if x[1] not in (c, near)), key=str) == sorted([(1, a), (5, b), (6, d), (None, ""), (None, "")], key=str)  # rows without words are no copies


def test_common_shingles_are_counted_exactly(spark):
    line = "this very common line stands"
    texts = [line + f" here {i} {i * 7} {i * 3} and more" if i % 5 == 0 else f"text number {i} is of its own kind {i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    keys, idf = M.common_shingles(docs)
    raw = np.frombuffer(line.encode(), np.uint8)
    h = M.shingles(raw, np.array([0, len(raw)]))[1]
    assert h[0] in keys and abs(idf[list(keys).index(h[0])] - np.log(5) / np.log(20)) < 1e-9


def test_samples_agree_as_often_as_the_sets_are_similar():
    s, rng = M.Sampler(), np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 260).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    w = rng.choice([0.5, 1, 1, 2, 3], 260).astype(float)
    a, b = s.draw(np.array([0]), h[:200], w[:200]), s.draw(np.array([0]), h[40:], w[40:])
    true = w[40:200].sum() / w.sum()
    assert abs((a == b).mean() - true) < 0.17


def test_blocks_give_every_pair_that_reaches_the_level():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = []
    for i in range(60):
        h = np.unique(rng.choice(pool[(i % 3) * 100:(i % 3) * 100 + 120], 100 if i % 2 else 60, replace=False))
        sets.append((h, rng.choice([0.3, 1.0, 1.0, 2.0], len(h)).astype("<f4") if i % 5 else np.ones(len(h), "<f4")))
    sets += [(h, w * np.float32(1.1)) for h, w in sets[:20]] + [(np.arange(1, 90_000, dtype=np.uint64), np.ones(89_999, "<f4"))] * 2
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(len(sets)), pa.int64()), "h": [h.tobytes() for h, _ in sets], "w": [w.tobytes() for _, w in sets]})
    out = next(iter(M._sketch([batch])))
    assert [t is None for t in out.column("total").to_pylist()] == [False] * 80 + [True] * 2
    total = out.column("total").to_numpy(zero_copy_only=False).astype(float)
    sketch = np.frombuffer(b"".join(out.column("sketch").to_pylist()), "<u2").reshape(-1, M.GROUPS)
    node = label = np.arange(len(sets))
    like = {(i, j): M.weighted_jaccard(*(x.tobytes() for x in (*sets[i], *sets[j]))) for j in range(len(sets)) for i in range(j)}
    reach = {p for p, v in like.items() if v >= M.LEVEL}
    x, y, more = M._block(node, label, total, sketch, np.zeros(len(sets), int), 10**6)
    assert reach and reach <= set(zip(x.tolist(), y.tolist())) and not more and len(x) < len(like) / 2
    side = np.arange(len(sets)) % 2
    x, y, _ = M._block(node, label, total, sketch, side, 10**6)
    assert {p for p in reach if side[p[0]] != side[p[1]]} <= {(min(p), max(p)) for p in zip(x.tolist(), y.tolist())}
    same = np.arange(len(sets)) % 2
    x, y, more = M._block(node, same, total, sketch, np.zeros(len(sets), int), 1)
    assert len(x) == 1 and more and same[x[0]] != same[y[0]]


def test_blocks_are_told_apart_across_batches():
    h = np.arange(50, dtype=np.uint64) << np.uint64(50)
    own = next(iter(M._sketch([pa.RecordBatch.from_pydict({"node": pa.array([0], pa.int64()), "h": [h.tobytes()], "w": pa.array([b""], pa.binary())})])))
    rows = [(1, 0, 0), (1, 0, 0), (1, 0, 0), (1, 0, 1), (2, 0, 1), (2, 0, 1)]
    table = pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "i": pa.array([r[1] for r in rows], pa.int32()), "j": pa.array([r[2] for r in rows], pa.int32()),
                      "side": pa.array([0] * 6, pa.int32()), "node": pa.array(range(6), pa.int64()), "label": pa.array(range(6), pa.int64()),
                      "total": [own.column("total")[0].as_py()] * 6, "sketch": [own.column("sketch")[0].as_py()] * 6})
    for size in (1, 2, 4, 6):
        got = [r for b in M._near(9)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert {(r["bucket"], r["src"], r["dst"]) for r in got} == {(1, 0, 1), (1, 0, 2), (1, 1, 2), (2, 4, 5)}
    assert list(M._near(9)(iter([]))) == []


def joined(pairs, label):
    part = list(label)
    for a, b in pairs:
        part = [part[a] if p == part[b] else p for p in part]
    return {frozenset(i for i, p in enumerate(part) if p == q) for q in part}


@pytest.mark.parametrize("limit", [1, M.PAIRS])
@pytest.mark.parametrize("two", [False, True])
def test_blocks_with_sets_give_verified_links_only(two, limit):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = []
    for i in range(150):
        own = base[rng.permutation(200)[:200 - int(rng.integers(9, 24))]]
        h = np.unique(np.concatenate([own, rng.integers(0, 2**63, 200 - len(own)).astype(np.uint64)]))
        sets.append((h, b"" if i % 3 else rng.choice([0.5, 1.0, 1.0, 2.0], len(h)).astype("<f4").tobytes()))
    n = len(sets)
    bands = np.stack([np.where(rng.random(n) < 0.1, 7, -1 - np.arange(n)), np.full(n, 5)], axis=1)  # some share band 0's bucket too
    side = np.arange(n) % 2 if two else np.zeros(n, int)
    label = np.where(np.arange(n) < 12, 0, np.arange(n))
    rows = pa.table({"bucket": pa.array([5] * n, pa.int64()), "i": pa.array([0] * n, pa.int32()), "j": pa.array([int(two)] * n, pa.int32()), "side": pa.array(side, pa.int32()),
                     "node": pa.array(range(n), pa.int64()), "label": pa.array(label, pa.int64()), "h": [h.tobytes() for h, _ in sets], "w": pa.array([w for _, w in sets], pa.binary()),
                     "bands": pa.array(bands.tolist(), pa.list_(pa.int64()))})
    like = {(i, j): M.weighted_jaccard(sets[i][0].tobytes(), sets[i][1], sets[j][0].tobytes(), sets[j][1]) for j in range(n) for i in range(j) if not two or side[i] != side[j]}
    reach = [p for p, v in like.items() if v >= M.LEVEL]
    due = [(a, b) for a, b in reach if bands[a, 0] != bands[b, 0]]  # the others are band 0's
    got = [r for b in M._near(limit)(iter(rows.to_batches(max_chunksize=40))) for r in b.to_pylist()]
    pairs = [(r["src"], r["dst"]) for r in got]
    assert 0 < len(due) < len(reach) < len(like) / 2 and set(pairs) <= set(reach) and len(pairs) < n
    assert all(r["bucket"] == 5 and (r["a"], r["b"]) == (label[r["src"]], label[r["dst"]]) for r in got)
    least, most = joined(due, label), joined(reach, label)
    assert len(least) > 1 and joined([*pairs, *due], label) == joined(pairs, label) and joined([*pairs, *reach], label) == most


def test_pairs_of_a_group_are_verified_inside_its_blocks(spark, monkeypatch):
    rng, seen = random.Random(21), []
    base = [f"g{i}" for i in range(200)]
    texts = []
    for i in range(80):  # nearly all pairs lie under the level, though most share buckets
        t = list(base)
        for k in range(4):
            t[rng.randrange(len(t))] = f"c{i}_{k}"
        texts.append(" ".join(t))
    links = M._links
    monkeypatch.setattr(M, "_links", lambda pairs, sets: (seen.append(pairs.count()), links(pairs, sets))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert M.classes(docs).count() == len(texts)
    # one round against hubs in each pass; no pairs of the rest leave their blocks
    assert 1 <= len(seen) <= 2 and max(seen) <= len(texts) * M.BANDS


def test_a_large_group_of_copies_keeps_its_links(spark):
    rng = random.Random(9)
    base = [f"g{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(39):
        t = list(base)
        for k in range(2):
            t[rng.randrange(len(t))] = f"c{i}_{k}"
        texts.append(" ".join(t))
    texts += [" ".join(f"o{rng.randrange(10_000)}" for _ in range(60)) for _ in range(80)]
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts[:40]]
    sets = [M.shingles(r, np.array([0, len(r)]))[1].tobytes() for r in raws]
    plain = [M.weighted_jaccard(sets[0], b"", x, b"") for x in sets]
    assert all(p >= M.LEVEL for p in plain) and min(M.weighted_jaccard(a, b"", b, b"") for a in sets for b in sets) > 0.75
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    # without the base: links are only between copies, at any size of the table
    for rows in (docs, docs.where("doc_id != 0"), docs.where("doc_id < 40 and doc_id != 0")):
        got = {r["doc_id"]: r["class_id"] for r in M.classes(rows).collect()}
        least = min(got)
        assert {got[i] for i in got if i < 40} == {least} and all(got[i] == i for i in got if i >= 40)


def test_deduplicate_keeps_clashing_columns_and_wordless_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "a", 1, 2), (2, text, "b", 3, 4), (2, text, "b", 3, 4), (None, None, "c", 5, 6), (None, None, "c", 5, 6), (7, " ", "d", 7, 8), (7, " ", "d", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rid string, _gone int, label int")
    left = M.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id != 2").collect()))


def test_closure_of_long_chains_and_stars(spark):
    rng = random.Random(4)
    names = rng.sample(range(-10**6, 10**6), 400)
    edges = {tuple(sorted(names[i:i + 2])) for i in range(150)} | {tuple(sorted((names[200], names[i]))) for i in range(201, 330)} | {tuple(sorted(names[398:400]))}
    part = {n: n for e in edges for n in e}
    for _ in part:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    links = spark.createDataFrame(sorted(edges), "a long, b long").repartition(5).checkpoint()
    assert {r["old"]: r["new"] for r in M._closure(links).collect()} == part


def test_every_shingle_weighs_by_its_document_frequency(spark):
    rng = random.Random(12)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(100)
    # one passage in 5 texts of 200, far under COMMON: the first two are near copies by flat weights only
    texts = [passage + own(10), passage + own(10)] + [passage + own(200) for _ in range(3)] + [own(40) for _ in range(195)]
    near = own(150)
    texts += [near, near[:-3] + own(3), near]
    grams = [{tuple(t[i:i + M.WIDTH]) for i in range(len(t) - M.WIDTH + 1)} for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    classes = [{0, 1}, {200, 201, 202}] + [{i} for i in range(2, 200)]  # by flat weights
    df = Counter(g for c in classes for g in set().union(*(grams[i] for i in c)))
    weight = {g: np.log(len(classes) / n) for g, n in df.items()}
    like = lambda a, b, w: sum(w(g) for g in grams[a] & grams[b]) / sum(w(g) for g in grams[a] | grams[b])
    assert like(0, 1, lambda g: 1) >= M.LEVEL > like(0, 1, weight.get) and like(200, 201, weight.get) >= M.LEVEL
    got = {r["doc_id"]: r["class_id"] for r in M.classes(docs).collect()}
    assert got == {i: 200 if i > 200 else i for i in range(len(texts))}


def test_frequencies_come_back_to_the_texts_that_hold_them():
    texts = ["a b c d e f", "a b c d e g", "x a b c d e", "k l m n o", ""]
    rows = [pa.RecordBatch.from_pydict({"rid": pa.array([10 * i + j for j in range(len(texts))], pa.int64()), "text": texts, "one": [True, True, True, False, True]}) for i in (1, 2)]
    dealt = pa.Table.from_batches(list(M._deal(4)(iter(rows))))
    counted = pa.concat_tables([M._count(dealt.filter(pa.array([p == q for q in dealt.column("part").to_pylist()]))) for p in set(dealt.column("part").to_pylist())])
    for i in (1, 2):
        found = {r["node"]: r for r in M._by_text(counted.filter(pa.array([b == 10 * i for b in counted.column("batch").to_pylist()]))).to_pylist()}
        assert set(found) == {10 * i, 10 * i + 1, 10 * i + 2}  # uncounted texts' shingles and lone ones are left out
        for node, r in found.items():
            raw = np.frombuffer(texts[node % 10].encode(), np.uint8)
            h = M.shingles(raw, np.array([0, len(raw)]))[1] >> np.uint64(16)
            # in both slices: 3 texts each hold "a b c d e", the others' shingles stand once a slice
            df = dict(zip(np.frombuffer(r["keys"], "<u8").tolist(), np.frombuffer(r["df"], "<u4").tolist()))
            assert set(df) == set(h.tolist()) and sorted(df.values()) == [2, 6]
