import corpus_pipeline as P
from rfmspark.llm import minhash, packing, pii, quality_gam

from .test_dedup import brute_bytes

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "row")  # a name that operators use inside
    before, frames = docs, []
    for name, stage in P.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        frames.append(before)
    quality, near, passages, private, packed = frames
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_passages", "private_data", "packing"]
    assert all(sorted(f.columns) == sorted(docs.columns) for f in frames[:4])
    ids = lambda f: sorted(r["doc_id"] for r in f.select("doc_id").collect())
    model = quality_gam.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(quality) == ids(quality_gam.score(docs, model).where("predicted = 1"))
    assert ids(near) == sorted({r["class_id"] for r in minhash.classes(quality).collect()})
    text = {r["doc_id"]: r["text"] for r in near.collect()}
    lost = dict(zip(text, (b[1] for b in brute_bytes(list(text.values())))))
    for r in passages.collect():
        whole = len((text[r["doc_id"]] or "").encode())
        # whole code points only, so up to three bytes at either end of a removed run stay
        assert whole - lost[r["doc_id"]] <= len(r["text"].encode()) <= whole - lost[r["doc_id"]] + (6 + whole // 50) * (lost[r["doc_id"]] > 0)
        assert r["n_chars"] == len(r["text"])
    assert ids(private) == ids(passages) and not any("@mail" in r["text"] for r in private.collect())
    assert {r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in pii.report(private).collect()} == {0}
    assert sorted({r["doc_id"] for r in packed.collect()}) == ids(private)
    assert packed.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.CAPACITY}").count() == 0


def test_run_gives_the_last_stages_rows(spark):
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(P.run(spark, SF).columns)
