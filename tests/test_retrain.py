import pytest
from pyspark.sql import functions as F

from rfmspark.operators import retrain
from rfmspark.operators.model_store import ModelStore
from rfmspark.plans.context import FEATURE_MONTHS, Ctx
from rfmspark.sources.tables import fingerprint


@pytest.fixture(scope="module")
def raw(spark):
    cols = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]
    return Ctx(spark, "/root/testdata/sf0.001").retail(cols).checkpoint()


def test_resume_after_a_crash_redoes_only_what_is_missing(spark, raw, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    calls = []

    def trainer(split):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("lost")
        return retrain.linear_training(split)

    def go(rows=raw):
        return {r["phase"]: r for r in retrain.retrain_pipeline(rows, out, feature_months=FEATURE_MONTHS, train=trainer, judged="class_mean_linear").collect()}
    with pytest.raises(RuntimeError, match=r"phase 6 \(train\)"):
        go()
    root = f"{out}/run={retrain.run_id(raw, None, FEATURE_MONTHS, 'trainer', 'class_mean_linear', 'seeded_segments')}"
    done = retrain.PHASES[:5]
    state = retrain.Manifest(spark, root)
    assert [state.finished(p) for p in retrain.PHASES] == [True] * 5 + [False] * 4
    before = [fingerprint(spark, f"{root}/{i}_{p}") for i, p in enumerate(done, 1)]
    spark.range(7).write.parquet(f"{root}/6_train")  # a table without its manifest line is half written

    # the next run dies after it published, before its line was written
    phase = retrain.Manifest.phase

    def dies(self, name, make):
        if name == "registry":
            make()
            raise KeyboardInterrupt
        return phase(self, name, make)
    with monkeypatch.context() as m:
        m.setattr(retrain.Manifest, "phase", dies)
        with pytest.raises(KeyboardInterrupt):
            go()
    got = go(raw.repartition(3))  # the same rows in another order
    assert list(got) and sorted(got, key=lambda p: got[p]["phase_no"]) == retrain.PHASES and all(r["status"] == "completed" for r in got.values())
    assert before == [fingerprint(spark, f"{root}/{i}_{p}") for i, p in enumerate(done, 1)] and len(calls) == 2
    registry = ModelStore(spark, f"{out}/store").registry()
    assert registry.count() == 2 == got["registry"]["rows"] and got["drift"]["rows"] == 9 and got["raw_subset"]["rows"] == raw.count()
    assert go() == got and registry.count() == 2 and len(calls) == 2

    # other input is another run, and one more registration
    less = raw.where(F.col("CustomerID") != raw.first()["CustomerID"])
    assert go(less)["raw_subset"]["rows"] == less.count() and ModelStore(spark, f"{out}/store").registry().count() == 4
