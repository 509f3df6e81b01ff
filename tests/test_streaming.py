import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rfmspark.sources import files
from rfmspark.streaming import stream as st


def _scored_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"seq": np.arange(n), "CustomerID": [str(i) for i in range(n)],
                         "Target": rng.integers(0, 2, n), "Predicted_Purchase_Label": rng.integers(0, 2, n),
                         "Predicted_Segment": rng.choice(["Champions", "At-Risk"], n)})


def test_restart_from_checkpoint_neither_loses_nor_double_counts(spark):
    pdf = _scored_rows(200)
    df = spark.createDataFrame(pdf)
    src = files.scratch_table(spark, "replay")
    # first half arrives, the query drains it and stops
    df.where("seq < 100").repartition(2).write.mode("append").parquet(src)
    schema = df.schema
    out_acc = files.scratch_table(spark, "acc")
    out_seg = files.scratch_table(spark, "seg")

    def drain():
        s = st.replay_source(spark, src, schema, 1).withColumn(
            "correct", (F.col("Predicted_Purchase_Label") == F.col("Target")).cast("int"))
        st.run_to_table(st.stream_running_accuracy(s), out_acc, out_acc + "_ckpt", "complete")
        st.run_to_table(s.select("seq", "correct"), out_seg, out_seg + "_ckpt", "append")

    drain()
    # the rest arrives later; the restarted query resumes from its checkpoint
    df.where("seq >= 100").repartition(2).write.mode("append").parquet(src)
    drain()
    drain()  # nothing new: a third run must not change anything
    acc = spark.read.parquet(out_acc).first()
    assert acc.total_processed == 200
    assert acc.correct == int((pdf.Target == pdf.Predicted_Purchase_Label).sum())
    logged = spark.read.parquet(out_seg)
    assert logged.count() == 200 and logged.select("seq").distinct().count() == 200


def test_feed_keeps_newest_fifty(spark):
    pdf = _scored_rows(120)
    df = spark.createDataFrame(pdf)
    src = files.scratch_table(spark, "feed_src")
    st.write_replay_files(df, src, "seq", files=3)
    out = files.scratch_table(spark, "feed")
    path = st.stream_feed_last50(st.replay_source(spark, src, df.schema, 1), out, out + "_ckpt", "seq", 50)
    got = sorted(r.seq for r in spark.read.parquet(path).collect())
    assert got == list(range(70, 120))
