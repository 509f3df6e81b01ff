"""Structured Streaming scoring and live counters.

Records arrive as Parquet files in a folder (the file source replays them with
``maxFilesPerTrigger``); scoring is the same narrow projection as batch scoring,
so a micro-batch never shuffles. Running counters are streaming aggregates whose
state lives in the checkpoint; sinks are exactly-once (file sink) or idempotent
``foreachBatch`` writes keyed by the batch id, so a restart neither loses nor
double-counts records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmspark.operators.score import prediction_log_rows, score_batch, score_stored
from rfmspark.sources.tables import path_exists


def replay_source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A file-source stream over ``path`` (Parquet), ``files_per_trigger`` files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_replay_files(df: DataFrame, path: str, seq_col: str, files: int = 4) -> str:
    """Lay a table out as ``files`` Parquet files in sequence order (range-partitioned).
    Keep ``files`` proportional to the cluster (see ``replay_layout``), not fixed."""
    df.repartitionByRange(files, seq_col).sortWithinPartitions(seq_col).write.mode("overwrite").parquet(path)
    return path


def write_replay_batches(df: DataFrame, path: str, time_col: str, batches: int, files: int) -> str:
    """Lay a table out for an append-mode replay: ``batches`` ranges of time, written one after the other with ``files``
    Parquet files each. A file source takes files by age, so a trigger of ``files`` files never gets rows that are older than
    an earlier trigger's (the watermark would drop them). Rows without a time come with the first range."""
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    cuts = df.select(at.alias("t")).approxQuantile("t", [i / batches for i in range(1, batches)], 0.01)
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df.where((at < int(hi)) | at.isNull() if lo is None and hi is not None else F.lit(True) if lo is None else
                        at >= int(lo) if hi is None else (at >= int(lo)) & (at < int(hi)))
        part.repartition(files).write.mode("append").parquet(path)
    return path


def replay_layout(spark: SparkSession, batches: int = 4) -> tuple[int, int]:
    """(files, files per trigger) for replaying a table in ``batches`` micro-batches: every
    batch spans one file per core, so neither the write nor a batch runs in a few tasks."""
    per_batch = max(1, spark.sparkContext.defaultParallelism)
    return batches * per_batch, per_batch


def stream_score(stream: DataFrame, seg_params: DataFrame, centroids: DataFrame, model_params: DataFrame,
                 weights: DataFrame) -> DataFrame:
    """Score records as they arrive (segment, label, probability) plus a correctness flag
    when the true label is present."""
    s = score_batch(stream, seg_params, centroids, model_params, weights)
    if "Target" in s.columns:
        s = s.withColumn("correct", (F.col("Predicted_Purchase_Label") == F.col("Target")).cast("int"))
    return s


def stream_score_active(stream: DataFrame, store, name: str, seg_params: DataFrame, centroids: DataFrame, out_path: str,
                        checkpoint: str, rows_of=None) -> str:
    """Score every micro-batch with the model that is active when it begins, so a promotion takes effect without a restart.
    Records carry the registry id of their model; ``rows_of`` turns the scored batch into other rows (a log's).
    Each batch replaces its own folder, so a retried one leaves no second copy."""
    def write(batch: DataFrame, batch_id: int) -> None:
        row = store.active(name)
        scored = score_stored(batch, seg_params, centroids, store.load(row["filepath"]))
        if "Target" in scored.columns:
            scored = scored.withColumn("correct", (F.col("Predicted_Purchase_Label") == F.col("Target")).cast("int"))
        scored = (rows_of(scored) if rows_of else scored).withColumn("model_id", F.lit(row["id"]))
        scored.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return out_path


def stream_running_accuracy(scored: DataFrame) -> DataFrame:
    """Global running totals: processed, correct, accuracy (%) - complete-mode state."""
    return scored.agg(F.count(F.lit(1)).alias("total_processed"), F.sum("correct").cast("bigint").alias("correct"),
                      (F.sum("correct") * 100.0 / F.count(F.lit(1))).alias("running_accuracy"))


def stream_segment_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.col("Predicted_Segment").alias("segment")).agg(F.count(F.lit(1)).alias("count"))


def stream_throughput(stream: DataFrame, ts: str = "ts", width: str = "1 second", watermark: str = "10 seconds") -> DataFrame:
    """Records per event-time window (tumbling), with a watermark bounding the state.
    Event time is read as a session-time-zone timestamp (watermarks need one); the
    window bounds are returned as local timestamps again."""
    d = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (d.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("w"))
            .agg(F.count(F.lit(1)).alias("records"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "records"))


def run_to_table(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append") -> str:
    """Drain a stream (availableNow) into a Parquet table. Append mode uses the
    exactly-once file sink; complete/update results are rewritten per batch
    (idempotent: a replayed batch writes the same content)."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out_path).outputMode("append").start()
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out_path)
        q = w.outputMode(mode).foreachBatch(write).start()
    q.awaitTermination()
    return out_path


def stream_log(scored: DataFrame, out_path: str, checkpoint: str, id_col: str, ts=None) -> str:
    """Log every scored record (T7 columns) with ``foreachBatch``; each batch lands in
    its own ``batch_id=`` folder written in overwrite mode, so a retried batch replaces
    its own output instead of appending twice."""
    rows = prediction_log_rows(scored, F.col(id_col), ts if ts is not None else F.current_timestamp())

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    q = (rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(write).start())
    q.awaitTermination()
    return out_path


def stream_feed_last50(scored: DataFrame, out_path: str, checkpoint: str, seq_col: str, n: int = 50) -> str:
    """Keep the newest ``n`` records by sequence: each batch merges with the previous
    feed (at most n rows) and rewrites it - bounded state, idempotent per batch."""
    spark = scored.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        cur = batch
        if path_exists(spark, f"{out_path}/current/_SUCCESS"):  # none before the first batch; a read error is an error
            prev = spark.read.parquet(f"{out_path}/current")
            cur = prev.unionByName(batch.select(*prev.columns))
        top = cur.dropDuplicates([seq_col]).orderBy(F.col(seq_col).desc()).limit(n)  # a retried batch adds nothing
        top.write.mode("overwrite").parquet(f"{out_path}/next")
        spark.read.parquet(f"{out_path}/next").write.mode("overwrite").parquet(f"{out_path}/current")
    q = scored.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return f"{out_path}/current"
