"""Segmentation: business labels, nearest centroid, seeded segmentation and Spark ML
clustering (SURVEY §2.8). Centroid tables have one row per segment (k is a small,
checked parameter), so they are the only thing broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rfmspark.functions.scalar import fn_round_half_up
from rfmspark.operators.stats import exact_quantiles
from rfmspark.schemas import SCALED_FEATURES, SEGMENT_ORDER

MAX_CENTROIDS = 1024


def segment_order(df: DataFrame, col: str = "Segment", out: str = "Segment_Order") -> DataFrame:
    m = F.create_map(*[x for k, v in SEGMENT_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, m[F.col(col)])


def cluster_profile(df: DataFrame, cluster: str = "KMeans_Cluster",
                    cols: tuple[str, ...] = ("Recency", "Frequency", "Monetary")) -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols])


def cluster_noise_stats(df: DataFrame, cluster: str = "DBSCAN_Cluster") -> DataFrame:
    n = F.count(F.lit(1))
    noise = F.count_if(F.col(cluster) == -1)
    return df.agg(F.countDistinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("n_clusters"),
                  noise.alias("n_noise"), (noise * 100.0 / n).alias("noise_pct"))


def label_segments(df: DataFrame, cluster: str = "KMeans_Cluster", monetary: str = "Monetary",
                   recency: str = "Recency") -> DataFrame:
    """Mapping cluster -> label for four clusters: highest mean Monetary = Champions,
    lowest = Lost Customers; of the middle two the higher mean Recency is At-Risk
    (equal Recency: the one with lower Monetary), the other Loyal Customers."""
    prof = df.groupBy(cluster).agg(F.avg(monetary).alias("_m"), F.avg(recency).alias("_r"))
    # at most k rows: the ranking windows run over a bounded table
    by_m = Window.orderBy(F.col("_m").desc(), F.col(cluster))
    prof = prof.withColumn("_pos", F.row_number().over(by_m)).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy()))
    mid = (F.col("_pos") > 1) & (F.col("_pos") < F.col("_k"))
    by_r = Window.partitionBy(mid).orderBy(F.col("_r").desc(), F.col("_pos").desc())
    prof = prof.withColumn("_rpos", F.row_number().over(by_r))
    label = (F.when(F.col("_pos") == 1, "Champions")
             .when(F.col("_pos") == F.col("_k"), "Lost Customers")
             .when(F.col("_rpos") == 1, "At-Risk")
             .otherwise("Loyal Customers"))
    return prof.select(F.col(cluster), label.alias("Segment"))


def join_map_label(df: DataFrame, mapping: DataFrame, cluster: str = "KMeans_Cluster") -> DataFrame:
    """Attach the label of each cluster id (mapping has one row per cluster)."""
    return df.join(F.broadcast(mapping), cluster, "left")


def segment_centroids(df: DataFrame, cols: list[str] | None = None, segment: str = "Segment") -> DataFrame:
    cols = cols or SCALED_FEATURES
    return df.groupBy(segment).agg(*[F.avg(c).alias(c) for c in cols])


def pack_centroids(centroids: DataFrame, cols: list[str], segment: str = "Segment") -> DataFrame:
    """One row holding ``array<struct<segment, c: array<double>>>``; fails if k is not small."""
    k = centroids.count()
    if k > MAX_CENTROIDS:
        raise ValueError(f"{k} centroids exceed the broadcast bound {MAX_CENTROIDS}")
    return centroids.agg(F.collect_list(F.struct(F.col(segment).alias("segment"),
                                                 F.array(*[F.col(c).cast("double") for c in cols]).alias("c")))
                         .alias("_cents"))


def nearest_centroid(df: DataFrame, centroids: DataFrame, cols: list[str], segment: str = "Segment",
                     out: str = "Predicted_Segment", dist_out: str | None = "Centroid_Distance",
                     centroid_cols: list[str] | None = None) -> DataFrame:
    """Nearest centroid by Euclidean distance; ties go to the alphabetically first
    segment; ``Unknown`` when there are no centroids. A narrow transformation: the
    k centroids are broadcast as one array and folded per row (no k-fold rows)."""
    packed = pack_centroids(centroids, centroid_cols or cols, segment)
    x = F.array(*[F.col(c).cast("double") for c in cols])

    def dist(c):
        sq = F.zip_with(x, c["c"], lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))

    best = F.array_min(F.transform("_cents", lambda c: F.struct(dist(c).alias("d"), c["segment"].alias("s"))))
    res = df.crossJoin(F.broadcast(packed)).withColumn("_best", best)
    res = res.withColumn(out, F.coalesce(F.col("_best.s"), F.lit("Unknown")))
    if dist_out:
        res = res.withColumn(dist_out, F.col("_best.d"))
    return res.drop("_cents", "_best")


def seeded_segments(scaled: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Deterministic segmentation (used where an exact twin in SQL is wanted):
    quartiles of Monetary (cents) seed four clusters, the clusters get business
    labels, and one nearest-centroid step on the scaled features refines them.
    Returns the input plus ``Seed_Cluster``, ``Segment``, ``Segment_Order``."""
    cols = cols or SCALED_FEATURES
    base = scaled.withColumn("_mc", fn_round_half_up(F.col("Monetary"), 2))
    q = exact_quantiles(base, "_mc", [0.25, 0.5, 0.75]).groupBy().agg(
        *[F.max(F.when(F.col("p_index") == i, F.col("q"))).alias(f"_q{i}") for i in range(3)])
    seeded = base.crossJoin(F.broadcast(q)).withColumn(
        "Seed_Cluster", F.when(F.col("_mc") <= F.col("_q0"), 0).when(F.col("_mc") <= F.col("_q1"), 1)
        .when(F.col("_mc") <= F.col("_q2"), 2).otherwise(3)).drop("_q0", "_q1", "_q2", "_mc")
    labels = label_segments(seeded, "Seed_Cluster")
    first = seeded.join(F.broadcast(labels), "Seed_Cluster").withColumnRenamed("Segment", "_seed_segment")
    cents = segment_centroids(first, cols, "_seed_segment").withColumnRenamed("_seed_segment", "Segment")
    out = nearest_centroid(first, cents, cols, out="Segment", dist_out=None).drop("_seed_segment")
    return segment_order(out)


def assign_segment(df: DataFrame, centroids: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return nearest_centroid(df, centroids, cols or SCALED_FEATURES)


# --------------------------------------------------------------------------- Spark ML clustering


def _vectors(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def _kmeans_best(vec: DataFrame, ks, restarts: int, seed: int, max_iter: int, out: str) -> list:
    """The model of lowest training cost for each k. All fits are independent, so they share one pool:
    as many run at once as the cluster has cores, since a small table's fit is many short jobs."""
    from pyspark.ml.clustering import KMeans

    from rfmspark.operators.learn import FIT_PARALLELISM, run_parallel

    def fit(k, i):
        return lambda: KMeans(k=k, seed=seed + i, maxIter=max_iter, initMode="k-means||", featuresCol="features",
                              predictionCol=out).fit(vec)
    ks = list(ks)
    at_once = max(FIT_PARALLELISM, vec.sparkSession.sparkContext.defaultParallelism)
    fitted = run_parallel([fit(k, i) for k in ks for i in range(restarts)], at_once)
    return [min(fitted[j * restarts:(j + 1) * restarts], key=lambda m: m.summary.trainingCost) for j in range(len(ks))]  # ties: the first


def kmeans_fit(df: DataFrame, cols: list[str] | None = None, k: int = 4, restarts: int = 10, seed: int = 42,
               max_iter: int = 300, out: str = "KMeans_Cluster"):
    """K-Means (k-means|| init) restarted with ``restarts`` seeds; the lowest
    training cost wins. Returns (labelled DataFrame, model)."""
    cols = cols or SCALED_FEATURES
    vec = _vectors(df, cols).persist()
    best, = _kmeans_best(vec, [k], restarts, seed, max_iter, out)
    vec.unpersist()
    return best.transform(_vectors(df, cols)).drop("features"), best  # lazy, so from the rows, not from the dropped copy


BLOCK = 4096  # rows of a packed block: their distances to a fit's centres stay in the processor's cache


def _blocks(df: DataFrame, cols: list[str]) -> DataFrame:
    """The rows of ``cols`` as blocks of packed doubles, dealt over the cluster's cores."""
    def pack(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(cols))]).astype("f8")
            yield pa.RecordBatch.from_pydict({"block": [x[i:i + BLOCK].tobytes() for i in range(0, len(x), BLOCK)]}, pa.schema([("block", pa.binary())]))
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(pack, "block binary") \
        .repartition(df.sparkSession.sparkContext.defaultParallelism)


def _assignment_sums(centres: dict, width: int):
    """For each fit and centre: rows nearest to it (ties: the first) and their coordinate sums, per task; a fit's squared distances stand at its first centre."""
    def sums(batches):
        import numpy as np
        import pyarrow as pa
        total = {i: np.zeros((len(c), width + 1)) for i, c in centres.items()}
        cost = dict.fromkeys(centres, 0.0)
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer()).reshape(-1, width)
                across, square, counted = np.ascontiguousarray(x.T), (x ** 2).sum(1), np.column_stack([x, np.ones(len(x))])
                for i, c in centres.items():
                    far = (c ** 2).sum(1)[:, None] - (2 * c) @ across
                    least = far.min(0)
                    own = far == least
                    if np.count_nonzero(own) != len(x):  # ties
                        own &= np.cumsum(own, 0) == 1
                    total[i] += own.astype("f8") @ counted
                    cost[i] += float(np.maximum(least + square, 0).sum())
        rows = [(i, j, s[width], cost[i] if j == 0 else 0.0, *s[:width]) for i, t in total.items() for j, s in enumerate(t.tolist())]
        names = ["fit", "j", "n", "cost", *(f"s{i}" for i in range(width))]
        types = [pa.int32(), pa.int32()] + [pa.float64()] * (width + 2)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)
    return sums


def _lloyd(blocks: DataFrame, centres: list, max_iter: int, tol: float) -> list:
    """(centres, cost) of every fit, from its first centres until none moves by more than ``tol`` or ``max_iter`` rounds are over.
    All fits that still move share one job a round. The cost is the last round's, before its centres moved (Spark's training cost)."""
    import numpy as np
    width = len(centres[0][0])
    schema = "fit int, j int, n double, cost double, " + ", ".join(f"s{i} double" for i in range(width))
    moving, costs = {i: np.array(c) for i, c in enumerate(centres)}, [0.0] * len(centres)
    done = list(moving.values())
    for _ in range(max_iter):
        if not moving:
            break
        found = blocks.mapInArrow(_assignment_sums(moving, width), schema).groupBy("fit", "j") \
            .agg(*[F.sum(c).alias(c) for c in ("n", "cost", *(f"s{i}" for i in range(width)))]).collect()  # a row per centre
        for i in moving:
            costs[i] = 0.0
        moved = {i: c.copy() for i, c in moving.items()}
        for r in found:
            costs[r["fit"]] += r["cost"]
            if r["n"] > 0:  # a centre without rows stays
                moved[r["fit"]][r["j"]] = np.array(r[4:]) / r["n"]
        for i, c in moved.items():
            done[i] = c
        moving = {i: c for i, c in moved.items() if (((c - moving[i]) ** 2).sum(1) > tol * tol).any()}
    return list(zip(done, costs))


def _nearest(centres: list):
    """Rows of the blocks with the number of the nearest centre of every fit (ties: the first)."""
    def near(batches):
        import numpy as np
        import pyarrow as pa
        width = len(centres[0][0])
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer())
                across = np.ascontiguousarray(x.reshape(-1, width).T)
                found = [((c ** 2).sum(1)[:, None] - (2 * c) @ across).argmin(0).astype("f8") for c in centres]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, width), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([rows, *map(pa.array, found)], ["x", *(f"l{i}" for i in range(len(found)))])
    return near


def kmeans_sweep(df: DataFrame, cols: list[str] | None = None, ks=range(2, 11), seed: int = 42,
                 restarts: int = 10) -> DataFrame:
    """(k, inertia, silhouette) per k; silhouette by ``ClusteringEvaluator`` (squared Euclidean). Each fit starts from Spark's
    k-means|| centres of its seed; the rounds of all fits run together, so their jobs don't grow with ks and restarts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    from rfmspark.operators.learn import FIT_PARALLELISM, run_parallel
    cols = cols or SCALED_FEATURES
    spark, ks = df.sparkSession, list(ks)
    vec = _vectors(df, cols).select("features").persist()  # assembled once for every k
    starts = run_parallel([(lambda k=k, i=i: KMeans(k=k, seed=seed + i, maxIter=0, initMode="k-means||").fit(vec).clusterCenters()) for k in ks for i in range(restarts)],
                          max(FIT_PARALLELISM, spark.sparkContext.defaultParallelism))
    blocks = _blocks(df, cols).persist()
    fits = _lloyd(blocks, starts, 300, KMeans().getTol())
    vec.unpersist()
    best = [min(fits[j * restarts:(j + 1) * restarts], key=lambda f: f[1]) for j in range(len(ks))]  # ties: the first
    labelled = blocks.mapInArrow(_nearest([c for c, _ in best]), "x array<double>, " + ", ".join(f"l{i} double" for i in range(len(ks)))) \
        .withColumn("features", array_to_vector("x")).drop("x").persist()
    sils = run_parallel([(lambda i=i: float(ClusteringEvaluator(featuresCol="features", predictionCol=f"l{i}", distanceMeasure="squaredEuclidean").evaluate(labelled)))
                         for i in range(len(ks))])
    labelled.unpersist()
    blocks.unpersist()
    rows = [(int(k), float(cost), sil) for k, (_, cost), sil in zip(ks, best, sils)]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette_sq_euclidean double")


def pca_2d(df: DataFrame, cols: list[str] | None = None, id_col: str = "CustomerID"):
    """Two principal components of the centred features (sign fixed so the largest
    loading is positive). Returns (projected DataFrame, explained variance ratios)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    cols = cols or SCALED_FEATURES
    means = df.agg(*[F.avg(c).alias(c) for c in cols])
    centred = df.crossJoin(F.broadcast(means.select(*[F.col(c).alias(f"_m_{c}") for c in cols])))
    for c in cols:
        centred = centred.withColumn(f"_c_{c}", F.col(c) - F.col(f"_m_{c}"))
    vec = _vectors(centred, [f"_c_{c}" for c in cols])
    model = PCA(k=2, inputCol="features", outputCol="pcs").fit(vec)
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(vec).select(id_col, vector_to_array("pcs").alias("_p"))
    out = out.select(id_col, (F.col("_p")[0] * signs[0]).alias("PCA1"), (F.col("_p")[1] * signs[1]).alias("PCA2"))
    return out, [float(v) for v in model.explainedVariance.toArray()]


# --------------------------------------------------------------------------- two-stage Ward


def _ward_merges(centroids, sizes):
    """Ward agglomeration of weighted points (micro-cluster centroids): returns the
    merge list [(left, right, height, size)] with scipy-style ids (leaves 0..m-1,
    merged clusters m, m+1, ...) and height sqrt(2 * increase of the within SSE)."""
    import numpy as np
    c = {i: np.asarray(v, dtype=float) for i, v in enumerate(centroids)}
    w = {i: float(s) for i, s in enumerate(sizes)}
    nxt = len(c)
    merges = []
    while len(c) > 1:
        keys = sorted(c)
        best = None
        for ai, a in enumerate(keys):
            for b in keys[ai + 1:]:
                inc = w[a] * w[b] / (w[a] + w[b]) * float(((c[a] - c[b]) ** 2).sum())
                if best is None or inc < best[0]:
                    best = (inc, a, b)
        inc, a, b = best
        size = w[a] + w[b]
        c[nxt] = (c[a] * w[a] + c[b] * w[b]) / size
        w[nxt] = size
        merges.append((a, b, float((2 * inc) ** 0.5), int(size)))
        del c[a], c[b], w[a], w[b]
        nxt += 1
    return merges


def hierarchical_ward(df: DataFrame, id_col: str = "CustomerID", cols: list[str] | None = None, k: int = 4,
                      micro: int = 200, seed: int = 42):
    """Ward clustering in two stages: K-Means micro-clusters (at most ``micro``) on
    Spark, then Ward merges of their size-weighted centroids (a bounded table), cut
    at ``k`` clusters and mapped back with a broadcast join. Returns (labels, merges)."""
    cols = cols or SCALED_FEATURES
    n = df.count()
    m = max(1, min(micro, n))
    res, _ = kmeans_fit(df, cols, k=m, restarts=1, seed=seed, out="_micro")
    stats = res.groupBy("_micro").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols]) \
        .orderBy("_micro").collect()  # <= micro rows
    micro_ids = [r_["_micro"] for r_ in stats]
    merges = _ward_merges([[r_[c] for c in cols] for r_ in stats], [r_["n"] for r_ in stats])
    # cut: undo the last k-1 merges
    members = {i: [i] for i in range(len(stats))}
    nid = len(stats)
    for a, b, _, _ in merges:
        members[nid] = members.pop(a) + members.pop(b)
        nid += 1
        if len(members) == k:
            break
    groups = sorted(members.values(), key=lambda g: min(g))
    mapping = [(int(micro_ids[i]), gi) for gi, g in enumerate(groups) for i in g]
    spark = df.sparkSession
    mp = spark.createDataFrame(mapping, "_micro int, Hierarchical_Cluster int")
    labels = res.join(F.broadcast(mp), "_micro").select(id_col, "Hierarchical_Cluster")
    tail = merges[-30:]
    first = len(merges) - len(tail)
    mt = spark.createDataFrame([(first + i + 1, int(a), int(b), float(h), int(sz)) for i, (a, b, h, sz) in enumerate(tail)],
                               "step int, left_id int, right_id int, height double, size int")
    return labels, mt


def ward_merge_table(df: DataFrame, id_col: str = "CustomerID", cols: list[str] | None = None, last: int = 30,
                     micro: int = 200) -> DataFrame:
    return hierarchical_ward(df, id_col, cols, 4, micro)[1].orderBy("step")
