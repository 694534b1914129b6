"""Principal components, neighbours, feature choice and classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Samples in a block of the matrix of products, and features that are multiplied at a time.
BLOCK, TOGETHER = 1024, 512


def products(scaled: DataFrame) -> DataFrame:
    """sample_id, other_id, g: scalar products of samples over the features that both have. By blocks of samples: a task
    gathers the values of some features for two blocks as a dense matrix and multiplies it, so no pair of cells is ever
    a row; cells are sent once a block of samples."""
    from .rangejoin import sized

    spark = scaled.sparkSession
    kind = dict(scaled.dtypes)["sample_id"]
    ids = sorted(r.sample_id for r in scaled.select("sample_id").distinct().collect())  # one row a sample
    if not ids:
        return spark.createDataFrame([], f"sample_id {kind}, other_id {kind}, g double")
    places = sized(spark.createDataFrame([(s, i) for i, s in enumerate(ids)], f"sample_id {kind}, place int"))
    blocks = -(-len(ids) // BLOCK)
    own = F.floor(F.col("place") / BLOCK).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(own, k).alias("a"), F.greatest(own, k).alias("b")))
    cells = scaled.join(places, "sample_id").select("feature_id", "place", "z", F.explode(pairs).alias("pair"))
    task = F.xxhash64("pair", F.pmod(F.xxhash64("feature_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    cells = cells.withColumn("task", task).repartition("task").sortWithinPartitions("task", "feature_id")
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("g", pa.float64())])

    def run(batches):
        def rows(pair, total):
            a, b = pair
            # a sample whose values are all 0 has its own product too
            i, j = np.nonzero((total != 0) | (np.eye(BLOCK, dtype=bool) if a == b else False))
            g = total[i, j]
            sides = [(i + a * BLOCK, j + b * BLOCK)] + ([(j + b * BLOCK, i + a * BLOCK)] if a != b else [])
            for x, y in sides:
                for at in range(0, len(g), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x[part], pa.int32()), pa.array(y[part], pa.int32()), pa.array(g[part])], schema=schema)

        task, pair, total, held, feature, n = None, None, None, None, object(), -1

        def flush():
            if n >= 0:
                left, right = held[0][: n + 1], held[1][: n + 1]
                total[...] += left.T @ right
                held[:] = 0

        for batch in batches:
            take = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            for t, f, place, z, p in zip(take("task"), take("feature_id"), take("place"), take("z"), take("pair"), strict=True):
                if t != task:
                    if pair is not None:
                        flush()
                        yield from rows(pair, total)
                    task, pair, total, held, feature, n = t, (p["a"], p["b"]), np.zeros((BLOCK, BLOCK)), np.zeros((2, TOGETHER, BLOCK)), object(), -1
                if f != feature:
                    if n + 1 == TOGETHER:
                        flush()
                        n = -1
                    feature, n = f, n + 1
                for side in (0, 1):
                    if place // BLOCK == pair[side]:
                        held[side, n, place % BLOCK] = z
        if pair is not None:
            flush()
            yield from rows(pair, total)

    parts = cells.select("task", "feature_id", "place", "z", "pair").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    named = parts.join(places.select(F.col("place").alias("i"), "sample_id"), "i").join(places.select(F.col("place").alias("j"), F.col("sample_id").alias("other_id")), "j")
    return named.select("sample_id", "other_id", "g")


def sample_components(scaled: DataFrame, k: int = 2) -> DataFrame:
    """Scores of samples on the first ``k`` principal components of the scaled matrix (feature_id, sample_id, z), in
    which missing cells are 0 (``impute_scale`` with ``relative``). The Gram matrix of samples is summed up in the
    cluster; the driver centres and decomposes it (samples squared numbers). The sign of a component makes its largest
    score positive."""
    gram = products(scaled)
    rows = gram.collect()
    ids = sorted({r.sample_id for r in rows})
    at = {s: i for i, s in enumerate(ids)}
    g = np.zeros((len(ids), len(ids)))
    for r in rows:
        g[at[r.sample_id], at[r.other_id]] = r.g
    centre = np.eye(len(ids)) - 1 / max(1, len(ids))
    values, vectors = np.linalg.eigh(centre @ g @ centre)
    best = np.argsort(-values)[:k]
    scores = vectors[:, best] * np.sqrt(np.maximum(values[best], 0))
    scores *= np.where(scores[np.argmax(np.abs(scores), axis=0), range(len(best))] < 0, -1, 1)
    share = np.maximum(values[best], 0) / max(values.clip(0).sum(), 1e-300)
    kind = dict(scaled.dtypes)["sample_id"]
    made = [(ids[i], *map(float, scores[i])) for i in range(len(ids))]
    out = scaled.sparkSession.createDataFrame(made, f"sample_id {kind}, " + ", ".join(f"pc{j + 1} double" for j in range(len(best))))
    return out.withColumns({f"share{j + 1}": F.lit(float(share[j])) for j in range(len(best))})


def neighbours(scaled: DataFrame, k: int = 15) -> DataFrame:
    """The exact k nearest samples of each, by Euclidean distance over features; what an embedding would start from.
    Missing cells are 0, as in :func:`sample_components`; a sample without any row is not known and left out. The few samples are one row while pairs are listed."""
    from pyspark.sql import Window

    gram = products(scaled)
    own = gram.where("sample_id = other_id").select("sample_id", F.col("g").alias("own"))
    every = own.agg(F.collect_list(F.struct(F.col("sample_id").alias("other_id"), F.col("own").alias("other_own"))).alias("every"))
    pairs = own.join(F.broadcast(every)).select("sample_id", "own", F.inline("every")).where("sample_id <> other_id").join(gram, ["sample_id", "other_id"], "left")
    squared = F.col("own") + F.col("other_own") - 2 * F.coalesce("g", F.lit(0.0))
    far = pairs.select("sample_id", "other_id", F.sqrt(F.greatest(F.lit(0.0), squared)).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.round("distance", 9), "other_id"))
    return far.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def selector(n_features: int, k: int | None = None) -> UnivariateFeatureSelector:
    """ANOVA F; by default a tenth of the features, five at least."""
    return UnivariateFeatureSelector(featuresCol="scaled", outputCol="chosen", labelCol="label", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(min(n_features, k or max(5, -(-n_features // 10))))


def classifier(n_features: int, k: int | None = None, trees: int = 50, seed: int = 42) -> Pipeline:
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[scale, selector(n_features, k), RandomForestClassifier(featuresCol="chosen", labelCol="label", numTrees=trees, seed=seed)])


def evaluate(model: PipelineModel, rows: DataFrame) -> dict[str, float]:
    scored = model.transform(rows)
    out = {"accuracy": MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored)}
    if rows.select("label").distinct().limit(3).count() == 2:
        out["auc"] = BinaryClassificationEvaluator().evaluate(scored)
    return out


def cross_validate(rows: DataFrame, n_features: int, folds: int = 5, key: str = "id", **options) -> DataFrame:
    """Accuracy of each fold; a row's fold is a hash of its key."""
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds))).persist()
    out = []
    for fold in range(folds):
        model = classifier(n_features, **options).fit(rows.where(F.col("_fold") != fold))
        held = rows.where(F.col("_fold") == fold)
        out.append((fold, held.count(), float(evaluate(model, held)["accuracy"])))
    rows.unpersist()
    return rows.sparkSession.createDataFrame(out, "fold int, n long, accuracy double")


def roc_curve(scored: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """place, fpr and tpr of each cut of the second class's probability, from (0, 0) on; rows of equal scores are one
    step. One row a distinct score, so the window is that of a hold-out of samples."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import Window

    own = scored.select(F.round(F.get(vector_to_array(probability), F.lit(1)), 12).alias("s"), F.col(label).alias("y"))
    steps = own.groupBy("s").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") > 0, 0).otherwise(1)).alias("n"))
    upto, whole = Window.orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    rates = steps.select(F.row_number().over(Window.orderBy(F.col("s").desc())).alias("place"), F.try_divide(F.sum("n").over(upto).cast("double"), F.sum("n").over(whole)).alias("fpr"), F.try_divide(F.sum("p").over(upto).cast("double"), F.sum("p").over(whole)).alias("tpr"))
    return scored.sparkSession.createDataFrame([(0, 0.0, 0.0)], "place int, fpr double, tpr double").unionByName(rates)


def area_under(roc: DataFrame) -> DataFrame:
    """auc: the area under a curve of :func:`roc_curve`, by trapezoids."""
    from pyspark.sql import Window

    order = Window.orderBy("place")
    parts = roc.select((F.col("fpr") - F.lag("fpr").over(order)).alias("w"), ((F.col("tpr") + F.lag("tpr").over(order)) / 2).alias("h"))
    return parts.agg(F.sum(F.col("w") * F.col("h")).alias("auc"))


def match_to_model(features: DataFrame, known: DataFrame, mz_tol: float = 0.01, rt_tol: float = 0.3) -> DataFrame:
    """Known features (known_id, known_mz, known_rt) with the nearest feature within both tolerances; null where there is
    none, to be imputed by name rather than by place."""
    from .rangejoin import range_join

    near = range_join(features, known, "mz", "known_mz", mz_tol).where(F.abs(F.col("rt") - F.col("known_rt")) < rt_tol)
    best = near.groupBy("known_id").agg(F.min(F.struct(F.abs(F.col("mz") - F.col("known_mz")).alias("d"), "feature_id")).alias("b"))
    return known.join(best.select("known_id", F.col("b.feature_id").alias("feature_id")), "known_id", "left")
