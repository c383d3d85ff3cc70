"""Classification of objects into two populations by three models and their majority."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import shared_folder, written
from .separation import union_labelled, zscore


def scaled_together(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables scaled by the statistics of their union, and the features that vary."""
    both = zscore(union_labelled({"train": train, "test": test.withColumns({c: F.lit(None).cast(dict(train.dtypes)[c]) for c in train.columns if c not in test.columns}).select(*train.columns)}, "__set"), features)
    kept = [c for c in features if c in both.columns]
    return both.where("__set = 'train'").drop("__set"), both.where("__set = 'test'").drop("__set"), kept


def dealt(df: DataFrame, most: int = 200_000) -> DataFrame:
    """The rows, dealt evenly to all cores and at most about `most` to a task. A file of few bytes is read by one task, however
    much work its rows are to a model."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most)))


def class_sums(train: DataFrame, label: str, features: list[str]) -> DataFrame:
    """label, i, j, s: for each class the sums of products of features i <= j; feature number len(features) is 1."""
    d = len(features) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            y = np.array(b.column(0).to_pylist(), dtype=object)
            v = np.column_stack([*[b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d - 1)], np.ones(b.num_rows)])
            for c in set(y):
                own = v[y == c]
                sums[c] = sums.get(c, 0) + own.T @ own
        i, j = np.triu_indices(d)
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(i)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s[i, j])], ["label", "i", "j", "s"])

    rows = train.select(F.col(label).cast("string"), *[F.col(f).cast("double") for f in features])
    return rows.mapInArrow(run, "label string, i int, j int, s double").groupBy("label", "i", "j").agg(F.sum("s").alias("s"))


def lda(train: DataFrame, test: DataFrame, label: str, features: list[str], ridge: float = 1e-6, deal: bool = True) -> DataFrame:
    """`test` with LDA: linear discriminants from class means and the pooled covariance (features x features numbers per class
    reach the driver). deal: `test` is dealt to all cores first."""
    test = dealt(test) if deal else test
    sums: dict[str, np.ndarray] = {}
    d = len(features)
    for r in class_sums(train, label, features).collect():
        m = sums.setdefault(r["label"], np.zeros((d + 1, d + 1)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    names = sorted(sums)
    n = {c: sums[c][d, d] for c in names}
    means = {c: sums[c][d, :d] / n[c] for c in names}
    pooled = sum(sums[c][:d, :d] - n[c] * np.outer(means[c], means[c]) for c in names) / max(1.0, sum(n.values()) - len(names))
    inverse = np.linalg.pinv(pooled + ridge * np.eye(d))
    score: dict[str, Column] = {}
    for c in names:
        w = inverse @ means[c]
        bias = float(np.log(n[c] / sum(n.values())) - 0.5 * means[c] @ w)
        terms = F.zip_with(F.array(*[F.col(f).cast("double") for f in features]), F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b)
        score[c] = F.aggregate(terms, F.lit(bias), lambda s, t: s + t)
    own = {c: f"__s{i}" for i, c in enumerate(names)}  # columns, so that each score is computed once
    best = F.greatest(*own.values()) if len(names) > 1 else F.col(own[names[0]])
    return test.withColumns({own[c]: s for c, s in score.items()}).withColumn("LDA", F.coalesce(*[F.when(F.col(s) == best, F.lit(c)) for c, s in own.items()])).drop(*own.values())


def _numbered(train: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    names = sorted(str(r[0]) for r in train.select(label).distinct().collect())
    return train.withColumn("__y", F.array_position(F.array(*map(F.lit, names)), F.col(label).cast("string")).cast("double") - 1), names


def _named(prediction: str, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col(prediction).cast("int") + 1)


def random_forest(train: DataFrame, test: DataFrame, label: str, features: list[str], trees: int = 200, tried: int = 5, seed: int = 1, leaves: int = 5000, deal: bool = True) -> DataFrame:
    """`test` with RF: a forest of `trees`, each split tries `tried` features; trees grow to the end, or to Spark's limit of
    30 levels. The forest is gathered on the driver, so beyond `leaves` rows a leaf holds a share of them: a tree has at most
    `leaves` leaves, however many rows there are. The node that each row has reached in each tree stays with the row: else every
    level sends all the trees so far to every task, and walks down them from the root. deal: `test` is dealt to all cores first,
    as `train` always is."""
    test = dealt(test) if deal else test
    shared_folder(train.sparkSession)  # where the nodes reached are checkpointed
    numbered, names = _numbered(train, label)
    least = max(1, -(-numbered.count() // leaves))
    assemble = VectorAssembler(inputCols=features, outputCol="__v")
    model = RandomForestClassifier(labelCol="__y", featuresCol="__v", predictionCol="__p", numTrees=trees, maxDepth=30, minInstancesPerNode=least, featureSubsetStrategy=str(min(tried, len(features))), seed=seed, cacheNodeIds=True).fit(assemble.transform(dealt(numbered)))
    return model.transform(assemble.transform(test)).withColumn("RF", _named("__p", names)).drop("__v", "__p", "rawPrediction", "probability")


def landmarks(v: np.ndarray, gamma: float, most: int, least: float = 1e-8) -> np.ndarray:
    """Numbers of at most `most` rows that span the others best under a radial kernel: each the one that those before it leave
    most of (pivoted Cholesky), until none is left more than `least` of."""
    left, out, span = np.ones(len(v)), [], np.zeros((len(v), 0))
    while len(out) < most and len(out) < len(v):
        p = int(left.argmax())
        if left[p] <= least:
            break
        column = np.exp(-gamma * ((v - v[p]) ** 2).sum(axis=1)) - span @ span[p]
        span = np.column_stack([span, column / np.sqrt(left[p])])
        left = np.maximum(left - span[:, -1] ** 2, 0)
        out.append(p)
    return np.array(out, dtype=int)


def rbf_svm(train: DataFrame, test: DataFrame, label: str, features: list[str], components: int = 512, cost: float = 1.0, seed: int = 1, deal: bool = True) -> DataFrame:
    """`test` with SVM: a support vector machine with a radial kernel of width 1 / features, on the span of at most `components`
    landmarks (Williams and Seeger 2001), then a linear machine there. Two classes.

    The landmarks come from a sample of at most 4 * components different training rows, those with the lowest hashes, and leave as
    little as they can of each; all rows are used to fit. With at most `components` different rows the kernel is exact. A test
    row with a null or NaN feature has no class. deal: `test` is dealt to all cores first, as `train` always is.
    """
    test = dealt(test) if deal else test
    numbered, names = _numbered(train, label)
    if len(names) != 2:
        raise ValueError(f"two classes are needed, not {names}")
    gamma = 1.0 / len(features)
    fine = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features]
    whole = reduce(Column.__and__, fine)
    doubles = [F.col(f).cast("double").alias(f) for f in features]
    picked = numbered.where(whole).select(*doubles).distinct().orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(4 * components).toArrow()
    v = np.column_stack([picked.column(f).to_numpy() for f in features])
    own = v[landmarks(v, gamma, components)]
    values, vectors = np.linalg.eigh(np.exp(-gamma * np.maximum((own**2).sum(1)[:, None] + (own**2).sum(1)[None] - 2 * own @ own.T, 0)))
    keep = values > 1e-10 * values.max()
    onto = vectors[:, keep] / np.sqrt(values[keep])

    def onto_span(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
        x = np.nan_to_num(np.column_stack([b.column(names.index(f)).to_numpy(zero_copy_only=False).astype(float) for f in features]))
        far = np.maximum((x**2).sum(1)[:, None] + (own**2).sum(1)[None] - 2 * x @ own.T, 0)
        return np.exp(-gamma * far) @ onto

    def lifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = onto_span(b, ["__y", *features])
            ends = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], ["__y", "__z"])

    numbered = numbered.where(whole)
    rows = numbered.count()
    fitted = dealt(numbered.select("__y", *features)).mapInArrow(lifted, "__y double, __z array<double>").select("__y", array_to_vector("__z").alias("__v"))
    # standardised inside, which conditions the steps; the penalty is on the weights as they are
    model = LinearSVC(labelCol="__y", featuresCol="__v", predictionCol="__p", regParam=1.0 / (cost * max(1, rows)), maxIter=120, tol=1e-7, standardization=False).fit(fitted)
    weights, bias = model.coefficients.toArray(), model.intercept
    test = test.withColumn("__fine", whole)
    rest = test.columns

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # what the model says, without a row's 512 numbers leaving the task
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(onto_span(b, rest) @ weights + bias > 0)], [*rest, "__p"])

    out = test.mapInArrow(judged, ", ".join(f"`{n}` {t}" for n, t in test.dtypes) + ", __p boolean")
    return out.withColumn("SVM", F.when(F.col("__fine"), _named("__p", names))).drop("__p", "__fine")


def majority(df: DataFrame, one: str, other: str, models: tuple[str, ...] = ("LDA", "RF", "SVM")) -> DataFrame:
    """Adds Ensemble: `one` where at least two of the three models say so, else `other`."""
    votes = sum((F.coalesce(F.col(m) == one, F.lit(False)).cast("int") for m in models), F.lit(0))
    return df.withColumn("Ensemble", F.when(votes >= 2, F.lit(one)).otherwise(F.lit(other)))


def classify(train: DataFrame, test: DataFrame, label: str, features: list[str], one: str, other: str, trees: int = 200) -> DataFrame:
    """`test`'s columns that aren't features, with LDA, RF, SVM and Ensemble."""
    a, b, kept = scaled_together(train, test, features)
    a, b = written(a), dealt(b.drop(label))
    out = rbf_svm(a, random_forest(a, lda(a, b, label, kept, deal=False), label, kept, trees, deal=False), label, kept, deal=False)
    return majority(out, one, other).drop(*kept)
