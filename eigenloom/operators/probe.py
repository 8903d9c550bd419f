"""Linear probes: fit on train rows, score test rows, by spark.ml."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.functions import vectors as V
from eigenloom.operators.sgd import KINDS, fit_sgd, probe_scores

#: Probes by name. Each is fitted as ``fit(train, vector, label)``, which gives a function
#: that adds ``predicted`` to a table, and the class names.
PROBES = {
    "logistic": lambda train, vector, label: _fit_regression(train, vector, label, "logistic"),
    "lr_ovr": lambda train, vector, label: _fit_regression(train, vector, label, "lr_ovr"),
    "sgd": lambda train, vector, label: fit_sgd(train, vector, label, "sgd"),
    "sgd_safe": lambda train, vector, label: fit_sgd(train, vector, label, "sgd_safe"),
}


def register_probe(name: str, fit) -> None:
    """Make a classifier known by a name of its own."""
    if name in PROBES:
        raise ValueError(f"probe {name!r} is known already")
    PROBES[name] = fit


@dataclass(frozen=True)
class Standard:
    """Training means and population deviations (1 where nothing varies)."""

    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, vector: str) -> Standard:
        row = df.agg(V.mean_of(vector).alias("m"), V.variance_of(vector).alias("v"), F.count(vector).alias("n")).first()
        std = np.sqrt(np.array(row.v) * max(row.n - 1, 0) / max(row.n, 1))
        return cls(np.array(row.m), np.where(std > 0, std, 1.0))

    def apply(self, df: DataFrame, vector: str, output: str) -> DataFrame:
        lit = lambda a: F.array(*[F.lit(float(v)) for v in a])
        return df.withColumn(output, array_to_vector(F.zip_with(V.subtract(vector, lit(self.mean)), lit(self.std), lambda x, s: x / s)))


#: Classes of a label; a label with more is a key by mistake.
MOST_CLASSES = 10_000


def class_table(df: DataFrame, label: str) -> tuple[list[str], DataFrame]:
    """Class names in order, and a small table (label, class_no, weight) with balanced weights."""
    counts = {r[0]: r[1] for r in df.groupBy(F.col(label).cast("string").alias("c")).count().limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    names, total = sorted(counts), sum(counts.values())
    rows = [(c, float(k), total / (len(names) * counts[c])) for k, c in enumerate(names)]
    return names, df.sparkSession.createDataFrame(rows, "class string, class_no double, class_weight double")


def fit_probe(train: DataFrame, vector: str, label: str, probe="logistic"):
    """A function from a table to itself with ``predicted`` (class name), and the class names.

    ``logistic``: L2 with unit strength over balanced rows, intercept free. ``lr_ovr``:
    one against the rest with weak regularisation. ``sgd`` and ``sgd_safe``: averaged
    stochastic gradients (``operators/sgd.py``). A function in place of a name is a
    probe of the caller's own, fitted as those of ``PROBES``.
    """
    if callable(probe):
        return probe(train, vector, label)
    if probe not in PROBES:
        raise ValueError(f"probe {probe!r}; one of {sorted(PROBES)}")
    return PROBES[probe](train, vector, label)


def _fit_regression(train: DataFrame, vector: str, label: str, probe: str, max_iter: int = 100):
    names, classes = class_table(train, label)
    if len(names) < 2:
        raise ValueError("two classes are needed")
    scaler = Standard.fit(train, vector)
    rows = scaler.apply(train, vector, "_features").withColumn("class", F.col(label).cast("string")).join(F.broadcast(classes), "class")
    rows = rows.select("_features", "class_no", "class_weight").cache()
    base = LogisticRegression(featuresCol="_features", labelCol="class_no", weightCol="class_weight", predictionCol="_class", maxIter=max_iter, standardization=False, elasticNetParam=0.0)
    if probe == "logistic":
        model = base.setRegParam(1.0 / rows.count()).fit(rows)
    else:
        model = OneVsRest(classifier=base.setRegParam(1e-4), featuresCol="_features", labelCol="class_no", weightCol="class_weight", predictionCol="_class").fit(rows)
    rows.unpersist()
    named = F.array(*[F.lit(n) for n in names])

    def predict(df: DataFrame) -> DataFrame:
        scored = model.transform(scaler.apply(df, vector, "_features"))
        return scored.withColumn("predicted", F.get(named, F.col("_class").cast("int"))).select(*df.columns, "predicted")

    return predict, names


def balanced_accuracy(predictions: DataFrame, label: str, predicted: str = "predicted", keys: list[str] = ()) -> DataFrame:
    """(keys, balanced_accuracy, accuracy): mean of recalls over classes that occur, and share of hits."""
    hit = (F.col(label).cast("string") == F.col(predicted)).cast("double")
    by_class = predictions.groupBy(*keys, label).agg(F.avg(hit).alias("recall"), F.sum(hit).alias("hits"), F.count("*").alias("n"))
    return by_class.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"), (F.sum("hits") / F.sum("n")).alias("accuracy"))


def evaluate_probe(train: DataFrame, test: DataFrame, vector: str, label: str, probe: str = "logistic") -> dict:
    """Balanced accuracy, accuracy and chance on test rows; a test class that training lacks is an error."""
    predict, names = fit_probe(train, vector, label, probe)
    unknown = test.filter(~F.col(label).cast("string").isin(names)).limit(1).count()
    if unknown:
        raise ValueError("test rows have a class that training lacks")
    row = balanced_accuracy(predict(test), label).first()
    return {"balanced_accuracy": row.balanced_accuracy, "accuracy": row.accuracy, "chance": 1 / len(names)}


def probe_cv(df: DataFrame, vector: str, label: str, probe="logistic") -> dict:
    """Mean and population deviation of the balanced accuracy over the folds of a table with ``fold``."""
    folds = sorted(r[0] for r in df.select("fold").distinct().collect())
    if probe in KINDS:  # all folds in the same passes
        names, _ = class_table(df.filter(F.col(label).isNotNull()), label)
        scores = list(probe_scores(df.withColumn("split", F.lit(None).cast("string")), names, label, vector, [], folds, kind=probe).values())
    else:
        scores = _scores_by_fold(df, folds, vector, label, probe)
    values = np.array([s["balanced_accuracy"] for s in scores])
    return {"mean": float(values.mean()), "std": float(values.std()), "chance": scores[0]["chance"], "n_folds": len(folds)}


def _scores_by_fold(df: DataFrame, folds: list[int], vector: str, label: str, probe) -> list[dict]:
    return [evaluate_probe(df.filter(F.col("fold") != f), df.filter(F.col("fold") == f), vector, label, probe) for f in folds]


def confusion(predictions: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    """(true, predicted, n) of all pairs that occur."""
    return predictions.groupBy(F.col(label).cast("string").alias("true"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_recalls(predictions: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    """(class, n, recall, n_predicted) of every class that is true or predicted somewhere."""
    both = predictions.select(F.explode(F.array(F.struct(F.col(label).cast("string").alias("class"), F.lit(1).alias("t"), (F.col(label).cast("string") == F.col(predicted)).cast("int").alias("h"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(0).alias("h"), F.lit(1).alias("p")))).alias("e"))
    sums = both.select("e.*").groupBy("class").agg(F.sum("t").alias("n"), F.sum("h").alias("hits"), F.sum("p").alias("n_predicted"))
    return sums.select("class", "n", (F.col("hits") / F.greatest("n", F.lit(1))).alias("recall"), "n_predicted")
