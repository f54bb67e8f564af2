"""Price models: training, comparison, batch prediction, evaluation, registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrely.functions.labels import model_slug
from acrely.functions.money import price_band
from acrely.functions.numeric import rnd
from acrely.operators.network import NetworkEstimator, PriceNetwork
from acrely.operators.profile import histogram
from acrely.operators.trees import TreeEnsemble, boosted, forest

METRICS = ["r2", "rmse", "mae", "mape"]
EPS = 2.220446049250313e-16   # smallest denominator of the library form of MAPE
LABEL_UNIT = 1e6              # robust regression needs a label of moderate size


# ---- candidates ---------------------------------------------------------
def linear() -> LinearRegression:
    return LinearRegression(regParam=0.0, solver="normal")


def ridge(train: DataFrame, alpha: float = 10.0) -> LinearRegression:
    """Penalty alpha on the squared weights of unscaled features, intercept free.

    The solver divides the squared error by the row count and scales the penalty by the label's
    deviation, hence the conversion; features are standardised before they get here.
    """
    n, spread = train.agg(F.count("*"), F.stddev_pop("label")).first()
    return LinearRegression(
        regParam=alpha * (spread or 1.0) / n, elasticNetParam=0.0, standardization=False, solver="normal")


def robust() -> LinearRegression:
    return LinearRegression(loss="huber", maxIter=200, labelCol="label_m", predictionCol="prediction_m")


Candidate = Callable[[DataFrame], object]
# The names of the models.
CANDIDATES: dict[str, Candidate] = {
    "Linear Regression": lambda train: linear(),
    "Ridge Regression": lambda train: ridge(train),
    "Random Forest": lambda train: forest(),
    "Gradient Boosting": lambda train: boosted(),
    "Neural Network": lambda train: NetworkEstimator(),
}


def fit_robust(train: DataFrame) -> LinearRegressionModel:
    return robust().fit(train.withColumn("label_m", F.col("label") / F.lit(LABEL_UNIT)))


def predict_robust(model: LinearRegressionModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("prediction", F.col("prediction_m") * F.lit(LABEL_UNIT)).drop("prediction_m")


# ---- metrics ------------------------------------------------------------
def metric_columns(label: Column, prediction: Column) -> dict[str, Column]:
    """R², RMSE, MAE and MAPE in percent, unrounded, as aggregates. MAPE divides by label + 1e-9."""
    error = prediction - label
    spread = F.var_pop(label) * F.count(label)
    return {
        "r2": F.lit(1.0) - F.try_divide(F.sum(error * error), spread),
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "mape": F.avg(F.abs(F.try_divide(error, label + F.lit(1e-9)))) * F.lit(100.0),
    }


def library_mape(label: Column, prediction: Column) -> Column:
    """MAPE with the denominator max(|label|, eps)."""
    return F.avg(F.abs(prediction - label) / F.greatest(F.abs(label), F.lit(EPS))) * F.lit(100.0)


def _rounded(metrics: Mapping[str, Column]) -> list[Column]:
    return [rnd(c, 4 if name == "r2" else 2).alias(name) for name, c in metrics.items()]


def regression_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row of metrics, or one per group."""
    return df.groupBy(*by).agg(*_rounded(metric_columns(F.col(label), F.col(prediction))))


def evaluation_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Metrics of predictions clamped at zero, with the library form of MAPE."""
    clamped = F.greatest(F.col(prediction), F.lit(0.0))
    metrics = metric_columns(F.col(label), clamped) | {"mape": library_mape(F.col(label), clamped)}
    return df.groupBy(*by).agg(*_rounded(metrics))


def residual_histogram(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return histogram(df, (F.col(prediction) - F.col(label)) / F.lit(1e6))


def actual_vs_predicted(df: DataFrame, key: str = "property_id") -> DataFrame:
    return df.select(
        key, rnd(F.col("label") / F.lit(1e6), 6).alias("actual_m"), rnd(F.col("prediction") / F.lit(1e6), 6).alias("predicted_m"))


def long_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot(["model"], METRICS, "metric", "value")


def best_model(metrics: DataFrame) -> DataFrame:
    """The row with the highest R²; among equals the one registered first (`position`)."""
    return metrics.orderBy(F.desc("r2"), F.asc("position")).limit(1)


# ---- training -----------------------------------------------------------
@dataclass
class ModelTrainer:
    """Fits every candidate on one table and compares them on another.

    Candidates are fitted side by side, `at_once` at a time: each has stretches that do not fill a cluster.
    `persisted` keeps both tables in memory meanwhile; tables that are read from files as they are need it not.
    """

    candidates: Mapping[str, Candidate] = field(default_factory=lambda: dict(CANDIDATES))
    models: dict[str, object] = field(default_factory=dict)
    best_name: str | None = None
    at_once: int = 5
    persisted: bool = True

    def train(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """(position, model, r2, rmse, mae, mape), best first."""
        spark = train.sparkSession
        train, test = (part.select("features", "label") for part in (train, test))
        if self.persisted:
            train, test = train.persist(), test.persist()

        def fit_and_score(position: int, name: str, candidate: Candidate) -> tuple:
            model = candidate(train).fit(train)
            return model, (position, name, *regression_metrics(model.transform(test)).first())

        try:
            with ThreadPoolExecutor(self.at_once) as pool:
                fitted = list(pool.map(fit_and_score, range(len(self.candidates)), self.candidates, self.candidates.values()))
            self.models = {row[1]: model for model, row in fitted}
            rows = [row for _, row in fitted]
        finally:
            if self.persisted:
                train.unpersist()
                test.unpersist()
        table = spark.createDataFrame(rows, "position int, model string, r2 double, rmse double, mae double, mape double")
        self.best_name = best_model(table).first()["model"]
        return table.orderBy(F.desc("r2"), "position")

    def predict(self, df: DataFrame, model: str | None = None) -> DataFrame:
        """Predictions with the named model, or the best one when there is no such model."""
        if self.best_name is None:
            raise RuntimeError("train first")
        return self.models.get(model, self.models[self.best_name]).transform(df)

    def registry(self, spark: SparkSession) -> DataFrame:
        """Every trained model and whether it is the active one."""
        rows = [(name, name == self.best_name, "loaded") for name in self.models]
        return spark.createDataFrame(rows, "model string, active boolean, status string")

    def save(self, spark: SparkSession, path: str) -> None:
        for name, model in self.models.items():
            save_model(spark, model, f"{path}/{slug(name)}")
        kinds = spark.createDataFrame(
            [(name, slug(name), type(model).__name__) for name, model in self.models.items()],
            "model string, folder string, kind string")
        kinds.join(self.registry(spark), "model").coalesce(1).write.mode("overwrite").parquet(f"{path}/registry")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ModelTrainer":
        inst = cls()
        for row in spark.read.parquet(f"{path}/registry").collect():  # one row per model
            inst.models[row["model"]] = load_model(spark, row["kind"], f"{path}/{row['folder']}")
            if row["active"]:
                inst.best_name = row["model"]
        return inst


def save_model(spark: SparkSession, model, path: str) -> None:
    if isinstance(model, LinearRegressionModel):
        model.write().overwrite().save(path)
    else:
        model.save(spark, path)


def load_model(spark: SparkSession, kind: str, path: str):
    own = {k.__name__: k for k in (TreeEnsemble, PriceNetwork)}
    return own[kind].load(spark, path) if kind in own else LinearRegressionModel.load(path)


def slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def active_model(registry: DataFrame) -> DataFrame:
    return registry.filter("active").select(
        F.col("model").alias("best_model"), "status", model_slug("model").alias("folder"))


def predicted_prices(scored: DataFrame, model_name: str) -> DataFrame:
    """Clamped price, ±10 % band and rate per square foot of every scored listing."""
    return scored.select("property_id", F.lit(model_name).alias("model_used"), *[
        c.alias(name) for name, c in price_band("prediction", "area_sqft").items()])


def evaluate_all(trainer: ModelTrainer, test: DataFrame) -> DataFrame:
    """Clamped metrics of every stored model on a holdout table, best first."""
    parts = [
        evaluation_metrics(model.transform(test)).select(F.lit(name).alias("model"), *METRICS)
        for name, model in trainer.models.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(F.desc("r2"))


def feature_importance(model, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """Tree importances, or the size of the weights; empty for other models."""
    if hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        weights = [abs(w) for w in model.coefficients.toArray()]
    else:
        weights = []
    rows = [(name, float(w)) for name, w in zip(names, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def training_history(model: LinearRegressionModel, spark: SparkSession) -> DataFrame:
    """(epoch, metric, value) of an iteratively fitted linear model."""
    rows = [(i, "loss", float(v)) for i, v in enumerate(model.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "epoch int, metric string, value double")
