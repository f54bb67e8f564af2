"""Model preparation: impute, encode, scale, split. Fitted state is a handful of parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acrely.functions.listing import amenities_count
from acrely.operators.features import numeric_columns
from acrely.operators.quantiles import table_quantiles
from acrely.operators.ranks import FEW_CATEGORIES, holdout, holdout_limit, ordinals, split_column

CATEGORICAL = ["city", "locality", "property_type"]
TARGET = "price"
NOT_FEATURES = ["property_id", "price", "price_per_sqft"]


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: q[0] for c, q in table_quantiles(df, columns, [0.5]).items()}


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Replace nulls by the stored value; the column keeps its place and becomes double."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in fill.items() if c in df.columns})


def encode(df: DataFrame, codes: DataFrame, columns: Sequence[str], few: int = FEW_CATEGORIES) -> DataFrame:
    """Replace categories by their codes; null reads as 'nan' and an unseen category as the first."""
    small = codes.limit(few + 1).count() <= few
    for c in [c for c in columns if c in df.columns]:
        table = codes.filter(F.col("column") == c).select(F.col("category").alias("_category"), "code")
        table = F.broadcast(table) if small else table
        names = df.columns
        joined = df.join(table, F.coalesce(F.col(c).cast("string"), F.lit("nan")) == F.col("_category"), "left")
        df = joined.select(*[
            F.coalesce("code", F.lit(0)).cast("double").alias(c) if x == c else F.col(x) for x in names])
    return df


def standard_params(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) per column in one pass; a constant column is divided by 1."""
    row = df.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return {c: (row[2 * i], row[2 * i + 1] or 1.0) for i, c in enumerate(columns)}


def standard_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


@dataclass
class ListingPreprocessor:
    """Drop ids, count amenities, impute medians, encode categories, scale; then assemble."""

    seed: int = 42
    test_fraction: float = 0.2
    fill: dict[str, float] = field(default_factory=dict)
    codes: DataFrame | None = None
    feature_columns: list[str] = field(default_factory=list)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    split_limit: int | None = None

    @staticmethod
    def _counted(df: DataFrame) -> DataFrame:
        if "amenities" not in df.columns:
            return df
        return df.withColumn("amenities_count", amenities_count()).drop("amenities")

    def fit(self, df: DataFrame) -> "ListingPreprocessor":
        """Learn from the whole table, except for the scaling, which sees training rows only."""
        df = self._counted(df)
        present = [c for c in CATEGORICAL if c in df.columns]
        numbers = [c for c in numeric_columns(df) if c not in (TARGET, split_column(seed=self.seed))]
        self.fill = {c: v for c, v in medians(df, numbers).items() if v is not None}
        self.codes = ordinals(df, present)
        text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        self.feature_columns = [
            c for c in df.columns
            if c not in NOT_FEATURES and (c in present or (c in numbers and c not in text))]
        self.split_limit = holdout_limit(df, fraction=self.test_fraction, seed=self.seed) if self.test_fraction else -1
        train = holdout(df, seed=self.seed, limit=self.split_limit).filter(~F.col("is_test"))
        self.scale = standard_params(self._numeric(train), self.feature_columns)
        return self

    def _numeric(self, df: DataFrame) -> DataFrame:
        df = impute(self._counted(df) if "amenities" in df.columns else df, self.fill)
        df = encode(df, self.codes, CATEGORICAL)
        absent = {c: F.lit(0.0) for c in self.feature_columns if c not in df.columns}
        return df.withColumns(absent) if absent else df

    def transform(self, df: DataFrame, keep: Sequence[str] = ("property_id", "price", "area_sqft", "is_test")) -> DataFrame:
        """`features` (vector, fitted order), `label` where a price exists, and the kept columns as given."""
        kept = {f"_keep_{c}": F.col(c) for c in keep if c in df.columns}
        ready = standard_scale(self._numeric(df.withColumns(kept)), self.scale)
        assembled = VectorAssembler(inputCols=self.feature_columns, outputCol="features").transform(ready)
        out = [F.col(k).alias(k.removeprefix("_keep_")) for k in kept]
        if TARGET in df.columns:
            out.append(F.col(f"_keep_{TARGET}" if TARGET in keep else TARGET).cast("double").alias("label"))
        return assembled.select(*out, "features")

    def fit_transform(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Train and test tables."""
        self.fit(df)
        ready = self.transform(self.split(df))
        return ready.filter(~F.col("is_test")), ready.filter(F.col("is_test"))

    # ---- stored as parameter tables -------------------------------------
    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (i, c, self.fill.get(c), *map(float, self.scale[c])) for i, c in enumerate(self.feature_columns)]
        spark.createDataFrame(rows, "position int, feature string, fill double, center double, spread double").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/features")
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        spark.createDataFrame(
            [(self.seed, self.test_fraction, self.split_limit)], "seed int, test_fraction double, split_limit long").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/split")

    def split(self, df: DataFrame) -> DataFrame:
        """`is_test` as fitted."""
        return holdout(df, fraction=self.test_fraction, seed=self.seed, limit=self.split_limit)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ListingPreprocessor":
        rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()  # one row per feature
        split = spark.read.parquet(f"{path}/split").first()
        return cls(
            split["seed"], split["test_fraction"], split_limit=split["split_limit"],
            fill={r["feature"]: r["fill"] for r in rows if r["fill"] is not None},
            codes=spark.read.parquet(f"{path}/codes"), feature_columns=[r["feature"] for r in rows],
            scale={r["feature"]: (r["center"], r["spread"]) for r in rows})
