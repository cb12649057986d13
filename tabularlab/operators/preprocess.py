"""FE5: a tabular preprocessor that is fitted on training rows, saved, loaded and applied to other rows.

``TabularPreprocessor(numeric, categories).fit(train)`` learns, per numeric column, median, mean
and standard deviation, and per category column a table of codes 1, 2, ... in the order of the
values.  The model fills missing numbers with the median (and says so in ``<c>_na``), standardises
them, and adds ``<c>_code``: 0 for nulls and for values that training did not show.  Code tables are
numbered by Spark and joined by value, so no list of categories is held by the driver, and AQE broadcasts
those whose measured size is small.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.util import MLReader, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularlab.operators.features import apply_standardizer, fit_label_encoder, fit_standardizer
from tabularlab.session import materialize


class TabularPreprocessor(Estimator):
    def __init__(self, numeric: Sequence[str] = (), categories: Sequence[str] = ()):
        super().__init__()
        if not numeric and not categories:
            raise ValueError("name at least one column")
        self.numeric, self.categories = list(numeric), list(categories)

    def _fit(self, dataset: DataFrame) -> TabularModel:
        numbers = materialize(fit_standardizer(dataset, self.numeric), "numeric") if self.numeric else None      # one row
        codes = {c: materialize(fit_label_encoder(dataset, c).withColumn("code", F.col("code") + 1), "codes")
                 for c in self.categories}
        return TabularModel(self.numeric, self.categories, numbers, codes)


class TabularModel(Model):
    def __init__(self, numeric: list[str], categories: list[str], numbers: DataFrame | None, codes: dict[str, DataFrame]):
        super().__init__()
        self.numeric, self.categories, self.numbers, self.codes = numeric, categories, numbers, codes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = apply_standardizer(dataset, self.numbers, self.numeric) if self.numeric else dataset
        for c in self.categories:
            table = self.codes[c].select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            out = out.join(table, F.col(f"`{c}`") == F.col("_value"), "left") \
                .withColumn(f"{c}_code", F.coalesce("_code", F.lit(0))).drop("_value", "_code")
        return out

    def write(self) -> TabularModelWriter:
        return TabularModelWriter(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @staticmethod
    def read(spark: SparkSession) -> TabularModelReader:
        return TabularModelReader(spark)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TabularModel:
        return TabularModelReader(spark).load(path)


class TabularModelWriter(MLWriter):
    """A folder of Parquet tables: the numeric parameters, one code table per category, and the column names."""

    def __init__(self, model: TabularModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        if m.numbers is not None:
            m.numbers.write.parquet(f"{path}/numbers")
        for i, c in enumerate(m.categories):
            m.codes[c].write.parquet(f"{path}/codes/{i}")
        names = json.dumps({"numeric": m.numeric, "categories": m.categories})
        self.sparkSession.createDataFrame([(names,)], "names string").coalesce(1).write.text(f"{path}/columns")      # written last


class TabularModelReader(MLReader):
    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark = spark

    def load(self, path: str) -> TabularModel:
        names = json.loads(self.spark.read.text(f"{path}/columns").first()[0])
        numbers = self.spark.read.parquet(f"{path}/numbers") if names["numeric"] else None
        codes = {c: self.spark.read.parquet(f"{path}/codes/{i}") for i, c in enumerate(names["categories"])}
        return TabularModel(names["numeric"], names["categories"], numbers, codes)
