"""A model of labelled feature rows: scaling, components and a forest, as one bundle that is stored and read again."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(rows: DataFrame, features: list[str], label: str, path: str | None = None, components: int | None = None, trees: int = 100, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Fits on rows without nulls in features or label; ``path`` (shared storage) keeps the bundle."""
    stages = [
        StringIndexer(inputCol=label, outputCol="label index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=features, outputCol="all features"),
        StandardScaler(inputCol="all features", outputCol="scaled features", withMean=True),
    ]
    used = "scaled features"
    if components:
        stages.append(PCA(k=components, inputCol=used, outputCol="component features"))
        used = "component features"
    stages.append(RandomForestClassifier(featuresCol=used, labelCol="label index", numTrees=trees, maxDepth=depth, seed=seed))
    model = Pipeline(stages=stages).fit(rows.dropna(subset=[*features, label]).withColumn(label, F.col(label).cast("string")))
    if path is not None:
        model.write().overwrite().save(path)
    return model


def predict(rows: DataFrame, features: list[str], bundle: PipelineModel | str, keys: list[str]) -> DataFrame:
    """(keys, predicted, probability) of rows without nulls in features; ``bundle`` is a model or where it is kept."""
    model = PipelineModel.load(bundle) if isinstance(bundle, str) else bundle
    names = F.array(*map(F.lit, model.stages[0].labels))
    label = model.stages[0].getInputCol()
    out = PipelineModel(model.stages[1:]).transform(rows.drop(label).dropna(subset=features))
    return out.select(*keys, F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"), F.array_max(vector_to_array("probability")).alias("probability"))
