"""Versioned models: ``path/name/v1, v2, …`` plus an append-only table of versions and
promotions. The production version is the one promoted last."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSIONS = (
    "name string, version int, created_at string, metrics map<string,double>, "
    "params map<string,string>, data_fingerprint string, path string"
)
PROMOTIONS = "name string, version int, promoted_at string, step int"


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    log = _log(spark, f"{root}/_versions", VERSIONS).filter(F.col("name") == name)
    return [r["version"] for r in log.select("version").distinct().orderBy("version").collect()]


def promote(spark: SparkSession, root: str, name: str, version: int) -> None:
    step = _log(spark, f"{root}/_promotions", PROMOTIONS).count()
    row = [(name, version, datetime.now(UTC).isoformat(), step)]
    spark.createDataFrame(row, PROMOTIONS).coalesce(1).write.mode("append").json(
        f"{root}/_promotions"
    )


def register(
    model: PipelineModel, spark: SparkSession, root: str, name: str, metrics: dict[str, float],
    params: dict[str, str], fingerprint: str, promoted: bool = True,
) -> int:
    version = max(versions(spark, root, name), default=0) + 1
    path = f"{root}/{name}/v{version}"
    model.write().save(path)
    row = [(name, version, datetime.now(UTC).isoformat(), metrics, params, fingerprint, path)]
    spark.createDataFrame(row, VERSIONS).coalesce(1).write.mode("append").json(f"{root}/_versions")
    if promoted:
        promote(spark, root, name, version)
    return version


def production(spark: SparkSession, root: str) -> DataFrame:
    """(name, version): the production alias of every model."""
    latest = Window.partitionBy("name").orderBy(F.col("step").desc(), F.col("promoted_at").desc())
    log = _log(spark, f"{root}/_promotions", PROMOTIONS)
    return log.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").select(
        "name", "version"
    )


def metadata(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    log = _log(spark, f"{root}/_versions", VERSIONS).filter(F.col("name") == name)
    if version is not None:
        return log.filter(F.col("version") == version)
    return log.join(production(spark, root), ["name", "version"], "left_semi")


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> PipelineModel:
    row = metadata(spark, root, name, version).first()
    if row is None:
        raise FileNotFoundError(f"no production version of model '{name}'")
    return PipelineModel.load(row["path"])
