"""Keeping an experiment: result tables and its configuration."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession

#: The tables of a finished experiment and how they are partitioned.
TABLES = {"predictions": ["step"], "timings": [], "step_stats": [], "label_map": [], "epoch_log": []}


def save_results(tables: dict[str, DataFrame], config: object, path: str) -> None:
    """Write each table as parquet and the configuration as one JSON row."""
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.partitionBy(*TABLES.get(name, [])).parquet(f"{path}/{name}")
    text = json.dumps(dataclasses.asdict(config) if dataclasses.is_dataclass(config) else config, default=str)
    spark.createDataFrame([(text,)], "config string").write.json(f"{path}/config")


def load_results(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[dict[str, DataFrame], dict]:
    config = json.loads(spark.read.schema("config string").json(f"{path}/config").first()["config"])
    names = list(TABLES) if names is None else names
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, config
