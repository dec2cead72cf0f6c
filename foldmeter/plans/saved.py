"""Configurations as text and back: a saved experiment can be run again.

Every object is written with its kind, so reading gives the same objects and not bare dictionaries.  Known kinds are this
library's own configuration classes and ``pyspark.ml`` stages; nothing else is ever imported or called while reading.
"""

from __future__ import annotations

import dataclasses
import importlib
import json
from typing import Any

from pyspark.ml.param import Params
from pyspark.sql import SparkSession

from foldmeter.operators import classifiers, evolve, extractors, network, selection
from foldmeter.plans import config

VERSION = 1
_HOMES = (config, extractors, selection, classifiers, network, evolve)


def _known() -> dict[str, type]:
    return {k: v for home in _HOMES for k, v in vars(home).items() if isinstance(v, type) and dataclasses.is_dataclass(v) and v.__module__ == home.__name__}


def encode(x: Any) -> Any:
    """JSON values; raises ``TypeError`` for what cannot be read back, such as functions."""
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, (list, tuple)):
        return [encode(v) for v in x]
    if isinstance(x, dict):
        return {"map": [[encode(k), encode(v)] for k, v in x.items()]}
    if dataclasses.is_dataclass(x) and _known().get(type(x).__name__) is type(x):
        return {"kind": type(x).__name__, "fields": {f.name: encode(getattr(x, f.name)) for f in dataclasses.fields(x) if f.init}}
    if isinstance(x, Params) and type(x).__module__.startswith("pyspark.ml."):
        return {"stage": f"{type(x).__module__}:{type(x).__name__}", "params": {p.name: encode(v) for p, v in x.extractParamMap().items()}}
    raise TypeError(f"a {type(x).__name__} cannot be saved")


def decode(x: Any) -> Any:
    if isinstance(x, list):
        return [decode(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "map" in x:
        return {decode(k): decode(v) for k, v in x["map"]}
    if "kind" in x:
        kinds = _known()
        if x["kind"] not in kinds:
            raise ValueError(f"unknown kind {x['kind']}")
        return kinds[x["kind"]](**{k: decode(v) for k, v in x["fields"].items()})
    module, name = x["stage"].split(":")
    if not module.startswith("pyspark.ml."):
        raise ValueError(f"unknown stage {x['stage']}")
    stage = getattr(importlib.import_module(module), name)()
    return stage.copy({stage.getParam(k): decode(v) for k, v in x["params"].items()})


def save_experiment(spark: SparkSession, experiment: config.Experiment, path: str) -> None:
    text = json.dumps({"version": VERSION, "experiment": encode(experiment)})
    spark.createDataFrame([(text,)], "experiment string").write.json(path)


def load_experiment(spark: SparkSession, path: str) -> config.Experiment:
    saved = json.loads(spark.read.schema("experiment string").json(path).first()["experiment"])
    if saved["version"] != VERSION:
        raise ValueError(f"saved by version {saved['version']}, this is version {VERSION}")
    return decode(saved["experiment"])
