"""Running a comparison: split, extract, select, train, predict, report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.operators import classifiers as models
from foldmeter.operators import labels, scores, splits
from foldmeter.operators.extractors import FoldFeatures
from foldmeter.plans.config import Experiment, Folded, LeaveOneOut
from foldmeter.plans.profile import working_set
from foldmeter.session import cut_lineage, scratch_dir, share_cores
from foldmeter.sources.checks import require_complete, require_rows

T = TypeVar("T")


@dataclass
class ResultTables:
    """Predictions with their truth, and everything derived from them.

    Derived tables are cached on first use; they are small.
    """

    predictions: DataFrame
    timings: DataFrame
    step_stats: DataFrame
    label_map: DataFrame
    epoch_log: DataFrame
    classifiers: DataFrame
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = build().persist()
        return self._cache[name]

    def positive_class(self) -> str | None:
        row = self.label_map.filter("label_ix = 1").first()
        return row["label"] if row else None

    def confusion_by_step(self) -> DataFrame:
        return self._once("confusion", lambda: scores.confusion_by_step(self.predictions))

    def scores_by_step(self) -> DataFrame:
        return self._once("steps", lambda: scores.scores_by_step(self.confusion_by_step(), self.positive_class()))

    def scores(self) -> DataFrame:
        return self._once("scores", lambda: scores.mean_scores(self.scores_by_step()))

    def times(self) -> DataFrame:
        return self._once("times", lambda: scores.mean_times(self.timings))

    def confusion_matrix(self, classifier: str) -> DataFrame:
        mine = self.confusion_by_step().filter(F.col("classifier") == classifier)
        total = scores.confusion_total(mine, self.label_map)
        return scores.confusion_matrix(total, labels.class_names(self.label_map)).orderBy("real")

    def cross_table(self, classifier: str) -> DataFrame:
        return scores.cross_table(self.confusion_by_step().filter(F.col("classifier") == classifier))

    def class_report(self) -> DataFrame:
        return scores.class_report(self.confusion_by_step())

    def summary(self) -> DataFrame:
        return scores.summary_table(self.scores(), self.times(), self.classifiers)

    def tables(self) -> dict[str, DataFrame]:
        """The tables to save (see ``sources.results``)."""
        names = ("predictions", "timings", "step_stats", "label_map", "epoch_log")
        return {n: getattr(self, n) for n in names}


class _Clock:
    """Wall and driver process seconds per (step, classifier, metric)."""

    def __init__(self):
        self.rows: list[tuple[int, str, str, float]] = []

    def run(self, step: int, classifiers: list[str], metric: str, work: Callable[[], T]) -> T:
        wall, proc = time.perf_counter(), time.process_time()
        out = work()
        spent = {f"{metric}_time": time.perf_counter() - wall, f"{metric}_process_time": time.process_time() - proc}
        self.rows += [(step, c, m, s) for c in classifiers for m, s in spent.items()]
        return out


def _force(df: DataFrame) -> DataFrame:
    """Cache a frame and compute all of it."""
    df = df.persist()
    df.write.format("noop").mode("overwrite").save()
    return df


def _extract(fitted: list, df: DataFrame, *keep: str) -> DataFrame:
    """Stack all attributes' vectors into ``features``."""
    columns = []
    for i, f in enumerate(fitted):
        columns.append(f"_f{i}")
        df = f.vector(df, columns[-1])
    if len(columns) == 1:
        stacked = df.withColumnRenamed(columns[0], "_stacked")
    else:
        stacked = VectorAssembler(inputCols=columns, outputCol="_stacked").transform(df)
    return stacked.select("row_id", *keep, "label", "label_ix", F.col("_stacked").alias("features"))


def run_experiment(df: DataFrame, config: Experiment) -> ResultTables:
    """Compare the classifiers.

    Per step the train and test features are extracted once, cached and shared
    by all classifiers.  Predictions go to a table in the shared scratch folder,
    which is both the forced action that is timed and the result's storage.
    """
    spark = df.sparkSession
    rows = working_set(df, config)
    require_complete(rows, [list(config.attributes), ["label"]])
    require_rows(rows)
    mapping = labels.label_map(rows).persist()
    rows = labels.encode(rows, mapping).persist()
    n_classes = mapping.count()
    names = [c.name for c in config.classifiers]
    order = [(i, c.name, c.name, c.abbreviation) for i, c in enumerate(config.classifiers)]
    classifiers = spark.createDataFrame(order, "position int, classifier string, name string, abbreviation string")

    if isinstance(config.validator, LeaveOneOut) and _closed_form(config):
        return _left_out(rows, config, mapping, classifiers)

    clock, predicted, stats, epochs = _Clock(), [], [], []
    at_once, looped = _all_fold_classifiers(config)
    if at_once:
        done, stats = _all_folds(rows, config, at_once, mapping, clock)
        if done is None:
            looped = list(config.classifiers)
        else:
            predicted += done
    if looped:
        stats = []
        names = [c.name for c in looped]
        steps = config.validator.steps(rows)
    for step in range(steps.n if looped else 0):
        train_rows, test_rows = steps.frames(step)

        def fit_and_extract():
            fitted = [extractor.fit(train_rows, a) for a, extractor in config.attributes.items()]
            return fitted, _force(_extract(fitted, train_rows))

        fitted, train = clock.run(step, names, "train_extraction", fit_and_extract)

        def fit_selectors():
            frame, models = train, []
            for selector in config.selectors:
                models.append(selector.fit(frame))
                frame = models[-1].transform(frame)
            return models, _force(frame) if models else frame

        selectors, selected = clock.run(step, names, "train_selection", fit_selectors)
        test = clock.run(step, names, "test_extraction", lambda: _force(_extract(fitted, test_rows)))

        def apply_selectors():
            frame = test
            for model in selectors:
                frame = model.transform(frame)
            return _force(frame) if selectors else frame

        tested = clock.run(step, names, "test_selection", apply_selectors)
        width = len(selectors[-1].indices) if selectors else sum(f.width for f in fitted)
        stats.append((step, selected.count(), tested.count(), width))

        def feature_names():
            return reduce(lambda names, s: s.names(names), selectors, [n for f in fitted for n in f.names])

        for classifier in looped:
            name = classifier.name
            model = clock.run(step, [name], "train", lambda: classifier.fit(selected, n_classes))
            predict = lambda: cut_lineage(_named(model.predict(tested), feature_names))
            codes = clock.run(step, [name], "test", predict)
            predicted.append(_write_step(step, name, tested, codes, mapping))
            epochs += [(step, name, *e) for e in model.epochs]
        for frame in {id(f): f for f in (train, selected, test, tested)}.values():
            frame.unpersist()

    return ResultTables(
        predictions=spark.read.parquet(*predicted),
        timings=spark.createDataFrame(clock.rows, "step int, classifier string, metric string, seconds double"),
        step_stats=spark.createDataFrame(stats, "step int, n_train bigint, n_test bigint, n_features bigint"),
        label_map=mapping,
        epoch_log=spark.createDataFrame(epochs, "step int, classifier string, epoch int, loss double, accuracy double"),
        classifiers=classifiers,
    )


_TOP = "array<struct<name:string,importance:double>>"


def _write_step(step: int, name: str, tested: DataFrame, codes: DataFrame, mapping: DataFrame) -> str:
    """The path of one classifier's predictions of one step, beside the truth."""
    truth = tested.select("row_id", F.col("label").alias("real"))
    joined = labels.decode(truth.join(codes, "row_id"), mapping, {"predicted_ix": "predicted"})
    path = scratch_dir(tested.sparkSession)
    joined.select(F.lit(step).alias("step"), F.lit(name).alias("classifier"), "row_id", "real", "predicted", "top").write.parquet(path)
    return path


def _named(codes: DataFrame, names: Callable[[], list[str]]) -> DataFrame:
    """(row_id, predicted_ix, top with feature names); the names are asked for only if there is a top."""
    if "top" not in codes.columns:
        return codes.select("row_id", "predicted_ix", F.lit(None).cast(_TOP).alias("top"))
    spark = codes.sparkSession
    table = spark.createDataFrame(list(enumerate(names())), "feature_ix int, name string")
    flat = codes.select("row_id", "predicted_ix", F.posexplode_outer("top").alias("place", "t"))
    named = flat.join(table, flat["t.feature_ix"] == table["feature_ix"], "left")
    item = F.struct("place", "name", F.col("t.importance").alias("importance"))
    back = named.groupBy("row_id", "predicted_ix").agg(F.sort_array(F.collect_list(item)).alias("top"))
    plain = F.transform("top", lambda e: F.struct(e["name"].alias("name"), e["importance"].alias("importance")))
    return back.select("row_id", "predicted_ix", plain.cast(_TOP).alias("top"))


def _all_fold_classifiers(config: Experiment) -> tuple[list, list]:
    """Classifiers that can be trained for all folds in one pass, or for all folds side by side, and the others."""
    able = isinstance(config.validator, Folded) and not config.selectors
    able = able and all(hasattr(e, "fit_folds") for e in config.attributes.values())
    still = all(getattr(e, "stateless", False) for e in config.attributes.values())

    def fits(c) -> bool:
        return able and ((getattr(c, "takes_all_folds", False) and (_long(c) or still)) or (_side_by_side(c) and still))

    at_once = [c for c in config.classifiers if fits(c)]
    return at_once, [c for c in config.classifiers if c not in at_once]


def _long(classifier) -> bool:
    """Trained from long features that may differ from step to step."""
    return getattr(classifier, "type_v", None) == "multinomial"


def _side_by_side(classifier) -> bool:
    """Trained once per step, all steps at the same time (see ``classifiers.DecisionTree``)."""
    return getattr(classifier, "side_by_side", False)


def _together(work: Callable[[int], T], n: int) -> list[T]:
    """``work(step)`` of all steps at the same time."""
    with ThreadPool(n) as pool:
        return pool.map(inheritable_thread_target(work), range(n))


def _all_folds(rows: DataFrame, config: Experiment, at_once: list, mapping: DataFrame, clock: _Clock):
    """Every step of ``at_once`` without a loop over steps: features and sums are kept for all folds together.

    Stateless attributes are extracted once, whatever takes part: long features are read off the vectors where there are any.
    Returns the paths of the predictions and the step statistics, or None where an extractor needs each step by itself.
    The time of a pass is divided evenly among its steps.
    """
    spark = rows.sparkSession
    folded, n_folds = config.validator.folded(rows)
    folded = cut_lineage(folded)
    n_classes = mapping.count()
    keys = folded.select("row_id", "fold", "label_ix").persist()
    parts, vectors = [], None
    still = [c for c in at_once if not _long(c)]
    if still:
        start = _Lap(clock, n_folds, [c.name for c in at_once], "train_extraction")
        fitted = [e.fit(folded, a) for a, e in config.attributes.items()]
        vectors = _force(_extract(fitted, folded, "fold"))
        start.stop()
        widths = [sum(f.width for f in fitted)] * n_folds
        if len(still) < len(at_once):
            found = models.entries(vectors, "fold", "label_ix").withColumnRenamed("feature_ix", "feature")
            train = found.withColumn("values", F.array_repeat("value", n_folds)).drop("value")
            parts = [FoldFeatures(lambda: train, lambda: found.drop("label_ix"), widths)]
    else:
        start = _Lap(clock, n_folds, [c.name for c in at_once], "train_extraction")
        parts = [e.fit_folds(folded, a, n_folds) for a, e in config.attributes.items()]
        if any(p is None for p in parts):
            return None, []
        start.stop()
        widths = [sum(p.widths[s] for p in parts) for s in range(n_folds)]
    paths = []
    for c in at_once:
        if _side_by_side(c):
            start = _Lap(clock, n_folds, [c.name], "train")
            sides = [splits.fold_roles(vectors, s) for s in range(n_folds)]
            fits = _together(lambda s: c.fit(share_cores(sides[s][0], n_folds), n_classes), n_folds)
            start.stop()
            start = _Lap(clock, n_folds, [c.name], "test")
            paths += _together(lambda s: _write_step(s, c.name, sides[s][1], _named(fits[s].predict(sides[s][1]), list), mapping), n_folds)
            start.stop()
            continue
        start = _Lap(clock, n_folds, [c.name], "train")
        codes = c.all_folds_dense(vectors, n_folds, n_classes) if c in still else c.all_folds(keys, parts, n_folds, widths, n_classes)
        codes = cut_lineage(codes)
        start.stop()
        start = _Lap(clock, n_folds, [c.name], "test")
        truth = folded.select("row_id", F.col("fold").cast("int").alias("step"), F.col("label").alias("real"))
        joined = labels.decode(truth.join(codes, "row_id"), mapping, {"predicted_ix": "predicted"})
        path = scratch_dir(spark)
        joined.select("step", F.lit(c.name).alias("classifier"), "row_id", "real", "predicted", F.lit(None).cast(_TOP).alias("top")).write.parquet(path)
        start.stop()
        paths.append(path)
    if vectors is not None:
        vectors.unpersist()
    for metric in ("train_selection", "test_selection", "test_extraction"):  # no selectors; tests are extracted with the training rows
        clock.rows += [(s, c.name, f"{metric}_{kind}", 0.0) for s in range(n_folds) for c in at_once for kind in ("time", "process_time")]
    sizes = {r["fold"]: r["count"] for r in keys.groupBy("fold").count().collect()}  # one row per fold
    keys.unpersist()
    total = sum(sizes.values())
    return paths, [(s, total - sizes.get(s, 0), sizes.get(s, 0), widths[s]) for s in range(n_folds)]


class _Lap:
    """Time of a pass over all steps; every step gets an even share."""

    def __init__(self, clock: _Clock, n: int, names: list[str], metric: str):
        self.clock, self.n, self.names, self.metric = clock, n, names, metric
        self.at = time.perf_counter(), time.process_time()

    def stop(self) -> None:
        spent = (time.perf_counter() - self.at[0]) / self.n, (time.process_time() - self.at[1]) / self.n
        for step in range(self.n):
            for name in self.names:
                self.clock.rows.append((step, name, f"{self.metric}_time", spent[0]))
                self.clock.rows.append((step, name, f"{self.metric}_process_time", spent[1]))


def _closed_form(config: Experiment) -> bool:
    """Leave-one-out without a loop: nothing but the classifier itself may learn from the rows."""
    still = all(getattr(e, "stateless", False) for e in config.attributes.values())
    able = all(
        hasattr(c, "left_out") and c.normalizer is None
        for c in config.classifiers
    )
    return still and able and not config.selectors


def _left_out(rows: DataFrame, config: Experiment, mapping: DataFrame, classifiers: DataFrame) -> ResultTables:
    from foldmeter.operators.splits import leave_one_out

    spark = rows.sparkSession
    clock, predicted = _Clock(), []
    names = [c.name for c in config.classifiers]
    fitted = [e.fit(rows, a) for a, e in config.attributes.items()]
    numbered = leave_one_out(rows)
    features = clock.run(0, names, "train_extraction", lambda: _force(_extract(fitted, rows)))
    n = features.count()
    steps = numbered.select("row_id", F.col("fold").cast("int").alias("step"), F.col("label").alias("real")).persist()
    for classifier in config.classifiers:
        codes = clock.run(0, [classifier.name], "test", lambda: cut_lineage(classifier.left_out(features)))
        joined = labels.decode(steps.join(codes, "row_id"), mapping, {"predicted_ix": "predicted"})
        path = scratch_dir(spark)
        joined.select(
            "step", F.lit(classifier.name).alias("classifier"), "row_id", "real", "predicted", F.lit(None).cast(_TOP).alias("top")
        ).write.parquet(path)
        predicted.append(path)
    width = sum(f.width for f in fitted)
    stats = steps.select(
        "step", F.lit(n - 1).cast("bigint").alias("n_train"), F.lit(1).cast("bigint").alias("n_test"),
        F.lit(width).cast("bigint").alias("n_features"),
    )
    return ResultTables(
        predictions=spark.read.parquet(*predicted),
        timings=spark.createDataFrame(clock.rows, "step int, classifier string, metric string, seconds double"),
        step_stats=stats,
        label_map=mapping,
        epoch_log=spark.createDataFrame([], "step int, classifier string, epoch int, loss double, accuracy double"),
        classifiers=classifiers,
    )
