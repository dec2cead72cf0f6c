"""Feature extractors, one per attribute.

``fit(train, attribute)`` gives a fitted extractor with ``width``, ``names``,
``vector(df, out)`` (adds a vector column, nothing is shuffled) and ``long(df)``
((row_id, feature_ix, value), any width).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmeter.functions.numbers import strict_double
from foldmeter.functions.text import tokens
from foldmeter.operators import hog, text
from foldmeter.operators.bayes import fold_scores, fold_sums
from foldmeter.operators.counts import Terms, WideCounts
from foldmeter.operators.features import sparse_vectors, to_long
from foldmeter.session import has_at_most
from foldmeter.sources.paths import image_pixels

#: Vocabularies of at most so many terms go to every task; vectors of wider ones are grouped from the long form.
BROADCAST_TERMS = 1 << 18


@dataclass
class FittedArray:
    """Features that are an array expression of the row."""

    attribute: str
    width: int
    array: Column

    @property
    def names(self) -> list[str]:
        return [self.attribute] if self.width == 1 else [f"{self.attribute} : UNK"] * self.width

    def vector(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, array_to_vector(self.array))

    def long(self, df: DataFrame) -> DataFrame:
        return to_long(df.withColumn("_a", self.array), "_a")


@dataclass
class FoldFeatures:
    """Features of all steps at once.

    ``train()`` gives (row_id, fold, label_ix, feature, values) with a value per step, ``test()`` (row_id, fold, feature,
    value) of the step that tests the row, ``widths`` the number of features per step.  ``packed`` gives the sums and scores of
    multinomial models (see ``bayes.fold_sums``) where they need no long frame.
    """

    train: Callable[[], DataFrame]
    test: Callable[[], DataFrame]
    widths: list[int]
    packed: text.TfidfFolds | None = None

    def sums(self, n_classes: int) -> DataFrame:
        return fold_sums(self.train(), len(self.widths)) if self.packed is None else self.packed.sums(n_classes)

    def scores(self, table: DataFrame, n_classes: int) -> DataFrame:
        if self.packed is None:
            return fold_scores(self.test(), table, len(self.widths), n_classes)
        return self.packed.scores(table, n_classes)


def _same_in_all_folds(fitted, rows: DataFrame, folds: int) -> FoldFeatures:
    """A stateless extractor: one extraction serves every step."""
    keyed = rows.select("row_id", "fold", "label_ix", fitted.attribute)

    def entries() -> DataFrame:
        at = F.posexplode(F.filter(F.transform(fitted.array, lambda v, i: F.struct(i.alias("feature"), v.alias("value"))), lambda e: e["value"] != 0))
        return keyed.select("row_id", "fold", "label_ix", at.alias("_at", "e")).select(
            "row_id", "fold", "label_ix", F.col("e.feature").cast("bigint").alias("feature"), "e.value"
        )

    def train() -> DataFrame:
        return entries().select("row_id", "fold", "label_ix", "feature", F.array_repeat("value", folds).alias("values"))

    return FoldFeatures(train, lambda: entries().drop("label_ix"), [fitted.width] * folds)


@dataclass
class Pass:
    """The attribute is a number, or an array of numbers."""

    stateless = True

    def fit(self, train: DataFrame, attribute: str) -> FittedArray:
        kind = dict(train.dtypes)[attribute]
        if kind.startswith("array"):
            width = train.agg(F.max(F.size(attribute))).first()[0] or 0
            return FittedArray(attribute, width, F.col(attribute).cast("array<double>"))
        number = strict_double(F.col(attribute), attribute) if kind == "string" else F.col(attribute).cast("double")
        return FittedArray(attribute, 1, F.array(number))

    def fit_folds(self, rows: DataFrame, attribute: str, folds: int) -> FoldFeatures:
        return _same_in_all_folds(self.fit(rows, attribute), rows, folds)


@dataclass
class Hashing:
    non_negative: bool = False
    n_features: int = 100
    norm: str | None = "l2"
    case_sensitive: bool = True
    method: str = "xxhash64"
    stateless = True

    def __post_init__(self):
        text.check_hashing(self.n_features, self.norm)

    def fit(self, train: DataFrame, attribute: str) -> FittedHashing:
        words = tokens(F.col(attribute), not self.case_sensitive)
        entries = text.hashed_counts(words, self.n_features, self.non_negative, self.norm, self.method)
        return FittedHashing(attribute, self.n_features, text.dense_array(entries, self.n_features), entries)

    def fit_folds(self, rows: DataFrame, attribute: str, folds: int) -> FoldFeatures:
        return _same_in_all_folds(self.fit(rows, attribute), rows, folds)


@dataclass
class FittedHashing(FittedArray):
    entries: Column

    def long(self, df: DataFrame) -> DataFrame:
        return df.select("row_id", F.explode(self.entries).alias("e")).select("row_id", "e.feature_ix", "e.value")


@dataclass
class Tfidf:
    max_features: int | None = None
    case_sensitive: bool = True
    norm: str | None = "l2"
    stateless = False

    def __post_init__(self):
        if self.norm not in text.NORMS:
            raise ValueError(f"norm must be one of {text.NORMS}")
        if self.max_features is not None and self.max_features < 1:
            raise ValueError("max_features must be at least 1")

    def fit(self, train: DataFrame, attribute: str) -> FittedTfidf:
        model = text.Tfidf.fit(train, attribute, self.max_features, self.case_sensitive, self.norm)
        return FittedTfidf(attribute, model)

    def fit_folds(self, rows: DataFrame, attribute: str, folds: int) -> FoldFeatures | None:
        """None where every step cuts its vocabulary by itself."""
        if self.max_features is not None:
            return None
        model = text.TfidfFolds.fit(rows, folds, attribute, self.norm, not self.case_sensitive)
        return FoldFeatures(model.train, model.test, model.widths, model if model.own_rows else None)


class FittedTfidf:
    def __init__(self, attribute: str, model: text.Tfidf):
        self.attribute, self.model = attribute, model
        self._terms: list[tuple[str, float]] | None = None

    @property
    def width(self) -> int:
        return self.model.width()

    def _vocabulary(self) -> list[tuple[str, float]]:
        """Terms and weights in feature order."""
        if self._terms is None:
            self._terms = [(r["term"], r["idf"]) for r in self.model.vocab.orderBy("feature_ix").collect()]
        return self._terms

    @property
    def names(self) -> list[str]:
        return [f"{self.attribute} : {t}" for t, _ in self._vocabulary()]

    def vector(self, df: DataFrame, out: str) -> DataFrame:
        if not has_at_most(self.model.vocab, BROADCAST_TERMS):
            entry = F.struct("feature_ix", "value")
            grouped = self.long(df).groupBy("row_id").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
            parts = grouped.select("row_id", F.col("_entries.feature_ix").alias("_ix"), F.col("_entries.value").alias("_v"))
            return sparse_vectors(df.join(parts, "row_id", "left"), out, self.width)
        terms, weights = zip(*self._vocabulary()) if self._vocabulary() else ((), ())
        words = df.withColumn("_words", tokens(F.col(self.attribute), self.model.lowercase))
        counter = CountVectorizerModel.from_vocabulary(list(terms), inputCol="_words", outputCol="_counts")
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_counts", outputCol="_weighted")
        done = scaled.transform(counter.transform(words))
        if self.model.norm is None:
            done = done.withColumnRenamed("_weighted", out)
        else:
            p = 1.0 if self.model.norm == "l1" else 2.0
            done = Normalizer(p=p, inputCol="_weighted", outputCol=out).transform(done).drop("_weighted")
        return done.drop("_words", "_counts")

    def long(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


@dataclass
class Hog:
    """For image attributes (see ``sources.paths.image_attribute``)."""

    orientations_bins: int = 9
    pixels_per_cell_horizontal: int = 8
    pixels_per_cell_vertical: int = 8
    cells_per_block_horizontal: int = 3
    cells_per_block_vertical: int = 3
    block_norm: str = "L2-Hys"
    stateless = True

    def fit(self, train: DataFrame, attribute: str) -> FittedHog:
        """All images must give as many features."""
        size = F.size("features")
        found = self.features(train, attribute).agg(
            F.min(size).alias("low"), F.max(size).alias("high"), F.min_by("row_id", size).alias("row")
        )
        low, high, row = found.first()
        if low != high:
            raise ValueError(f"the image of row {row} gives {low} features, others give {high}")
        return FittedHog(attribute, low or 0, self)

    def features(self, df: DataFrame, attribute: str) -> DataFrame:
        img = F.col(attribute)
        images = df.select(
            F.col("row_id").alias("image_id"),
            img["height"].alias("height"),
            img["width"].alias("width"),
            img["nChannels"].alias("channels"),
            image_pixels(img["data"]).alias("pixels"),
        )
        return hog.hog_features(
            images,
            self.orientations_bins,
            self.pixels_per_cell_horizontal,
            self.pixels_per_cell_vertical,
            self.cells_per_block_horizontal,
            self.cells_per_block_vertical,
            self.block_norm,
        ).withColumnRenamed("image_id", "row_id")


@dataclass
class FittedHog:
    attribute: str
    width: int
    spec: Hog

    @property
    def names(self) -> list[str]:
        return [f"{self.attribute} : UNK"] * self.width

    def vector(self, df: DataFrame, out: str) -> DataFrame:
        found = self.spec.features(df, self.attribute)
        wrong = F.concat(F.lit("another number of features than in training: row "), F.col("row_id").cast("string"))
        checked = F.when(F.size("features") == self.width, F.col("features")).otherwise(F.raise_error(wrong))
        found = found.select("row_id", array_to_vector(checked).alias(out))
        return df.join(found, "row_id")

    def long(self, df: DataFrame) -> DataFrame:
        return to_long(self.spec.features(df, self.attribute))


@dataclass
class MLStages:
    """``pyspark.ml`` stages from the attribute to a vector: estimators and transformers, each reading the one before.

    A text's tokens, as this library splits them, are the first input with ``tokens=True``; else the attribute itself is.
    A ``CountVectorizer`` of tokens that finds more than ``BROADCAST_TERMS`` terms keeps them in a table.
    """

    stages: Sequence[Any]
    tokens: bool = False
    case_sensitive: bool = True
    stateless = False

    def fit(self, train: DataFrame, attribute: str) -> FittedStages:
        if not self.stages:
            raise ValueError("at least one stage is needed")
        fitted = FittedStages(attribute, [], 0, self)
        if self.tokens and type(self.stages[0]) is CountVectorizer:
            wide = WideCounts.fit(self.stages[0], train, attribute, not self.case_sensitive, BROADCAST_TERMS)
            if wide is not None:
                fitted.models.append(wide)
                if len(self.stages) == 1:
                    fitted.width = wide.width
                    return fitted
        done = len(fitted.models)
        frame = fitted.models[0].transform(train, "_s1") if done else fitted.start(train)
        for i, stage in list(enumerate(self.stages))[done:]:
            stage = stage.copy({stage.getParam("inputCol"): f"_s{i}", stage.getParam("outputCol"): f"_s{i + 1}"})
            fitted.models.append(stage.fit(frame) if hasattr(stage, "fit") else stage)
            frame = fitted.models[-1].transform(frame)
        u = F.unwrap_udt(f"_s{len(self.stages)}")
        fitted.width = frame.agg(F.max(F.coalesce(u["size"], F.size(u["values"])))).first()[0] or 0
        return fitted


@dataclass
class FittedStages:
    attribute: str
    models: list
    width: int
    spec: MLStages

    def start(self, df: DataFrame) -> DataFrame:
        first = tokens(F.col(self.attribute), not self.spec.case_sensitive) if self.spec.tokens else F.col(self.attribute)
        return df.withColumn("_s0", first)

    @property
    def names(self) -> Sequence[str]:
        """Terms where a stage has a vocabulary of the right size."""
        terms = next((m.vocabulary for m in reversed(self.models) if hasattr(m, "vocabulary") and len(m.vocabulary) == self.width), None)
        if isinstance(terms, Terms):
            return Terms(terms.table, terms.size, f"{self.attribute} : ")
        return [f"{self.attribute} : {t}" for t in terms or ["UNK"] * self.width]

    def vector(self, df: DataFrame, out: str) -> DataFrame:
        wide = [m for m in self.models[:1] if isinstance(m, WideCounts)]
        frame = wide[0].transform(df, "_s1") if wide else self.start(df)
        for model in self.models[len(wide) :]:
            frame = model.transform(frame)
        return frame.withColumnRenamed(f"_s{len(self.models)}", out).drop(*[f"_s{i}" for i in range(len(self.models))])

    def long(self, df: DataFrame) -> DataFrame:
        u = F.unwrap_udt("_v")
        at = F.when(u["type"] == 0, u["indices"]).otherwise(F.sequence(F.lit(0), F.size(u["values"]) - 1))
        zipped = F.explode(F.arrays_zip(at.alias("feature_ix"), u["values"].alias("value"))).alias("e")
        return self.vector(df, "_v").select("row_id", zipped).select("row_id", "e.feature_ix", "e.value").filter("value <> 0")
