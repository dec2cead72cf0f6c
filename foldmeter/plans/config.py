"""What to compare: attributes, selectors, validation and classifiers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.operators import splits


def _roles_from_folds(df: DataFrame) -> Callable[[int], tuple[DataFrame, DataFrame]]:
    return lambda step: splits.fold_roles(df, step)


class Steps:
    """Number of steps and the (train, test) frames of each."""

    def __init__(self, n: int, frames: Callable[[int], tuple[DataFrame, DataFrame]]):
        self.n, self.frames = n, frames


class Folded:
    """A validator that partitions the rows; ``folded(df)`` adds ``fold`` and tells how many there are."""

    def steps(self, df: DataFrame) -> Steps:
        folded, n = self.folded(df)
        return Steps(n, _roles_from_folds(folded.persist()))


@dataclass
class StratifiedKFold(Folded):
    folds: int = 5
    shuffle: bool = False
    random_seed: int | None = None

    def folded(self, df: DataFrame) -> tuple[DataFrame, int]:
        return splits.stratified_k_fold(df, self.folds, "label", self.shuffle, self.random_seed), self.folds


@dataclass
class KFold(Folded):
    folds: int = 5
    shuffle: bool = False
    random_seed: int | None = None

    def folded(self, df: DataFrame) -> tuple[DataFrame, int]:
        return splits.k_fold(df, self.folds, self.shuffle, self.random_seed), self.folds


@dataclass
class PreparedFolds(Folded):
    """The attribute's numbers are the folds."""

    attribute: str

    def folded(self, df: DataFrame) -> tuple[DataFrame, int]:
        folded = splits.prepared_folds(df, self.attribute)
        return folded, splits.number_of_steps(folded).first()[0]


@dataclass
class PreparedSets:
    """``7`` and ``7t`` marks; any function giving (step, row_id, role) works as ``assign`` as well."""

    attribute: str | None = None
    assign: Callable[[DataFrame], DataFrame] | None = None

    def steps(self, df: DataFrame) -> Steps:
        roles = self.assign(df) if self.assign else splits.prepared_sets(df, self.attribute)
        roles = roles.persist()
        splits.check_steps(roles)
        n = splits.number_of_steps(roles, "step").first()[0]

        def frames(step: int) -> tuple[DataFrame, DataFrame]:
            mine = roles.filter(F.col("step") == step)
            return tuple(df.join(mine.filter(F.col("role") == r), "row_id", "left_semi") for r in ("train", "test"))

        return Steps(n, frames)


@dataclass
class LeaveOneOut:
    """Closed form where classifier and extractors allow it; else one step per row, however many rows there are.

    ``max_steps`` may be given to refuse more steps than one wants to wait for.
    """

    max_steps: int | None = None

    def steps(self, df: DataFrame) -> Steps:
        n = df.count()
        if self.max_steps is not None and n > self.max_steps:
            raise ValueError(f"leave-one-out would take {n} steps; at most {self.max_steps} are run one by one")
        return Steps(n, _roles_from_folds(splits.leave_one_out(df).persist()))


@dataclass
class Experiment:
    """Configuration of a comparison.

    ``attributes`` maps column names to extractors; columns not named are not used.
    ``quotas`` keeps the first rows of each listed class; ``inactive`` drops classes.
    """

    label: str
    attributes: Mapping[str, Any]
    validator: Any = field(default_factory=StratifiedKFold)
    classifiers: Sequence[Any] = ()
    selectors: Sequence[Any] = ()
    quotas: Mapping[str, int] | None = None
    inactive: Sequence[str] = ()
    row_id: str = "row_id"

    def __post_init__(self):
        if not self.label:
            raise ValueError("an experiment needs a label")
        names = [c.name for c in self.classifiers]
        if len(set(names)) != len(names):
            raise ValueError("classifiers need different names")
