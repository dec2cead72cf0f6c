"""Evolution of prototype classifiers.

A genome is a few flat arrays: one rating function per class, and one row of the slot table for each stored vector.  Training
rows are numbered class after class, so a draw is a number.  The driver holds the population, about ten genomes; each
generation is two jobs over the rows: one fetches the rows that are drawn for the first time, one rates all new genomes
together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.operators.prototypes import FUNCTIONS, ClassFunction, Population, classify, fitness
from foldmeter.operators.ranks import rank_by_key
from foldmeter.operators.splits import stratified_holdout

# Ways to pick parents.
SELECTIONS = ("RANK", "RULETE")


class Rows:
    """Training rows by number, and the vectors fetched so far."""

    def __init__(self, ranked: DataFrame):
        self.ranked = ranked
        sizes = sorted((r["label_ix"], r["count"]) for r in ranked.groupBy("label_ix").count().collect())  # per class
        self.codes = np.array([c for c, _ in sizes])
        self.size = np.array([n for _, n in sizes])
        self.start = np.r_[0, np.cumsum(self.size)]
        self.vectors: dict[int, np.ndarray] = {}

    def draw(self, rng: np.random.Generator, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each class position a row, of that class or of the others with even chances, and its value, 1 or -1."""
        own = (rng.random(len(cls)) < 0.5) | (len(self.codes) == 1)
        return self.draw_of(rng, cls, own), np.where(own, 1.0, -1.0)

    def draw_of(self, rng: np.random.Generator, cls: np.ndarray, own: np.ndarray) -> np.ndarray:
        size, start = self.size[cls], self.start[cls]
        k = rng.integers(0, np.where(own, size, self.start[-1] - size))
        return np.where(own, start + k, k + size * (k >= start))

    def fetch(self, genomes: list[Genome]) -> None:
        """One job for all rows that no genome had before."""
        new = np.setdiff1d(np.concatenate([g.row for g in genomes]), np.fromiter(self.vectors, np.int64))
        if not len(new):
            return
        cls = np.searchsorted(self.start, new, side="right") - 1
        keys = [(int(self.codes[c]), int(r - self.start[c]), int(r)) for c, r in zip(cls, new)]
        wanted = self.ranked.sparkSession.createDataFrame(keys, "label_ix int, rank bigint, number bigint")
        # a few rows for each genome
        found = self.ranked.join(F.broadcast(wanted), ["label_ix", "rank"]).select("number", "features").collect()
        self.vectors.update((r["number"], np.array(r["features"])) for r in found)


@dataclass
class Genome:
    """``fun``: function number per class; ``cls``, ``row``, ``value``: the slot table."""

    fun: np.ndarray
    cls: np.ndarray
    row: np.ndarray
    value: np.ndarray
    ratings: list[float] = field(default_factory=list)

    @property
    def score(self) -> float:
        return float(np.mean(self.ratings)) if self.ratings else 0.0

    def slots(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.cls[chosen], self.row[chosen], self.value[chosen]

    def functions(self, rows: Rows) -> dict[int, ClassFunction]:
        out = {}
        for c, code in enumerate(rows.codes.tolist()):
            mine = self.cls == c
            vectors = np.vstack([rows.vectors[r] for r in self.row[mine].tolist()])
            out[code] = ClassFunction(FUNCTIONS[self.fun[c]], self.value[mine], vectors)
        return out


def random_genome(rows: Rows, max_slots: int, rng: np.random.Generator) -> Genome:
    """Per class a random function and at most ``max_slots`` slots: some of the class, and some of others if there are any."""
    n = len(rows.codes)
    own = rng.integers(1, max_slots, n)
    other = rng.integers(1, max_slots - own + 1) * (n > 1)
    cls = np.repeat(np.r_[np.arange(n), np.arange(n)], np.r_[own, other])
    is_own = np.arange(len(cls)) < own.sum()
    value = np.where(is_own, 1.0, -1.0)
    return Genome(rng.integers(0, len(FUNCTIONS), n), cls, rows.draw_of(rng, cls, is_own), value)


def crossed(a: Genome, b: Genome, rng: np.random.Generator) -> tuple[Genome, Genome]:
    """Every function and slot of both parents goes to one of two children, by one draw of a mask each.

    A child holds a row once per class; for a class that got no slot it takes those of the parent of its place.
    """
    swap = rng.random(len(a.fun)) < 0.5
    funs = np.where(swap, b.fun, a.fun), np.where(swap, a.fun, b.fun)
    cls, row, value = (np.r_[x, y] for x, y in zip((a.cls, a.row, a.value), (b.cls, b.row, b.value)))
    second = rng.random(len(cls)) < 0.5
    born = []
    for fun, mine, parent in zip(funs, (~second, second), (a, b)):
        own = np.flatnonzero(mine)
        _, once = np.unique(np.stack([cls[own], row[own]]), axis=1, return_index=True)
        own = own[np.sort(once)]
        lent = parent.slots(~np.isin(parent.cls, cls[own]))
        born.append(Genome(fun, *(np.r_[x[own], y] for x, y in zip((cls, row, value), lent))))
    return born[0], born[1]


def mutated(g: Genome, limit: int, rows: Rows, rng: np.random.Generator) -> Genome:
    """Up to ``limit`` changes, dealt by one draw to new rows, more slots, fewer slots, other values, other functions."""
    fresh, more, fewer, moved, turned = rng.multinomial(rng.integers(0, limit + 1), (0.25, 0.125, 0.125, 0.25, 0.25))
    fun, cls, row, value = g.fun.copy(), g.cls, g.row.copy(), g.value.copy()
    at = rng.integers(0, len(cls), fresh)
    row[at], value[at] = rows.draw(rng, cls[at])
    np.add.at(value, rng.integers(0, len(cls), moved), rng.uniform(-1, 1, moved))
    fun[rng.integers(0, len(fun), turned)] = rng.integers(0, len(FUNCTIONS), turned)
    # a class keeps one slot: in a random order, its first is not on offer
    order = rng.permutation(len(cls))
    _, first = np.unique(cls[order], return_index=True)
    left = np.delete(np.arange(len(cls)), np.delete(order, first)[:fewer])
    added = rng.integers(0, len(fun), more)
    drawn = rows.draw(rng, added)
    return Genome(fun, np.r_[cls[left], added], np.r_[row[left], drawn[0]], np.r_[value[left], drawn[1]])


@dataclass
class EvolvedPrototypes:
    """Parameters of the evolution."""

    generations: int = 100
    stop_accuracy: float | None = None
    population: int = 10
    selection_method: str = "RANK"
    random_seed: int | None = None
    max_crossovers: int = 1
    max_mutations: int = 5
    max_start_slots: int = 2
    crossover_prob: float = 0.75
    test_set_size: float = 1.0
    change_test_set: bool = False
    log_gen_fitness: bool = True

    def __post_init__(self):
        checks = {
            "generations": self.generations >= 0,
            "population": self.population >= 1,
            "selection_method": self.selection_method in SELECTIONS,
            "max_crossovers": self.max_crossovers >= 1,
            "max_mutations": self.max_mutations >= 0,
            "max_start_slots": self.max_start_slots >= 2,
            "crossover_prob": 0.0 <= self.crossover_prob <= 1.0,
            "test_set_size": 0.0 <= self.test_set_size <= 1.0,
            "stop_accuracy": self.stop_accuracy is None or 0.0 <= self.stop_accuracy <= 1.0,
        }
        bad = [name for name, good in checks.items() if not good]
        if bad:
            raise ValueError(f"out of bounds: {', '.join(bad)}")

    def fit(self, train: DataFrame) -> FittedPrototypes:
        """``train`` is (row_id, label_ix, features)."""
        rng = np.random.default_rng(self.random_seed)
        ranked = rank_by_key(train.select("row_id", "label_ix", "features"), by=["label_ix"]).drop("group_n").persist()
        rows = Rows(ranked)
        tests = self._test_rows(ranked, 0)
        crowd = [random_genome(rows, self.max_start_slots, rng) for _ in range(self.population)]
        self._rate(tests, crowd, rows)
        best = max(crowd, key=lambda g: g.score)
        log: list[tuple[int, float]] = []
        for generation in range(1, self.generations + 1):
            if self.stop_accuracy is not None and best.score >= self.stop_accuracy:
                break
            log.append((generation, best.score))
            born = self._born(crowd, rows, rng)
            self._rate(tests, born, rows)
            # the best stay, on a tie the younger
            crowd = sorted([*born, *crowd], key=lambda g: -g.score)[: self.population]
            if self.change_test_set and self.test_set_size < 1:
                tests.unpersist()
                tests = self._test_rows(ranked, generation)
                self._rate(tests, [*crowd, *([] if any(g is best for g in crowd) else [best])], rows)
            best = max([*crowd, best], key=lambda g: g.score)
        if tests is not ranked:
            tests.unpersist()
        ranked.unpersist()
        return FittedPrototypes(best.functions(rows), best.score, log if self.log_gen_fitness else [])

    def _test_rows(self, ranked: DataFrame, draw: int) -> DataFrame:
        if self.test_set_size >= 1:
            return ranked
        rows = ranked.select("row_id", "label_ix", "features")
        seed = self.random_seed or 0
        return stratified_holdout(rows, self.test_set_size, seed, draw, "label_ix").filter("role = 'test'").persist()

    def _rate(self, tests: DataFrame, genomes: list[Genome], rows: Rows) -> None:
        rows.fetch(genomes)
        found = {r["individual"]: r["fitness"] for r in fitness(tests, [g.functions(rows) for g in genomes]).collect()}
        for i, g in enumerate(genomes):
            g.ratings.append(found.get(i, 0.0))

    def _born(self, crowd: list[Genome], rows: Rows, rng: np.random.Generator) -> list[Genome]:
        """Two children for each crossing of this generation's pair of parents."""
        score = np.array([g.score for g in crowd])
        chance = np.argsort(np.argsort(score, kind="stable")) + 1.0 if self.selection_method == "RANK" else score
        chance = chance / chance.sum() if chance.sum() > 0 else None
        a, b = (crowd[i] for i in rng.choice(len(crowd), 2, p=chance))
        times = rng.integers(1, self.max_crossovers + 1)
        pairs = [crossed(a, b, rng) if cross else (a, b) for cross in rng.random(times) <= self.crossover_prob]
        return [mutated(g, self.max_mutations, rows, rng) for pair in pairs for g in pair]


@dataclass
class FittedPrototypes:
    """The best candidate, its fitness and the best fitness before each generation."""

    functions: dict[int, ClassFunction]
    score: float
    log: list[tuple[int, float]]

    def population(self) -> Population:
        return [self.functions]

    def predict(self, df: DataFrame) -> DataFrame:
        """(row_id, predicted_ix)."""
        return classify(df, self.population()).select("row_id", "predicted_ix")
