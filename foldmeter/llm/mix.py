"""Mixing sources to target token weights by min-cost flow.

Documents are added up by membership pattern (the set of sources they belong to).  Tokens flow from patterns to the quotas of
their sources; the first copy of a pattern's tokens costs nothing, every further copy one more than the copy before, so
repetition is used last and evenly.  Then each pattern's documents are taken in a seeded order up to its flow.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldmeter.llm.text import beside, word_array
from foldmeter.session import broadcast_if_small, cut_lineage

#: Patterns are a matter of configuration, not of corpus size: more of them are refused.
MOST_PATTERNS = 100_000
BINS = 1024


def source_targets(sizes: dict, weights: tuple[int, ...], share: float, most: float) -> dict:
    """Targets by source: ``share`` of all tokens by weight (repeating, in code point order, null last), none above ``most``
    times its source; what is over goes to the others by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict, copies: int) -> dict[tuple, list[int]]:
    """Tokens each pattern gives with its first, second, ... copy: the cheapest flow that fills the quotas as far as possible.

    Costs rise with the copy, so the flow is augmented copy by copy, each time along shortest paths of the residual graph.
    """
    flow: dict[tuple, int] = defaultdict(int)  # (pattern, source)
    filled: dict = defaultdict(int)
    given = {p: [0] * copies for p in patterns}
    members = defaultdict(list)
    for p in patterns:
        for s in p:
            members[s].append(p)
    for copy in range(copies):
        for start in patterns:
            while given[start][copy] < patterns[start]:
                came, queue, end = {("p", start): None}, deque([("p", start)]), None
                while queue and end is None:
                    kind, x = node = queue.popleft()
                    if kind == "p":
                        following = [("s", s) for s in x]
                    elif filled[x] < quotas[x]:
                        end = node
                        break
                    else:
                        following = [("p", p) for p in members[x] if flow[p, x] > 0]
                    for f in following:
                        if f not in came:
                            came[f] = node
                            queue.append(f)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                amount = min(patterns[start] - given[start][copy], quotas[end[1]] - filled[end[1]])
                steps = list(zip(path, path[1:]))
                amount = min([amount, *(flow[b[1], a[1]] for a, b in steps if a[0] == "s")])
                for a, b in steps:
                    if a[0] == "p":
                        flow[a[1], b[1]] += amount
                    else:
                        flow[b[1], a[1]] -= amount
                filled[end[1]] += amount
                given[start][copy] += amount
    return given


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (same names are replaced).

    ``source_column`` holds one source or an array of them; null is a source, an empty array gives nothing.  size is the
    number of words, taken how many of them the mix takes, repeats counted; at most ``most`` times the size.  source_size and
    target are those of the first source.  Order within a pattern: a seeded hash of id and text, then the id; rows equal in
    both share a place and are taken in either order.
    """
    return beside(docs, [id_column, text_column, source_column], lambda d: _mix_sources(d, id_column, text_column, source_column, weights, share, most, seed))


def _mix_sources(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    source_column: str,
    weights: tuple[int, ...],
    share: float,
    most: int,
    seed: int,
) -> DataFrame:
    spark = docs.sparkSession
    many = dict(docs.dtypes)[source_column].startswith("array")
    members = F.array_sort(F.array_distinct(source_column)) if many else F.array(source_column)
    made = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*made)
    place = F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column))
    keyed = docs.withColumns({"_members": members, "size": F.size(word_array(F.col(text_column))).cast("long"), "_place": place})
    narrow = cut_lineage(keyed.select(F.col(id_column).alias("_id"), "_members", "size", "_place"))
    sums = narrow.groupBy("_members").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = {tuple(r["_members"] or ()): r["size"] for r in sums}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    base = sum(patterns.values())
    targets = source_targets(sizes, weights, share * base / max(1, sum(sizes.values())), most)
    given = route(patterns, {s: round(t) for s, t in targets.items()}, most)

    schema = "_members array<string>, _quotas array<long>, source_size long, target double"
    rows = [(list(p), given[p], sizes[p[0]] if p else 0, float(targets[p[0]]) if p else 0.0) for p in patterns]
    plan = F.broadcast(spark.createDataFrame(rows, schema))
    bin_ = F.pmod(F.shiftrightunsigned("_place", 20), F.lit(BINS)).cast("int")
    placed = narrow.withColumn("_bin", bin_)
    bins = placed.groupBy("_members", "_bin").agg(F.sum("size").alias("in_bin"))
    before = Window.partitionBy("_members").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("in_bin").over(before), F.lit(0)))
    bins = bins.join(plan, bins["_members"].eqNullSafe(plan["_members"])).select(bins["_members"], "_bin", "in_bin", "before", "_quotas")
    cut = F.exists("_quotas", lambda q: (F.col("before") < q) & (q < F.col("before") + F.col("in_bin")))
    whole = F.aggregate("_quotas", F.lit(0), lambda a, q: a + F.when(q >= F.col("before") + F.col("in_bin"), 1).otherwise(0))
    bins = cut_lineage(bins.select("_members", "_bin", "before", "_quotas", cut.alias("cut"), whole.alias("whole")))
    # only the bins that a quota cuts are ordered document by document
    edge = bins.filter("cut").select(F.col("_members").alias("_m"), F.col("_bin").alias("_b"), "before", "_quotas")
    rows_ = placed.join(broadcast_if_small(edge), placed["_members"].eqNullSafe(F.col("_m")) & (placed["_bin"] == F.col("_b")))
    inner = Window.partitionBy("_m", "_b").orderBy("_place", "_id").rowsBetween(Window.unboundedPreceding, -1)
    rows_ = rows_.withColumn("_at", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    part = F.aggregate(
        "_quotas", F.lit(0).cast("long"), lambda a, q: a + F.least(F.col("size"), F.greatest(q - F.col("_at"), F.lit(0)))
    )
    rows_ = rows_.groupBy(F.col("_id").alias("_i"), F.col("_place").alias("_p"), F.col("_m")).agg((F.sum(part) / F.count("*")).cast("long").alias("part"))
    rows_ = cut_lineage(rows_)
    levels = bins.filter("not cut").select(F.col("_members").alias("_m2"), F.col("_bin").alias("_b2"), "whole")
    out = keyed.withColumn("_bin", bin_)
    out = out.join(broadcast_if_small(levels), out["_members"].eqNullSafe(F.col("_m2")) & (out["_bin"] == F.col("_b2")), "left")
    out = out.join(
        broadcast_if_small(rows_),
        out["_members"].eqNullSafe(F.col("_m")) & (out["_place"] == F.col("_p")) & out[id_column].eqNullSafe(F.col("_i")),
        "left",
    )
    sides = plan.select(F.col("_members").alias("_m3"), "source_size", "target")
    out = out.join(F.broadcast(sides), out["_members"].eqNullSafe(F.col("_m3")))
    taken = F.coalesce(F.col("part"), F.col("whole") * F.col("size"), F.lit(0)).cast("long").alias("taken")
    return out.select(*docs.columns, "size", "source_size", "target", taken)
