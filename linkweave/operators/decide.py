"""Decisions on scored pairs (s1, src, tgt, p): exclusive assignment, thresholds, expected F0.5."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.similarity import token_set_ratio
from linkweave.runtime import by_value


by_value(__name__)


def exclusive(pairs: DataFrame) -> DataFrame:
    """Each target stays with its best s1, ties by the smaller."""
    order = Window.partitionBy("src", "tgt").orderBy(F.desc("p"), "s1")
    return pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def threshold(pairs: DataFrame, t: float) -> DataFrame:
    return pairs.filter(F.col("p") >= t)


def expected_f(pairs: DataFrame, floor: float = 0.6, empty_bias: float = 1.0) -> DataFrame:
    """The prefix by falling p with the best expected F0.5, of pairs from ``floor``; nothing where empty is better.

    Of n pairs from floor / 2, a prefix of k has 1.25 * sum of its p / (k + 0.25 * sum of all p); the first best k counts.
    """
    keep = pairs.filter(F.col("p") >= floor / 2)
    order = Window.partitionBy("s1").orderBy(F.desc("p"), "src", "tgt")
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = keep.withColumns({
        "_k": F.row_number().over(order),
        "_sum": F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_all": F.sum("p").over(full),
        "_none": F.product(1 - F.col("p")).over(full),
    })
    scored = ranked.withColumn("_ef", F.round(1.25 * F.col("_sum") / (F.col("_k") + 0.25 * F.col("_all")), 12))
    best = scored.withColumn("_best", F.max(F.struct("_ef", (-F.col("_k")).alias("k"))).over(Window.partitionBy("s1")))
    chosen = best.filter((F.col("_k") <= -F.col("_best.k")) & (F.col("p") >= floor) & (F.col("_best._ef") > F.col("_none") * empty_bias))
    return chosen.select(*pairs.columns)


def _binomials(p: list[float]) -> list[np.ndarray]:
    """The distribution of the number of successes among the first k, for each k from 0."""
    out = [np.ones(1)]
    for x in p:
        out.append(np.append(out[-1] * (1 - x), 0.0) + np.append(0.0, out[-1] * x))
    return out


def exact_prefix(p: list[float], empty_bias: float = 1.0) -> int:
    """How many of the probabilities, falling, to take for the best exact expected F0.5."""
    best, size = math.prod(1 - x for x in p) * empty_bias, 0
    hits, misses = _binomials(p), _binomials(p[::-1])[::-1]
    for k in range(1, len(p) + 1):
        hit, miss = hits[k], misses[k]
        a, b = np.arange(1, k + 1)[:, None], np.arange(len(miss))[None, :]
        value = float((hit[1:, None] * miss[None, :] * 1.25 * a / (1.25 * a + 0.25 * b + (k - a))).sum())
        if value > best + 1e-12:
            best, size = value, k
    return size


def exact_expected_f(pairs: DataFrame, least: float = 0.02, most: int = 24, empty_bias: float = 1.0) -> DataFrame:
    """As expected_f, exact by the Poisson-binomial distribution, over an s1's best ``most`` pairs from ``least``."""
    order = Window.partitionBy("s1").orderBy(F.desc("p"), "src", "tgt")
    top = pairs.filter(F.col("p") >= least).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)

    @F.pandas_udf("int")
    def prefix(p: pd.Series) -> pd.Series:
        return p.map(lambda x: exact_prefix(list(x), empty_bias))

    # At most ``most`` pairs meet in a row, so one Arrow batch serves many entities.
    falling = F.array_sort(F.collect_list(F.struct("_k", *[c for c in pairs.columns if c != "s1"])))
    lists = top.groupBy("s1").agg(falling.alias("x")).withColumn("n", prefix(F.transform("x", lambda r: r["p"])))
    chosen = lists.select("s1", F.explode(F.slice("x", F.lit(1), F.col("n"))).alias("x"))
    return chosen.select(*[F.col("s1") if c == "s1" else F.col(f"x.{c}") for c in pairs.columns])


def same_address_boost(pairs: DataFrame, lift: float = 0.5, alike: float = 80.0) -> DataFrame:
    """p becomes lift + (1 - lift) * p where addresses are equal and names alike (columns same_addr, name_sim)."""
    near = F.col("same_addr") & (F.col("name_sim") >= alike)
    return pairs.withColumn("p", F.when(near, lift + (1 - lift) * F.col("p")).otherwise(F.col("p")))


def mark_same_address(pairs: DataFrame, first: DataFrame, targets: DataFrame) -> DataFrame:
    """``pairs`` (s1, src, tgt, …) with same_addr and name_sim, from first (id, addr_n, name_f) and targets (src, id, …).

    Records are joined by the pair's keys and held against each other by a residual condition: equal addresses that
    aren't empty. Only names of those are compared; other pairs have name_sim 0.
    """
    a = first.select(F.col("id").alias("s1"), F.col("addr_n").alias("_a1"), F.col("name_f").alias("_n1"))
    b = targets.select("src", F.col("id").alias("tgt"), F.col("addr_n").alias("_a2"), F.col("name_f").alias("_n2"))
    key = ["s1", "src", "tgt"]
    same = pairs.select(*key).distinct().join(a, "s1").join(b, ["src", "tgt"]).filter((F.col("_a1") == F.col("_a2")) & (F.col("_a1") != ""))
    same = same.select(*key, F.lit(True).alias("same_addr"), token_set_ratio(F.col("_n1"), F.col("_n2")).alias("name_sim"))
    return pairs.join(same, key, "left").fillna(False, ["same_addr"]).fillna(0.0, ["name_sim"])


def replace_groups(decided: DataFrame, again: DataFrame, groups: list[str], key: str = "country") -> DataFrame:
    """Rows of ``groups`` from ``again``, others as they were."""
    return decided.filter(~F.col(key).isin(groups)).unionByName(again.filter(F.col(key).isin(groups)))


def threshold_grid(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(t, s1, src, tgt): every threshold's decisions in one pass."""
    return pairs.withColumn("t", F.explode(F.array(*[F.lit(t) for t in thresholds]))).filter(F.col("p") >= F.col("t"))


def by_config(pairs: DataFrame, config) -> DataFrame:
    """The rule that a ``Decision`` names: exclusive first, where it says so, then a threshold or expected F0.5."""
    kept = exclusive(pairs) if config.excl else pairs
    if config.rule == "ef":
        return expected_f(kept, config.floor, config.empty_bias)
    if config.rule == "thr":
        return threshold(kept, config.t)
    raise ValueError(f"unknown rule: {config.rule}")


#: The grid of decisions that is tuned over.
THRESHOLDS = (0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
FLOORS, BIASES = (0.3, 0.4, 0.5, 0.6), (1.0, 1.3, 1.6)

#: Rows that are tallied together; an entity with more is tallied whole.
TOGETHER = 1 << 17


def config_grid(pairs: DataFrame, thresholds=THRESHOLDS, floors=FLOORS, biases=BIASES) -> DataFrame:
    """(excl, rule, x, bias, s1, src, tgt): the pairs that every configuration chooses, in one job.

    ``x`` is the threshold or the floor. Pairs below half the least floor and below the least threshold go at once. Ranks
    and sums are made once for each floor, and biases share them.
    """
    best = Window.partitionBy("src", "tgt").orderBy(F.desc("p"), "s1")
    alone = pairs.withColumn("_first", F.row_number().over(best) == 1)
    modes = F.explode(F.when(F.col("_first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("excl")
    both = alone.filter(F.col("p") >= min([*thresholds, *(f / 2 for f in floors)])).select("s1", "src", "tgt", "p", modes)
    column = lambda values: F.explode(F.array(*[F.lit(float(v)) for v in values]))
    cut = both.withColumn("x", column(thresholds)).filter("p >= x").select("excl", F.lit("thr").alias("rule"), "x", F.lit(1.0).alias("bias"), "s1", "src", "tgt")
    # excl and x stand beside s1 as one entity, so that the rule itself is the one above
    entity = F.struct("excl", F.col("x").alias("x"), "s1")
    parts = both.withColumn("x", column(floors)).filter(F.col("p") >= F.col("x") / 2).withColumn("s1", entity).select("s1", "src", "tgt", "p")
    order = Window.partitionBy("s1").orderBy(F.desc("p"), "src", "tgt")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = parts.withColumns({
        "_k": F.row_number().over(order),
        "_sum": F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_all": F.sum("p").over(every),
        "_none": F.product(1 - F.col("p")).over(every),
    }).withColumn("_ef", F.round(1.25 * F.col("_sum") / (F.col("_k") + 0.25 * F.col("_all")), 12))
    met = ranked.withColumn("_best", F.max(F.struct("_ef", (-F.col("_k")).alias("k"))).over(Window.partitionBy("s1")))
    kept = met.filter((F.col("_k") <= -F.col("_best.k")) & (F.col("p") >= F.col("s1.x"))).withColumn("bias", column(biases))
    ef = kept.filter(F.col("_best._ef") > F.col("_none") * F.col("bias")).select("s1.excl", F.lit("ef").alias("rule"), "s1.x", "bias", "s1.s1", "src", "tgt")
    return cut.unionByName(ef)


def _tally(p: np.ndarray, link: np.ndarray, n_true: np.ndarray, thresholds, floors, biases) -> np.ndarray:
    """For entities with as many pairs each (rows of p, falling): by configuration sums of F, entities without links, and entities.

    Configurations go by threshold, then by floor and bias; an entity counts where it has a prediction.
    """
    out = []

    def add(n: np.ndarray, tp: np.ndarray) -> None:
        some = n > 0
        f = np.divide(1.25 * tp, 1.25 * tp + 0.25 * (n_true - tp) + n - tp, out=np.zeros(len(n)), where=some)
        out.append((f.sum(), (some & (n_true == 0)).sum(), some.sum()))

    for t in thresholds:
        took = p >= t
        add(took.sum(1), (took & link).sum(1))
    k, rows = np.arange(1, p.shape[1] + 1), np.arange(len(p))
    sums, misses = np.cumsum(p, axis=1), np.cumprod(1 - p, axis=1)
    for x in floors:
        within = p >= x / 2
        last = np.maximum(within.sum(1) - 1, 0)
        ef = np.where(within, np.round(1.25 * sums / (k + 0.25 * sums[rows, last][:, None]), 12), -np.inf)
        best = ef.argmax(1)
        took = within & (k <= best[:, None] + 1) & (p >= x)
        n, tp = took.sum(1), (took & link).sum(1)
        for bias in biases:
            better = ef[rows, best] > misses[rows, last] * bias
            add(n * better, tp * better)
    return np.array(out, dtype=np.float64)


def _tally_all(p: np.ndarray, first: np.ndarray, link: np.ndarray, start: np.ndarray, member: np.ndarray, grid) -> tuple[np.ndarray, int, int]:
    """Both modes' tallies of whole entities, which begin at ``start``; their number, and how many have links."""
    n_true = np.add.reduceat(link.astype(np.int64), start)
    mine = np.maximum.reduceat(member, start)
    entity = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(p))))
    total = []
    for mode in (~np.isnan(p), first & ~np.isnan(p)):
        mode = mode & mine[entity]
        q, yes, whose = p[mode], link[mode], entity[mode]
        counts = np.bincount(whose, minlength=len(start))
        at = np.cumsum(counts) - counts
        parts = [np.zeros((len(grid[0]) + len(grid[1]) * len(grid[2]), 3))]
        for c in np.unique(counts[counts > 0]):
            own = np.flatnonzero(counts == c)
            place = at[own][:, None] + np.arange(c)
            parts.append(_tally(q[place], yes[place], n_true[own], *grid))
        total.append(sum(parts))
    return np.concatenate(total), int(mine.sum()), int((mine & (n_true > 0)).sum())


def config_scores(pairs: DataFrame, truth: DataFrame, universe: DataFrame, thresholds=THRESHOLDS, floors=FLOORS, biases=BIASES) -> DataFrame:
    """(excl, rule, x, bias, macro_f): what ``evaluate.grid_scores`` makes of ``config_grid``, without a row for each choice.

    An entity's pairs meet once, sorted, and all configurations are tallied there. Pairs, of one row each, are dealt by
    target and then by entity; nothing is multiplied by the configurations.
    """
    grid = tuple([float(v) for v in values] for values in (thresholds, floors, biases))
    names = [("thr", t, 1.0) for t in grid[0]] + [("ef", x, b) for x in grid[1] for b in grid[2]]
    names = [(excl, *name) for excl in (False, True) for name in names]
    best = Window.partitionBy("src", "tgt").orderBy(F.desc("p"), "s1")
    alone = pairs.select("s1", "src", "tgt", "p").withColumn("first", F.row_number().over(best) == 1)
    alone = alone.filter(F.col("p") >= min([*grid[0], *(x / 2 for x in grid[1])]))
    no, yes, kinds = F.lit(False), F.lit(True), dict(pairs.dtypes)
    none = {c: F.lit(None).cast(kinds[c]).alias(c) for c in ("src", "tgt", "p")}
    rows = alone.select("s1", "src", "tgt", "p", "first", no.alias("link"), no.alias("member"))
    rows = rows.unionByName(truth.select("s1", "src", "tgt", none["p"], no.alias("first"), yes.alias("link"), no.alias("member")))
    rows = rows.unionByName(universe.select("s1", *none.values(), no.alias("first"), no.alias("link"), yes.alias("member")))
    met = rows.filter("s1 IS NOT NULL").repartition("s1").groupBy("s1", "src", "tgt").agg(*[F.max(c).alias(c) for c in ("p", "first", "link", "member")])
    falling = met.sortWithinPartitions("s1", F.desc_nulls_last("p"), "src", "tgt").select("s1", F.col("p").cast("double").alias("p"), "first", "link", "member")

    def tally(batches):
        total, n, linked, held = np.zeros((len(names), 3)), 0, 0, []

        def work(whole: list, ended: bool):
            """Tally all entities that are whole, and give back the rest."""
            table = pa.Table.from_batches(whole).combine_chunks()
            s1 = table["s1"].combine_chunks()
            start = np.append(0, 1 + np.flatnonzero(pc.not_equal(s1[1:], s1[:-1]).to_numpy(zero_copy_only=False)))
            until = len(table) if ended else int(start[-1])
            start = start[start < until]
            if until:
                column = lambda c: table[c].slice(0, until).to_numpy()
                found = _tally_all(column("p").astype(np.float64), *[column(c).astype(bool) for c in ("first", "link")], start, column("member").astype(bool), grid)
            else:
                found = (0, 0, 0)
            return found, table.slice(until).to_batches()

        size, enough = 0, TOGETHER
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= enough:
                (more, a, b), held = work(held, False)
                total, n, linked, size = total + more, n + a, linked + b, sum(x.num_rows for x in held)
                enough = max(TOGETHER, 2 * size)  # an entity of many pairs isn't looked through again and again
        if held:
            (more, a, b), held = work(held, True)
            total, n, linked = total + more, n + a, linked + b
        yield pa.RecordBatch.from_pydict({"c": pa.array(range(len(names)), pa.int32()), "f": total[:, 0], "wrong": total[:, 1], "some": total[:, 2], "n": [float(n)] * len(names), "linked": [float(linked)] * len(names)})

    sums = falling.mapInArrow(tally, "c int, f double, wrong double, some double, n double, linked double").groupBy("c").agg(*[F.sum(x).alias(x) for x in ("f", "wrong", "some", "n", "linked")])
    config = F.array(*[F.struct(F.lit(e).alias("excl"), F.lit(r).alias("rule"), F.lit(x).alias("x"), F.lit(b).alias("bias")) for e, r, x, b in names])
    scored = sums.filter("some > 0").withColumn("k", F.get(config, F.col("c")))
    return scored.select("k.*", F.try_divide(F.col("f") + F.col("n") - F.col("linked") - F.col("wrong"), F.col("n")).alias("macro_f"))
