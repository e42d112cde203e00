"""One global ranking from pairwise comparisons, robust against contradictory ones.

Comparisons are summed to one margin (log odds of the wins) an edge; strengths minimise the
weighted absolute misfit of the margins, by iteratively reweighted Laplacian solves: an edge that
contradicts the strengths found so far loses weight. A weak prior towards 0 anchors components
that no comparison connects.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpoint

#: Up to so many summed edges, about 100 MB, are solved on the driver; beyond, by joins, to the same end.
EDGES = 2_000_000
#: Reweighting rounds at most, and the change of any strength at which they end.
ROUNDS, TOLERANCE = 1000, 1e-6
PRIOR, FLOOR = 0.02, 0.05


def edges(met: DataFrame) -> DataFrame:
    """(a, b, n, margin, weight) with a < b, from (left, right, n, w): n scored comparisons of which left won w, ties counting half.

    Null systems, pairs without a score and comparisons of a system with itself are dropped.
    """
    clean = met.filter((F.col("left") != F.col("right")) & (F.col("n") > 0))
    flip = F.col("left") > F.col("right")
    summed = clean.select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), "n", F.when(flip, F.col("n") - F.col("w")).otherwise(F.col("w")).alias("w")).groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    won, lost = F.col("w") + 0.5, F.col("n") - F.col("w") + 0.5
    return summed.select("a", "b", "n", F.log(won / lost).alias("margin"), (1 / (1 / won + 1 / lost)).alias("weight"))


def _conjugate(apply: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, b: np.ndarray, x: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """The solution of a positive definite system by conjugate gradients, preconditioned with its diagonal and begun at x; raises if it isn't reached."""
    r = b - apply(x)
    z = r / diagonal
    p, rho = z, r @ z
    least = tolerance * max(1e-30, float(np.sqrt(b @ b)))
    for _ in range(10 * len(b) + 100):
        if np.sqrt(r @ r) <= least:
            return x
        q = apply(p)
        alpha = rho / (p @ q)
        x, r = x + alpha * p, r - alpha * q
        z = r / diagonal
        rho, before = r @ z, rho
        p = z + (rho / before) * p
    raise ArithmeticError("conjugate gradients did not converge")


def solve(count: int, i: np.ndarray, j: np.ndarray, margin: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Strengths of systems 0 to count - 1 from the margins of i over j: Laplacian solves over the sparse edges, reweighted until no strength changes. Warns if some still do after `rounds`."""
    theta, weight = np.zeros(count), np.sqrt(weight)
    if not len(i):
        return theta
    moved = 0.0
    for _ in range(rounds):
        u = weight / np.maximum(np.abs(margin - theta[i] + theta[j]), FLOOR)
        diagonal = PRIOR + np.bincount(i, u, count) + np.bincount(j, u, count)

        def apply(x: np.ndarray, u: np.ndarray = u, diagonal: np.ndarray = diagonal) -> np.ndarray:
            return diagonal * x - np.bincount(i, u * x[j], count) - np.bincount(j, u * x[i], count)

        new = _conjugate(apply, diagonal, np.bincount(i, u * margin, count) - np.bincount(j, u * margin, count), theta)
        moved, theta = np.abs(new - theta).max(), new
        if moved < TOLERANCE:
            return theta
    warnings.warn(f"strengths still change by {moved:.1e} after {rounds} rounds", stacklevel=2)
    return theta


def _components(systems: DataFrame, both: DataFrame) -> DataFrame:
    """(system, component): the least system of each connected component, passed on from neighbour to neighbour until nothing changes."""
    known = checkpoint(systems.select("system", F.col("system").alias("component")))
    while True:
        near = both.select(F.col("a").alias("system"), "b").join(known.withColumnRenamed("system", "b"), "b").groupBy("system").agg(F.min("component").alias("least"))
        new = checkpoint(known.join(near, "system", "left").select("system", F.least("component", "least").alias("component"), (F.col("least") < F.col("component")).alias("_new")))
        known = new.select("system", "component")
        if new.filter("_new").isEmpty():
            return known


def solve_joined(systems: DataFrame, found: DataFrame, sweeps: int = 2000, tolerance: float = 1e-5) -> DataFrame:
    """The same by Jacobi sweeps over joins, each with the weights of the strengths before it; (system, strength). Raises if the strengths haven't settled after so many sweeps."""
    both = checkpoint(found.select("a", "b", "margin", "weight").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("margin")).alias("margin"), "weight")))
    theta = checkpoint(systems.select("system", F.lit(0.0).alias("strength")))
    for _ in range(sweeps):
        other = theta.withColumnRenamed("system", "b").withColumnRenamed("strength", "tb")
        own = theta.withColumnRenamed("system", "a").withColumnRenamed("strength", "ta")
        u = F.sqrt("weight") / F.greatest(F.abs(F.col("margin") - F.col("ta") + F.col("tb")), F.lit(FLOOR))
        held = both.join(own, "a").join(other, "b").withColumn("u", u).groupBy("a").agg(F.sum("u").alias("d"), F.sum(F.col("u") * (F.col("margin") + F.col("tb"))).alias("s"))
        # half a step: full ones swing on bipartite graphs
        step = 0.5 * F.col("strength") + 0.5 * F.col("s") / (F.col("d") + F.lit(PRIOR))
        new = checkpoint(theta.join(held.withColumnRenamed("a", "system"), "system", "left").select("system", F.coalesce(step, F.lit(0.0)).alias("new"), "strength"))
        moved = new.agg(F.max(F.abs(F.col("new") - F.col("strength")))).first()[0] or 0.0
        theta = new.select("system", F.col("new").alias("strength"))
        if moved < tolerance:
            # the solution's strengths add up to 0 in each component, but the weak prior draws them there too slowly
            placed = checkpoint(theta.join(_components(systems, both), "system"))
            mean = placed.groupBy("component").agg(F.avg("strength").alias("_mean"))
            return placed.join(mean, "component").select("system", (F.col("strength") - F.col("_mean")).alias("strength"))
    raise ArithmeticError(f"strengths still change by {moved:.1e} after {sweeps} sweeps")


def rank(outcomes: DataFrame, most: int = EDGES) -> DataFrame:
    """(system, strength, comparisons, rank_no) of every system of outcomes (left, right, score); rank 1 is the strongest, equal strengths go by name.

    Systems that only occur in rows without a score get the prior's strength 0. An empty table gives none.
    Up to `most` edges and systems are solved and ranked on the driver, more by joins.
    """
    spark, schema = outcomes.sparkSession, "system string, strength double, comparisons bigint, rank_no int"
    met = checkpoint(outcomes.groupBy("left", "right").agg(F.count("score").alias("n"), F.sum("score").alias("w")))
    systems = met.select(F.explode(F.array("left", "right")).alias("system")).filter("system is not null").distinct()
    found = edges(met)
    few = found.limit(most + 1).toPandas()
    names = [r[0] for r in systems.limit(most + 1).collect()] if len(few) <= most else []
    if len(few) <= most and len(names) <= most:
        names.sort()
        at = {n: k for k, n in enumerate(names)}
        i, j = (few[c].map(at).to_numpy(np.int64, na_value=0) for c in ("a", "b"))
        theta = solve(len(names), i, j, few["margin"].to_numpy(float), few["weight"].to_numpy(float))
        counts = np.bincount(i, few["n"], len(names)) + np.bincount(j, few["n"], len(names)) if len(few) else np.zeros(len(names))
        order = sorted(range(len(names)), key=lambda k: (-theta[k], names[k]))
        return spark.createDataFrame([(names[k], float(theta[k]), int(counts[k]), place) for place, k in enumerate(order, 1)], schema)
    found = checkpoint(found)
    strength = solve_joined(checkpoint(systems), found)
    counts = found.select(F.explode(F.array("a", "b")).alias("system"), "n").groupBy("system").agg(F.sum("n").alias("comparisons"))
    joined = checkpoint(strength.join(counts, "system", "left").select("system", "strength", F.coalesce("comparisons", F.lit(0)).alias("comparisons")))
    # the place is the number of stronger systems: counted over ranges, so that no task holds all systems of a long list
    ordered = joined.repartitionByRange(F.desc("strength"), F.asc("system")).sortWithinPartitions(F.desc("strength"), F.asc("system"))
    part = checkpoint(ordered.withColumn("_p", F.spark_partition_id()))
    before, total = {}, 0
    for r in sorted(part.groupBy("_p").count().collect(), key=lambda r: r["_p"]):
        before[r["_p"]] = total
        total += r["count"]
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("_p")]
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("strength"), F.asc("system")))
    return part.select("system", "strength", "comparisons", (place + offset).cast("int").alias("rank_no"))
