"""Synthetic graphs.  Every arc is a function of its number and the seed, so any executor can make any part again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.functions.bits import scramble, uniform
from grafonda.operators.graph import Graph

#: Quadrant probabilities A, B and C of the two presets, in ten-thousandths (fixed values).
RMAT1, RMAT2 = (5700, 1900, 1900), (5000, 1000, 1000)


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, *, abc: tuple[int, int, int] = RMAT1, seed: int = 12345, noise: float = 0.0, mix_ids: bool = True, flip: bool = False) -> DataFrame:
    """(src, dst) of edge_factor * 2^scale arcs: each picks a quadrant `scale` times; noise varies the probabilities by level.

    With `flip`, an arc whose ends are still equal takes the lower left quadrant for the
    upper right one, so that no arc lies above the diagonal before ids are mixed.
    """
    edges = spark.range(edge_factor << scale)
    src, dst, equal = F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(True)  # equal: whether the ends so far are
    for level in range(scale):
        share = [x / 10_000 for x in (*abc, 10_000 - sum(abc))]
        a, b, c = (F.lit(x) for x in share[:3])
        if noise:  # all four shares vary, and are scaled to add up to 1 again
            raw = [x * (1 + noise * (2 * uniform(seed + 1 + k, F.lit(level), "id") - 1)) for k, x in enumerate(share)]
            a, b, c = (x / (raw[0] + raw[1] + raw[2] + raw[3]) for x in raw[:3])
        roll = uniform(seed, "id", F.lit(level))
        low, right = roll >= a + b, ((roll >= a) & (roll < a + b)) | (roll >= a + b + c)
        if flip:  # in the upper right quadrant while the ends are equal: its mirror image
            above, diagonal = equal & right & ~low, low == right
            low, right, equal = low | above, right & ~above, equal & diagonal
        src, dst = src * 2 + low.cast("bigint"), dst * 2 + right.cast("bigint")
    out = edges.select(src.alias("src"), dst.alias("dst"))
    if mix_ids:
        out = out.select(scramble(F.col("src"), scale, seed).alias("src"), scramble(F.col("dst"), scale, seed).alias("dst"))
    return out


def kronecker(spark: SparkSession, scale: int, edge_factor: int = 16, *, seed: int = 12345) -> DataFrame:
    """R-MAT with clip and flip at every level, before ids are mixed, so the arcs read as undirected."""
    return rmat(spark, scale, edge_factor, seed=seed, flip=True)


def rmat_lower(spark: SparkSession, scale: int, edge_factor: int = 16, *, seed: int = 12345) -> DataFrame:
    """R-MAT with a tenth of noise, the lower triangle without self-loops."""
    return rmat(spark, scale, edge_factor, seed=seed, noise=0.1, mix_ids=False).where("src > dst")


def rmat_unique(spark: SparkSession, scale: int, n_edges: int, *, seed: int = 12345, max_rounds: int = 50) -> DataFrame:
    """n_edges different arcs: rounds of twice what is missing, without repeats, until there are enough."""
    found = None
    for number in range(max_rounds):
        factor = max(1, -(-2 * n_edges // (1 << scale)))
        more = rmat(spark, scale, factor, seed=seed + 1000 * number)
        found = more.distinct() if found is None else found.union(more).distinct()
        if found.count() >= n_edges:
            return found.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(n_edges)
    raise ValueError("the graph is too small for so many different arcs")


def erdos_renyi(spark: SparkSession, n: int, p: float, *, seed: int = 1, loops: bool = False) -> Graph:
    """Each ordered pair with probability p, found by geometric skips: rows grow with the arcs, not with the pairs."""
    import math

    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    stride, draws = max(1, round(64 / p)), 160  # pairs per row: 64 arcs on average; rows with more than the draws go on
    todo = spark.range(-(-n * n // stride)).select("id", F.lit(-1).cast("bigint").alias("at"))
    drawn, done = None, 0
    while drawn is None or todo.take(1):
        gaps = F.transform(F.sequence(F.lit(done + 1), F.lit(done + draws)), lambda i: (F.floor(F.log(1 - uniform(seed, "id", i)) / math.log1p(-p)) + 1).cast("bigint"))
        sums = F.aggregate(gaps, F.array("at"), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g)))
        placed = todo.select("id", F.slice(sums, 2, draws).alias("sums"))
        found = placed.select("id", F.explode(F.filter("sums", lambda x: x < stride)).alias("offset"))
        drawn = found if drawn is None else drawn.union(found)
        todo = placed.where(F.element_at("sums", -1) < stride).select("id", F.element_at("sums", -1).alias("at"))
        done += draws
    pair = drawn.select((F.col("offset") + F.col("id") * stride).alias("pair")).where(F.col("pair") < n * n)
    edges = pair.select(F.floor(F.col("pair") / n).alias("src"), (F.col("pair") % n).alias("dst"))
    return Graph(spark.range(n), edges if loops else edges.where("src <> dst"))


def small_world(spark: SparkSession, n: int, k: int, p: float, *, seed: int = 1) -> Graph:
    """A ring in which each vertex has arcs to its k/2 next ones on either side, the far end moved with probability p."""
    offsets = F.explode(F.array(*[F.lit(d) for i in range(1, k // 2 + 1) for d in (i, -i)]))
    ring = spark.range(n).select(F.col("id").alias("src"), offsets.alias("d"))
    moved = F.floor(uniform(seed + 1, "src", "d") * n).cast("bigint")
    dst = F.when(uniform(seed, "src", "d") < p, moved).otherwise(F.pmod(F.col("src") + F.col("d"), F.lit(n)))
    return Graph(spark.range(n), ring.select("src", dst.alias("dst")))


def mesh(spark: SparkSession, x: int, y: int, torus: bool = False) -> Graph:
    """x by y grid with arcs to the four neighbours, around the edges if torus."""
    cell = spark.range(x * y).select("id", (F.col("id") % x).alias("i"), F.floor(F.col("id") / x).alias("j"))
    near = cell.select("id", F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("to"))
    if torus:
        i, j = F.pmod(F.col("to.i"), F.lit(x)), F.pmod(F.col("to.j"), F.lit(y))
    else:
        i, j = F.col("to.i"), F.col("to.j")
        near = near.where((i >= 0) & (i < x) & (j >= 0) & (j < y))
    return Graph(spark.range(x * y), near.select(F.col("id").alias("src"), (j * x + i).cast("bigint").alias("dst")))
