"""Shared building blocks: tables, lineage cuts, identifiers, ranks, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..scratch import cut as cut
from ..shipping import ship

FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
HALF_WIDTH = "".join(chr(0x21 + i) for i in range(94)) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: A side of at most so many rows of a few numbers or short strings each is broadcast; some 20 MB.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` for the side of a join, as a broadcast where a count shows it to be small, else as it is (shuffled)."""
    return F.broadcast(df) if df.limit((rows or BROADCAST_ROWS) + 1).count() <= (rows or BROADCAST_ROWS) else df


def half_width(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def light_key(c: Column) -> Column:
    """Light id without case, width, separators and a `tl:` prefix; null when nothing is left."""
    x = F.regexp_replace(F.lower(half_width(c)), r"^[^a-z0-9]*[a-z]+:", "")
    x = F.regexp_replace(x, "[^a-z0-9]", "")
    return F.when(x != "", x)


def state_key(c: Column) -> Column:
    """State file without root folder, slash style, case, blanks and .xml/.gz endings."""
    x = F.regexp_replace(F.lower(half_width(c)), r"[\\/]+", "/")
    x = F.regexp_replace(x, r"^\s+|\s+$", "")
    x = F.regexp_replace(x, r"^.*outputs/states/", "")
    x = F.regexp_replace(x, r"(\.xml)?(\.gz)?$", "")
    return F.when(x != "", x)


def state_light(key: Column) -> Column:
    """The light a state file names (the part after its time)."""
    x = F.regexp_extract(key, r"state_[0-9-]+_t[0-9-]+_(.+)$", 1)
    return F.when(x != "", light_key(x))


def slices_for(rows: int) -> int:
    """A power of two of slices (64 at least) that keeps a slice of a group of all `rows` rows near 50,000."""
    return max(64, 1 << max(0, rows // 50_000).bit_length())


def dense_in_groups(df: DataFrame, keys: list[str], order: str, rank: str, slices: int = 1024, weight: str | None = None) -> DataFrame:
    """Add the running rank (or running sum of `weight`, exclusive) of each row in its group by `order`, a column
    of uniform hashes in [0, 2^62). A group is ranked in `slices` pieces by the hash, so no task holds a whole group.

    Ties in `order` fall in one slice; the caller makes `order` unique by adding the id column named `__id`.
    """
    width = (1 << 62) // slices
    cut_ = df.withColumn("__slice", F.expr(f"cast({order} div {width} as int)"))
    amount = F.col(weight) if weight else F.lit(1).cast("bigint")
    sums = cut_.groupBy(*keys, "__slice").agg(F.sum(amount).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0).cast("bigint")).alias("__before"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]) & (F.col("__slice") == F.col("__s"))
    inner = W.partitionBy(*keys, "__slice").orderBy(order, "__id")
    run = F.sum(amount).over(inner.rowsBetween(W.unboundedPreceding, -1))
    ranked = cut_.withColumn("__in", F.coalesce(run, F.lit(0).cast("bigint")))
    return ranked.join(offsets, on).withColumn(rank, F.col("__before") + F.col("__in")).drop("__slice", "__in", "__s", "__before", *[f"__k{i}" for i in range(len(keys))])


def smallest(df: DataFrame, keys: list[str], order: str, wanted: DataFrame, slices: int = 1024) -> DataFrame:
    """The rows of `df` among the `quota` smallest of their group by `order`, a column of uniform hashes in [0, 2^62),
    for every row of `wanted` (keys, quota and further columns, which are added); ties go to the smaller `__id`.

    Counts by slice of the hash tell the slice in which a quota ends: slices below are taken as they are, only the rows
    of that one are ranked, so neither a task nor a sort holds a whole group."""
    width = (1 << 62) // slices
    cut_ = df.withColumn("__slice", F.expr(f"cast({order} div {width} as int)"))
    sums = cut_.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("bigint")))
    asked = wanted.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in wanted.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    plan = sums.join(F.broadcast(asked), on).where("__before < quota").drop(*[f"__k{i}" for i in range(len(keys))])
    far = plan.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slice").alias("__s"), *[c for c in plan.columns if c not in keys and c != "__slice"])
    got = cut_.join(small(far), on & (F.col("__slice") == F.col("__s"))).drop("__s", *[f"__k{i}" for i in range(len(keys))])
    others = [c for c in asked.columns if not c.startswith("__k") and c != "quota"]
    sure = got.where("__before + __n <= quota")
    rank = F.row_number().over(W.partitionBy(*keys, *others, "__slice").orderBy(order, "__id"))
    edge = got.where("__before + __n > quota").withColumn("__in", rank).where("__before + __in <= quota").drop("__in")
    return sure.union(edge).drop("__slice", "__n", "__before")


def uniform_hash(*cols: Column) -> Column:
    """Uniform in [0, 2^62); the same for the same values whatever the partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v), root being the smallest node of its component.

    Alternates large-star and small-star steps; each is two hash aggregations and a join on the node, so a hot node
    is pre-aggregated and its edges can be split. Every round is written to the checkpoint folder and only a count and
    a checksum reach the driver. Null ends are ignored; an empty input gives an empty result.
    """
    both = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    cur = cut(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = _fingerprint(cur)
    for _ in range(max_rounds):
        if last[0] == 0:
            break
        sym = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        cur = cut(small.where("u <> v").distinct())
        now = _fingerprint(cur)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v"), F.col("v")).distinct())
