"""Containment of points in spans as equality joins on dyadic tiles (survey F6, J21, J22).

A tile (k, i) covers the positions from i * 2^k up to (i + 1) * 2^k. A half-open span is the union of at most two tiles a
level, none inside another; a point lies in one tile of each level. So a point is inside a span exactly if they share one
tile, and they share no second. A file with very many spans and points is as many join keys as it has tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def span_tiles(start: Column, end: Column) -> Column:
    """The tiles (k, tile) of a span; none for an empty one or where an end is null."""
    a, b = start.cast("long"), end.cast("long")
    shift = lambda x, k: F.call_function("shiftright", x, k)

    def of_level(k: Column) -> Column:
        # the whole tiles of the level are those from low to before high; pairs of them are tiles of the next level
        low, high = -shift(-a, k), shift(b, k)
        tile = lambda i: F.struct(k.alias("k"), i.alias("tile"))
        inside = low < high
        left = F.when(inside & (low.bitwiseAND(1) == 1), tile(low))
        right = F.when(inside & (high.bitwiseAND(1) == 1), tile(high - 1))
        return F.array(left, right)

    last = F.floor(F.log2((b - a).cast("double"))).cast("int") + 1
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.least(last, F.lit(62))), of_level))
    return F.when(a < b, F.filter(every, lambda t: t.isNotNull()))


#: Spans with their edge in one tile beyond which dyadic tiles take the place of comparisons.
CROWDED = 10_000


def level_of(start: Column, end: Column) -> Column:
    """The level whose tiles are about as wide as a span."""
    return F.floor(F.log2((end.cast("long") - start.cast("long")).cast("double"))).cast("int")


def covered(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Each span once for each tile of its level that it touches, three at most, in columns _level and _tile."""
    level, own = level_of(F.col(start), F.col(end)), spans.filter(F.col(start) < F.col(end))
    own = own.withColumns({"_level": level, "_a": F.col(start).cast("long"), "_b": F.col(end).cast("long") - 1})
    return own.select("*", F.explode(F.sequence(F.expr("shiftright(_a, _level)"), F.expr("shiftright(_b, _level)"))).alias("_tile")).drop("_a", "_b")


def levels_of(tiled: DataFrame) -> list[int]:
    """The levels of a table of tiles; at most 63."""
    return sorted(r["_level"] for r in tiled.select("_level").distinct().collect())


def point_tiles(at: Column, levels: list[int]) -> Column:
    """The tiles of a point on some levels."""
    if not levels:
        return F.array().cast("array<struct<k:int,tile:bigint>>")
    return F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(at.cast("long"), k).alias("tile")) for k in levels])


def tiled(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Each span once for each of its tiles, in columns _level and _tile."""
    return spans.select("*", F.inline(span_tiles(F.col(start), F.col(end))).alias("_level", "_tile"))


def around(points: DataFrame, at: Column, levels: list[int]) -> DataFrame:
    """Each point once for each of its tiles on ``levels``, in columns _point_level and _point_tile."""
    return points.select("*", F.inline(point_tiles(at, levels)).alias("_point_level", "_point_tile"))


def meet() -> Column:
    """Whether a tiled span and a tiled point share their tile."""
    return (F.col("_level") == F.col("_point_level")) & (F.col("_tile") == F.col("_point_tile"))
