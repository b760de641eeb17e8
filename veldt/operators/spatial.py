"""Bounding-volume queries as joins: overlap by grid cells, nearest by pruned distance bounds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators.lineage import cut


#: A ball goes to at most so many cells of a level; wider ones go to the next, coarser level.
SPREAD = 4
#: Part of its radius, and of its coordinates, by which a ball is taken for wider when cells are looked up.
RIM = 1e-12
#: Points that a query meets in its own cell, on average over queries and points; in more crowded grids cells are narrowed.
CROWD = 4
#: A cell of queries around which more points lie is cut into narrower cells of its own.
CROWDED = 4096
#: Up to so many places, or cells of queries, are broadcast (tens of MB); more are shuffled.
HELD = 1 << 17
#: No cell is narrower than this part of the largest coordinate, so that rounding moves no point by more than a millionth of a cell; distances below this part of a cell's width are surely within its neighbours.
FINEST, SURE = 1e-9, 1 - 1e-6


def overlapping_pairs(left: DataFrame, right: DataFrame, axes: list[str], cell: float, key: str = "id", radius: str = "r", test: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(left key, right key) of balls that touch: balls go to the grid cells they cover, meet by cell, and count once.

    A pair is kept only in the smallest cell that both cover, so no distinct is needed. Cells
    are looked up for balls wider by RIM, so that rounding parts none that touch at the rim; the
    test itself is on the given radii, whose sum is squared in their own type (decimals exactly).
    Balls wider than SPREAD cells aren't spread over fine cells: both sides meet again on the level
    of the wider one, cells of which are 4 ** level times as wide. test(a, b), on the keys, replaces
    nothing: it is a further test of pairs whose balls touch.
    """

    def levelled(df: DataFrame, name: str, tail: str, r: str) -> DataFrame:
        width = F.greatest(F.col(radius) * 2 / (SPREAD * cell), F.lit(1.0))
        return df.select(F.col(key).alias(name), *[F.col(x).alias(f"{x}{tail}") for x in axes], F.col(radius).alias(r), F.ceil(F.log(4.0, width) - 1e-9).cast("int").alias(f"level{tail}"))

    def edge(x: str, tail: str, r: str, side: int, size: float) -> Column:
        at = F.col(f"{x}{tail}").cast("double")
        return F.floor((at + side * (F.col(r).cast("double") * (1 + RIM) + F.abs(at) * RIM)) / size)

    a, b = levelled(left, "a", "", "ra"), levelled(right, "b", "2", "rb")
    tops = [df.agg(F.max(c)).first()[0] for df, c in ((a, "level"), (b, "level2"))]
    if None in tops:
        return a.select("a").join(b.select("b").where("false"), F.lit(False)).select("a", "b")
    out = None
    for level in range(max(tops) + 1):
        size = cell * 4.0**level
        one, two = a.where(F.col("level") <= level), b.where(F.col("level2") <= level)
        for x in axes:
            one = one.withColumn(f"_c{x}", F.explode(F.sequence(*(edge(x, "", "ra", s, size) for s in (-1, 1)))))
            two = two.withColumn(f"_c{x}", F.explode(F.sequence(*(edge(x, "2", "rb", s, size) for s in (-1, 1)))))
        joined = one.join(two, [f"_c{x}" for x in axes]).where(F.greatest("level", "level2") == level)
        gap = reduce(lambda s, t: s + t, [(F.col(x) - F.col(f"{x}2")) * (F.col(x) - F.col(f"{x}2")) for x in axes])
        first = reduce(lambda s, t: s & t, [F.col(f"_c{x}") == F.greatest(edge(x, "", "ra", -1, size), edge(x, "2", "rb", -1, size)) for x in axes])
        found = joined.where(first & (gap <= (F.col("ra") + F.col("rb")) * (F.col("ra") + F.col("rb")))).select("a", "b")
        out = found if out is None else out.unionByName(found)
    return out if test is None else out.where(test(F.col("a"), F.col("b")))


def within(df: DataFrame, axes: list[str], point: list[float], reach: float, radius: Column | None = None) -> DataFrame:
    """Balls (or points) that a ball about `point` touches: a range filter first, then the exact test."""
    r = radius if radius is not None else F.lit(0.0)
    gap = reduce(lambda s, t: s + t, [(F.col(a) - p) * (F.col(a) - p) for a, p in zip(axes, point)])
    near = reduce(lambda s, t: s & t, [(F.abs(F.col(a) - p) <= reach + r) for a, p in zip(axes, point)])
    return df.where(near & (gap <= (reach + r) * (reach + r)))


def nearest(queries: DataFrame, points: DataFrame, axes: list[str], cell: float, key: str = "id", value: Callable[[Column], Column] | None = None) -> DataFrame:
    """(a, b, distance): the nearest point of each query, ties to the smallest key.

    Points at one place stand for their smallest key. Queries are gathered into cells, of each
    only the box around its queries, and each box gets the list of all points that may be the
    nearest of some query in it: those no farther from the box than the least distance within
    which some point lies of all the box. A query then meets its cell's list, row by row, so the
    queries are never sorted, and shuffled once at most (not at all up to HELD cells). Crowded
    cells are narrowed to a quarter, again and again, until a query meets about CROWD points of
    its own cell; single cells that stay crowded are cut further. The queries are read several
    times. value(distance), increasing, is minimised instead where given. Queries without all
    coordinates have no nearest; a key of several rows gets the nearest of them all.
    """
    left, rows = _queries(queries, axes, key), _places(points, axes, key)
    out = _nearest_of_rows(left, rows, axes, cell)
    if (left.groupBy("a").count().agg(F.max("count")).first()[0] or 0) > 1:
        out = out.groupBy("a").agg(F.min(F.struct("distance", F.isnull("b"), "b")).alias("m")).select("a", "m.b", "m.distance")
    return out if value is None else out.withColumn("distance", value(F.col("distance")))


def _located(df: DataFrame, axes: list[str]) -> DataFrame:
    return df.where(reduce(lambda s, t: s & t, [F.col(x).isNotNull() & ~F.isnan(x) for x in axes]))


def _queries(df: DataFrame, axes: list[str], key: str) -> DataFrame:
    return _located(df, axes).select(F.col(key).alias("a"), *axes)


def _places(df: DataFrame, axes: list[str], key: str) -> DataFrame:
    return cut(_located(df, axes).groupBy(*axes).agg(F.min(key).alias("b")).select(*[F.col(x).alias(f"{x}2") for x in axes], "b"))


def _nearest_of_rows(left: DataFrame, rows: DataFrame, axes: list[str], cell: float) -> DataFrame:
    """(a, b, distance) for each row of left (a, axes); rows: the points (axes with a 2, b), at places all different.

    Boxes of queries look into the 3**d cells around theirs; a box whose bound is within one cell's
    width is sure to have all it needs there. The others go on with cells four times as wide. Of the
    points, too, only the boxes of cells are met at first, and those that may hold a nearest are gone
    down into, level by level. Bounds are computed as distances are, each step of which keeps its
    order when rounded, so that they hold for the rounded distances and ties aren't lost.
    """
    own, names = [f"_q{x}" for x in axes], [f"_c{x}" for x in axes]
    norm = lambda parts: F.sqrt(reduce(lambda s, t: s + t, [p * p for p in parts]))

    def gridded(df: DataFrame, to: list[str], width: float, tail: str = "") -> DataFrame:
        return df.withColumns({c: F.floor(F.col(f"{x}{tail}") / width) for c, x in zip(to, axes)})

    def bounds(df: DataFrame, low: str, high: str) -> DataFrame:
        """least, most: the distances between which all of the box and all of the other are."""
        lo, hi, start, end = ([F.col(f"{x}{tail}") for x in axes] for tail in (low, high, "_from", "_to"))
        gaps = [F.greatest(lo[k] - end[k], start[k] - hi[k], F.lit(0.0)) for k in range(len(axes))]
        return df.withColumns({"least": norm(gaps), "most": norm([F.greatest(hi[k] - start[k], end[k] - lo[k]) for k in range(len(axes))])})

    sizes = [df.agg(F.count("*"), *[F.max(F.abs(f"{x}{tail}")) for x in axes]).first() for df, tail in ((left, ""), (rows, "2"))]
    n_left, n_rows = sizes[0][0], sizes[1][0]
    if not n_left or not n_rows:
        return left.join(rows, F.lit(False)).select("a", "b", norm([F.col(x) - F.col(f"{x}2") for x in axes]).alias("distance"))
    finest = max(float(x) for row in sizes for x in row[1:]) * FINEST
    while cell < finest:
        cell *= 4
    held = F.broadcast if n_rows <= HELD else lambda df: df
    wide_box = reduce(lambda s, t: s | t, [F.col(f"{x}_from") < F.col(f"{x}_to") for x in axes])
    shift = 0
    while True:
        boxes = cut(gridded(left, own, cell).groupBy(*own).agg(F.count("*").cast("double").alias("m"), *[f(x).alias(f"{x}_{to}") for x in axes for f, to in ((F.min, "from"), (F.max, "to"))]))
        crowd = gridded(rows, own, cell, "2").groupBy(*own).agg(F.count("*").cast("double").alias("n"))
        met, n_boxes = boxes.join(held(crowd), own, "left").agg(F.sum(F.when(wide_box, F.col("m") * F.col("n"))), F.count("*")).first()
        if (met or 0) <= CROWD * (n_left + n_rows) or cell / 4 < finest:
            break
        cell, shift = cell / 4, 2
    # points go to cells four times as wide as the boxes' if those were narrowed
    grid = cell * 2**shift
    points = gridded(rows, names, grid, "2")
    small = F.broadcast if n_boxes <= HELD else lambda df: df
    parents = {f"_w{x}": F.shiftright(c, 2) for x, c in zip(axes, names)}
    box, met = [*own, *[f"{x}_{to}" for x in axes for to in ("from", "to")]], [F.min("most").alias("reach"), F.count("*").alias("met")]
    near = F.col("least") <= F.col("reach")

    def around(df: DataFrame, level: int) -> DataFrame:
        """Boxes with each cell of a level that touches the one they lie in."""
        for q, c in zip(own, names):
            at = F.shiftright(q, shift + 2 * level)
            df = df.withColumn(c, F.explode(F.sequence(at - 1, at + 1)))
        return df

    def with_points(df: DataFrame) -> DataFrame:
        return bounds(df.join(held(points), names), "2", "2")

    def down(df: DataFrame, level: int) -> DataFrame:
        """From cells of a level to those within them."""
        return bounds(df.withColumnsRenamed(dict(zip(names, parents))).join(held(levels[level - 1].withColumns(parents)), list(parents)), "_low", "_high")

    def tightened(df: DataFrame, tight: DataFrame) -> DataFrame:
        return df.drop("reach").join(small(tight), own).where(near)

    # levels[k]: the boxes of the points in cells 4 ** k times as wide
    todo, lists, crowded, levels = boxes.drop("m"), [], [], []
    for level in range(32):
        if level:
            finer = levels[-1].withColumns(parents).groupBy(*parents) if levels else points.groupBy(*names)
            ends = [f(f"{x}{tail if levels else '2'}").alias(f"{x}{tail}") for x in axes for f, tail in ((F.min, "_low"), (F.max, "_high"))]
            levels.append(cut(finer.agg(*ends).withColumnsRenamed(dict(zip(parents, names)))))
        first = around(todo, level)
        reach = (down(first, level) if level else with_points(first)).groupBy(*own).agg(*met).where(F.col("reach") <= grid * 4.0**level * SURE)
        seen = cut(todo.join(small(reach), own, "left"))
        sure, todo = seen.where("reach IS NOT NULL"), seen.where("reach IS NULL").select(*box)
        n_sure, n_all, most_met = seen.agg(F.count("reach"), F.count("*"), F.max("met")).first()
        if n_sure:
            if level:
                some = around(sure.drop("met"), level)
                for upper in range(level, 0, -1):
                    some = down(some, upper).where(near).select(*box, "reach", *names, "least", "most")
                    if upper > 1:
                        some = cut(tightened(some, some.groupBy(*own).agg(F.min("most").alias("reach"))).select(*box, "reach", *names))
                pairs = with_points(some.drop("least", "most")).where(near)
                sure = cut(pairs.groupBy(*box).agg(*met))
                most_met = sure.agg(F.max("met")).first()[0]
            pairs = tightened(pairs, sure.select(*own, "reach")) if level else with_points(around(sure, 0)).where(near)
            if most_met > CROWDED and cell / 4 >= finest:
                crowd = sure.where((F.col("met") > CROWDED) & wide_box).select(*own)
                crowded.append(crowd)
                pairs = pairs.join(small(crowd), own, "left_anti")
            lists.append(pairs.groupBy(*own).agg(F.collect_list(F.struct(*[f"{x}2" for x in axes], "b")).alias("list")))
        if n_sure == n_all:
            break
    best = F.array_min(F.transform("list", lambda p: F.struct(norm([F.col(x) - p[f"{x}2"] for x in axes]).alias("distance"), F.isnull(p["b"]), p["b"].alias("b"))))
    at, listed = gridded(left, own, cell), reduce(DataFrame.unionByName, lists)
    out = at.join(F.broadcast(listed) if max(n_rows, n_boxes) <= HELD else listed, own).select("a", best.alias("m")).select("a", "m.b", "m.distance")
    if not crowded or (again := reduce(DataFrame.unionByName, crowded)).isEmpty():
        return out
    return out.unionByName(_nearest_of_rows(at.join(small(again), own, "left_semi").select("a", *axes), rows, axes, cell / 4))


def closest_pair(left: DataFrame, right: DataFrame, axes: list[str], cell: float, key: str = "id") -> DataFrame:
    """(a, b, distance): the least distance between two sets, by the nearest of each point; ties to the smallest a, then b."""
    found = _nearest_of_rows(_queries(left, axes, key), _places(right, axes, key), axes, cell)
    return found.agg(F.min(F.struct("distance", "a", "b")).alias("m")).where("m IS NOT NULL").select("m.a", "m.b", "m.distance")
