"""Spatial joins as equi-joins on grid cells.

A point lies in one cell. What is looked for is registered in every cell that comes within the radius of it, so a pair
meets once, and points, which are many, are not copied. Rows of cells are as high as the radius; each row has columns
of its own width, the radius at the row's highest latitude, so that a cell reaches as far in the north as at the equator.
A cell with many points is dealt over as many tasks as its points fill, and what is registered there is sent to each;
other cells are one. A nearest segment is looked for in rings of growing radius: most points end in the first, where a
cell holds few segments, and only the others go on.

Latitudes go from -90 to 90. Longitudes are compared as they are: nothing is looked for across the 180th meridian.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import M_PER_DEG_LAT
from waygrid.functions.geo import haversine, project_at
from waygrid.plans.lineage import cut, unioned

#: Smallest cell in degrees (some 110 m): smaller ones would register a segment of ordinary length in many.
LEAST_CELL_DEG = 0.001
#: Points of a cell that one task takes.
PART_POINTS = 4096
#: Radii of the rings as shares of the whole radius; the last is the radius itself.
RINGS = (0.25, 1.0)
#: Metres of a degree are a little less on the sphere that distances are taken on, and a foot is a rounded number.
SLACK = 1.01
#: Cosine from which on a row of cells is one cell all round.
LEAST_COSINE = 1e-4


def cell_of(deg: Column, size: float) -> Column:
    return F.floor(deg / F.lit(size)).cast("long")


def cell_key(row: Column, col: Column) -> Column:
    return row * 1_000_000 + col


def register(segments: DataFrame, size: float) -> DataFrame:
    """Adds a row for each square cell that a segment's box touches (alat, alon, blat, blon)."""
    rows = F.sequence(cell_of(F.least("alat", "blat"), size), cell_of(F.greatest("alat", "blat"), size))
    cols = F.sequence(cell_of(F.least("alon", "blon"), size), cell_of(F.greatest("alon", "blon"), size))
    placed = segments.withColumn("cell_row", F.explode(rows)).withColumn("cell_col", F.explode(cols))
    return placed.withColumn("cell", cell_key(F.col("cell_row"), F.col("cell_col"))).drop("cell_row", "cell_col")


class Grid:
    """Cells for pairs within a radius."""

    def __init__(self, radius_m: float):
        self.reach = radius_m / M_PER_DEG_LAT * SLACK  # in degrees of latitude
        self.height = max(LEAST_CELL_DEG, self.reach)

    def row(self, lat: Column) -> Column:
        return F.floor(lat / F.lit(self.height)).cast("long")

    def _per_cosine(self, row: Column, degrees: float) -> Column:
        """Degrees of longitude that are so many of latitude at the highest latitude that a pair with one end in the row has."""
        highest = F.least(F.lit(90.0), F.greatest(F.abs(row), F.abs(row + 1)) * F.lit(self.height) + F.lit(self.reach))
        return F.least(F.lit(360.0), F.lit(degrees) / F.greatest(F.lit(LEAST_COSINE), F.cos(F.radians(highest))))

    def col(self, row: Column, lon: Column) -> Column:
        return F.floor(lon / self._per_cosine(row, self.height)).cast("long")

    def placed(self, points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """Adds the cell of each point."""
        row = self.row(F.col(lat))
        return points.withColumn("cell", cell_key(row, self.col(row, F.col(lon))))

    def reached(self, table: DataFrame, lats: tuple[Column, Column], lons: tuple[Column, Column]) -> DataFrame:
        """Adds a row for each cell within reach of a box (its lower and upper latitudes and longitudes)."""
        reach = F.lit(self.reach)
        rows = table.withColumn("cell_row", F.explode(F.sequence(self.row(lats[0] - reach), self.row(lats[1] + reach))))
        aside = self._per_cosine(F.col("cell_row"), self.reach)
        cols = F.sequence(self.col(F.col("cell_row"), lons[0] - aside), self.col(F.col("cell_row"), lons[1] + aside))
        return rows.withColumn("cell_col", F.explode(cols)).withColumn("cell", cell_key(F.col("cell_row"), F.col("cell_col"))).drop("cell_row", "cell_col")


def met(points: DataFrame, registered: DataFrame, point_key: str) -> DataFrame:
    """Rows of both sides that share a ``cell``. Cells with many points are counted first and dealt by their own numbers; the
    partitions are asked for by number, as rows are short and pairs many, and adaptive execution goes by their bytes."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = points.groupBy(F.col("cell").alias("hot_cell")).agg(F.count(F.lit(1)).alias("held"))
    hot = cut(held.filter(F.col("held") > PART_POINTS).select("hot_cell", F.ceil(F.col("held") / PART_POINTS).cast("int").alias("parts")))
    if not hot.take(1):
        return points.repartition(n, "cell").join(registered.repartition(n, "cell"), "cell")
    left, right = (t.join(hot, F.col("cell") == F.col("hot_cell"), "left").drop("hot_cell").withColumn("parts", F.coalesce("parts", F.lit(1))) for t in (points, registered))
    left = left.withColumn("part", F.pmod(F.xxhash64(point_key), F.col("parts")).cast("int")).drop("parts")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.repartition(n, "cell", "part").join(right.repartition(n, "cell", "part"), ["cell", "part"]).drop("part")


def pairs_within(points: DataFrame, segments: DataFrame, radius_m: float, point_key: str, segment_key: str, same: str | None = None) -> DataFrame:
    """Point and segment pairs at most radius_m apart, each once: adds t (share along the segment) and distance_m. With
    ``same``, a column of both sides, only pairs that agree in it: it is part of the cell that they meet in."""
    grid = Grid(radius_m)
    located = grid.placed(points.filter("lat is not null and lon is not null")).withColumn("cos_lat", F.cos(F.radians("lat")))
    box = [(F.least(f"a{c}", f"b{c}"), F.greatest(f"a{c}", f"b{c}")) for c in ("lat", "lon")]
    registered = grid.reached(segments, *box)
    if same:
        located, registered = (t.withColumn("cell", F.xxhash64("cell", same)) for t in (located, registered))
        joined = met(located, registered.withColumnRenamed(same, "of_segment"), point_key).filter(F.col(same) == F.col("of_segment")).drop("of_segment")
    else:
        joined = met(located, registered, point_key)
    t = project_at(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"), F.col("cos_lat"))
    joined = joined.withColumn("t", t)
    foot_lat, foot_lon = F.col("alat") + F.col("t") * (F.col("blat") - F.col("alat")), F.col("alon") + F.col("t") * (F.col("blon") - F.col("alon"))
    # Most of those that meet in a cell are too far in latitude already; that costs no sine.
    close = joined.filter(F.abs(F.col("lat") - foot_lat) <= F.lit(grid.reach))
    return close.withColumn("distance_m", haversine(F.col("lat"), F.col("lon"), foot_lat, foot_lon)).filter(F.col("distance_m") <= radius_m).drop("cell", "cos_lat")


def point_pairs(points: DataFrame, others: DataFrame, radius_m: float, point_key: str) -> DataFrame:
    """Pairs of points (lat, lon) and others (olat, olon) at most radius_m apart, each once: adds distance_m."""
    grid = Grid(radius_m)
    located = grid.placed(points.filter("lat is not null and lon is not null"))
    at = [(F.col(c), F.col(c)) for c in ("olat", "olon")]
    joined = met(located, grid.reached(others.filter("olat is not null and olon is not null"), *at), point_key)
    close = joined.filter(F.abs(F.col("lat") - F.col("olat")) <= F.lit(grid.reach))
    return close.withColumn("distance_m", haversine(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon"))).filter(F.col("distance_m") <= radius_m).drop("cell")


def nearest(points: DataFrame, segments: DataFrame, radius_m: float, point_key: str, segment_key: str) -> DataFrame:
    """Each point's nearest segment within the radius; of equal distances the lowest segment.

    A ring finds all segments within its radius, so its best one can't be beaten further out; points without one go on to
    the next ring. An aggregate, so that only the best of each task is shuffled. What a ring finds is written, as the
    points that are left and the result are both taken from it."""
    found, left = None, points
    for share in RINGS:
        pairs = pairs_within(left, segments, radius_m * share, point_key, segment_key)
        best = pairs.groupBy(point_key).agg(F.min(F.struct("distance_m", F.col(segment_key), "t")).alias("best"))
        best = best.select(point_key, F.col(f"best.{segment_key}").alias(segment_key), F.col("best.t").alias("t"), F.col("best.distance_m").alias("distance_m"))
        if share != RINGS[-1]:
            best = cut(best)
            left = left.join(best.select(point_key), point_key, "left_anti")
        found = best if found is None else unioned(found, best, number="distance_m")
    return found


def candidates(points: DataFrame, segments: DataFrame, radius_m: float, k: int, point_key: str, segment_key: str) -> DataFrame:
    """Each point's k nearest segments within the radius, with their rank."""
    ranked = pairs_within(points, segments, radius_m, point_key, segment_key)
    order = W.partitionBy(point_key).orderBy("distance_m", segment_key)
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def k_nearest(points: DataFrame, others: DataFrame, k: int, point_key: str, other_key: str, first_m: float = 500.0, growth: float = 4.0) -> DataFrame:
    """Each point's k nearest others (olat, olon), however far, with distance_m and rank; of equal distances the lowest.

    Rings that grow until k are found: all others within a ring's radius are met, so the k nearest of a point that has k
    in it can't be beaten further out, and only points with fewer go on. The last ring goes round the earth. There are
    fewer than k only if there are fewer others."""
    most = min(k, others.filter("olat is not null and olon is not null").limit(k).count())
    found, left, radius = None, points.filter("lat is not null and lon is not null"), first_m
    order = W.partitionBy(point_key).orderBy("distance_m", other_key)
    while most:
        all_round = radius >= M_PER_DEG_LAT * 180
        ranked = point_pairs(left, others, radius, point_key).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        whole = ranked.withColumn("held", F.count(F.lit(1)).over(W.partitionBy(point_key))).filter(F.col("held") == most).drop("held")
        done = cut(whole)
        found = done if found is None else unioned(found, done, number="distance_m")
        left = cut(left.join(done.select(point_key).distinct(), point_key, "left_anti"))
        if all_round or not left.take(1):
            return found
        radius *= growth
    return point_pairs(left.limit(0), others, first_m, point_key).withColumn("rank", F.lit(0))


def nearest_preferred(points: DataFrame, segments: DataFrame, radius_m: float, point_key: str, segment_key: str, second: Column) -> DataFrame:
    """Each point's nearest segment among those that are not ``second``; where there is none, among those that are.
    Adds the column second. Only points that the first choice left over are joined again."""
    first = cut(nearest(points, segments.filter(~second), radius_m, point_key, segment_key))
    left = points.join(first.select(point_key), point_key, "left_anti")
    other = nearest(left, segments.filter(second), radius_m, point_key, segment_key)
    return unioned(first.withColumn("second", F.lit(False)), other.withColumn("second", F.lit(True)), number="distance_m")
