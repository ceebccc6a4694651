"""Place index: kinds, names and representative points from tagged elements."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import AERODROME_RANK, AMENITY_RANK, EARTH_M, KIND_RANK, M_PER_DEG_LAT, OTHER_AMENITY_RANK, PLACE_RANK, ROAD_CLUSTER_M, STATION_RANK
from waygrid.functions.strings import collated
from waygrid.operators.network import numbered
from waygrid.operators.profile import lookup, tag
from waygrid.operators.tracking import metres


def kind_of(tags: str = "tags") -> Column:
    """struct(kind, category, rank) by the first rule that holds; null for elements that are no place."""
    t = lambda k: tag(k, tags)
    made = lambda kind, category, rank: F.struct(F.lit(kind).alias("kind"), category.alias("category"), rank.cast("int").alias("rank"))
    ranked = lookup(PLACE_RANK, t("place"))
    by_rank = [("amenity", t("amenity"), F.coalesce(lookup(AMENITY_RANK, t("amenity")), F.lit(OTHER_AMENITY_RANK)))]
    by_rank += [(kind, t(kind), F.lit(rank)) for kind, rank in KIND_RANK.items()]
    out = F.when(t("place").isNotNull() & ranked.isNotNull(), made("place", t("place"), ranked))
    out = out.when(t("railway").isin("station", "halt"), made("railway", t("railway"), F.lit(STATION_RANK)))
    for kind, category, rank in by_rank:
        out = out.when(category.isNotNull(), made(kind, category, rank))
    return out.when(t("aeroway") == "aerodrome", made("amenity", t("aeroway"), F.lit(AERODROME_RANK)))


def display_name(tags: str = "tags") -> Column:
    """Name, else English name, blanks collapsed; blank is absent."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.coalesce(clean(tag("name", tags)), clean(tag("name:en", tags)))


def build_places(elements: DataFrame, points: DataFrame) -> DataFrame:
    """Places of elements (id, tags): the mean of each one's points (id, lat, lon), repeats counted as often as they are."""
    named = elements.withColumn("k", kind_of()).withColumn("name", display_name()).filter("k is not null and name is not null")
    centre = points.groupBy("id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return named.join(centre, "id").select(F.col("id").alias("place_id"), "name", "k.kind", "k.category", F.col("k.rank").alias("importance"), "lat", "lon")


def build_order(places: DataFrame) -> DataFrame:
    """Adds place: the number, from 0, in the order that an index of places (place_id, name, importance) is written in, by
    falling importance, then name as locales order it, then code points, then place_id."""
    keyed = places.withColumn("falling", -F.col("importance")).withColumn("by_name", collated(F.col("name")))
    return numbered(keyed, ["falling", "by_name", "name", "place_id"], "order").withColumnRenamed("order", "place").drop("falling", "by_name")


def _parted(roads: DataFrame, within_m: float) -> DataFrame:
    """Adds part: ways of one name in two parts can share no cluster, as boxes around the parts lie further apart than a
    cluster reaches. A mean of ways lies in their box.

    Names are cut where rows of cells, then columns, are empty; only the distinct cells of a name meet in the window."""
    rows_deg = within_m / M_PER_DEG_LAT * 1.01
    row = F.floor(F.col("lat") / F.lit(rows_deg)).cast("long")
    placed = roads.withColumn("cell_row", row)
    w = W.partitionBy("norm").orderBy("cell_row")
    rows = placed.select("norm", "cell_row").distinct()
    rows = rows.withColumn("apart", F.coalesce((F.col("cell_row") - F.lag("cell_row").over(w) >= 2).cast("int"), F.lit(0))).withColumn("band", F.sum("apart").over(w)).drop("apart")
    widest = F.max(F.greatest(F.abs("cell_row"), F.abs(F.col("cell_row") + 1))).over(W.partitionBy("norm", "band")) * F.lit(rows_deg)
    # Points whose longitudes differ by d are at least asin(cos(highest latitude) * sin(d / 2)) * 2 radii apart.
    sine = F.sin(F.lit(within_m * 1.01 / (2 * EARTH_M))) / F.greatest(F.lit(1e-9), F.cos(F.radians(F.least(F.lit(90.0), widest))))
    width = F.when(sine >= 1, F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), sine))))
    placed = placed.join(rows.withColumn("width", width), ["norm", "cell_row"]).withColumn("cell_col", F.floor(F.col("lon") / F.col("width")).cast("long"))
    w, band = W.partitionBy("norm", "band").orderBy("cell_col"), W.partitionBy("norm", "band")
    cols = placed.select("norm", "band", "width", "cell_col").distinct()
    cols = cols.withColumn("far", F.coalesce(F.col("cell_col") - F.lag("cell_col").over(w) >= 2, F.lit(False)))
    # A band that comes near to going round the earth meets itself at the far side, and is left whole.
    around = (F.max("cell_col").over(band) - F.min("cell_col").over(band) + 3) * F.col("width") >= 360
    cols = cols.withColumn("around", around).withColumn("part", F.sum((F.col("far") & ~F.col("around")).cast("int")).over(w)).drop("width", "far", "around")
    return placed.join(cols, ["norm", "band", "cell_col"]).drop("cell_row", "cell_col", "width")


class _Clusters:
    """Clusters (first way, rank, sum of lat, of lon, ways) in the order of their first ways, found by the cell their mean lies
    in. Cells are cubes around the earth's middle whose side is the reach, so that what is near lies in one of 27, at a pole and at the
    180th meridian too."""

    def __init__(self, within_m: float):
        self.within_m, self.clusters, self.cells = within_m, [], {}
        self.side = 2.02 * math.sin(min(within_m / (2 * EARTH_M), math.pi / 2)) + 1e-12

    def _cell(self, lat: float, lon: float):
        """None: the place is no number, and near to nothing."""
        if not (math.isfinite(lat) and math.isfinite(lon)):
            return None
        lat, lon = math.radians(lat), math.radians(lon)
        flat = math.cos(lat)
        return math.floor(flat * math.cos(lon) / self.side), math.floor(flat * math.sin(lon) / self.side), math.floor(math.sin(lat) / self.side)

    def add(self, way_id: int, rank: int, lat: float, lon: float) -> None:
        """Into the first cluster whose mean is near, or into one of its own."""
        at, first = self._cell(lat, lon), None
        if at is not None:
            x, y, z = at
            near = [k for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1) for l in (z - 1, z, z + 1) for k in self.cells.get((i, j, l), ())]
            for k in sorted(near):
                c = self.clusters[k]
                if metres(c[2] / c[4], c[3] / c[4], lat, lon) <= self.within_m:
                    first = k
                    break
        if first is None:
            self.clusters.append([way_id, rank, lat, lon, 1])
            self.cells.setdefault(at, set()).add(len(self.clusters) - 1)
            return
        c = self.clusters[first]
        was = self._cell(c[2] / c[4], c[3] / c[4])
        c[1:] = [max(c[1], rank), c[2] + lat, c[3] + lon, c[4] + 1]
        now = self._cell(c[2] / c[4], c[3] / c[4])
        if now != was:
            self.cells[was].discard(first)
            self.cells.setdefault(now, set()).add(first)


def cluster_roads(roads: DataFrame, within_m: float = ROAD_CLUSTER_M) -> DataFrame:
    """Ways (way_id, norm, rank, lat, lon) of one name near each other as one place: (norm, way_id of its first, rank, lat,
    lon, ways). The first cluster whose running mean is near absorbs a way, in the order of ids. Ways without a name or a
    place are in none.

    The order of ids is what decides, so it is a fold; but a name is cut first into parts that can't share a cluster, parts
    are dealt over tasks, and a task streams its sorted ways and holds only the clusters of one part."""
    ways = roads.filter("norm is not null and lat is not null and lon is not null").select("norm", "way_id", F.col("rank").cast("int").alias("rank"), "lat", "lon")

    def fold(frames):
        who, held = None, None
        rows = lambda: pd.DataFrame([(who[0], c[0], c[1], c[2] / c[4], c[3] / c[4], c[4]) for c in held.clusters], columns=["norm", "way_id", "rank", "lat", "lon", "ways"])
        for f in frames:
            for norm, band, part, way_id, rank, lat, lon in zip(*[f[c].tolist() for c in ("norm", "band", "part", "way_id", "rank", "lat", "lon")]):
                if (norm, band, part) != who:
                    if who:
                        yield rows()
                    who, held = (norm, band, part), _Clusters(within_m)
                held.add(way_id, rank, lat, lon)
        if who:
            yield rows()

    dealt = _parted(ways, within_m).repartition("norm", "band", "part").sortWithinPartitions("norm", "band", "part", "way_id", "lat", "lon", "rank")
    return dealt.mapInPandas(fold, "norm string, way_id bigint, rank int, lat double, lon double, ways bigint")
