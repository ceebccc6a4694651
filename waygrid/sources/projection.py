"""Road data derived from the star schema by integer arithmetic on keys: no join, no shuffle, the same in any engine.

Vertices are customers on a jittered lattice of 40 columns, edges are orders between neighbours, fixes are events,
places and tag maps are parts, raw ways are orders with their line items' suppliers and customers as references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waygrid.config import RANK_SPEED
from waygrid.functions.geo import haversine


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice_lat(k: Column) -> Column:
    return (281000000 + F.floor(k / 40) * 12000 + (k * 7919 % 1000) * 4).cast("long")


def lattice_lon(k: Column) -> Column:
    return (774000000 + (k % 40) * 12000 + (k * 104729 % 1000) * 4).cast("long")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("vertex_id"), lattice_lat(k).alias("lat_e7"), lattice_lon(k).alias("lon_e7")).withColumns({"lat": F.col("lat_e7") / 1e7, "lon": F.col("lon_e7") / 1e7})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges with both ends' coordinates. Ends are neighbours on the lattice, turned round at its border."""
    last = read(spark, sf_dir, "customer").agg((F.count(F.lit(1)) - 1).alias("last"))  # one row
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").crossJoin(F.broadcast(last))
    step = F.element_at(F.array(F.lit(1), F.lit(40), F.lit(-1), F.lit(-40)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    ahead = F.col("o_custkey") + step
    e = o.select(
        F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("edge_from"), F.when(ahead.between(F.lit(0), F.col("last")), ahead).otherwise(F.col("o_custkey") - step).alias("edge_to"),
        (F.col("o_orderkey") % 8).cast("int").alias("class_rank"), F.when(F.col("o_orderkey") * 13 % 20 < 3, F.col("o_orderkey") * 13 % 20 + 1).otherwise(0).cast("int").alias("toll_road"),
        (F.col("o_orderkey") * 7 % 25 == 0).alias("private"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") * 11 % 50 == 0).alias("roundabout"),
    )
    e = e.withColumn("speed_kmh", F.element_at(F.array(*map(F.lit, RANK_SPEED)), F.col("class_rank") + 1))
    low, high = F.least("edge_from", "edge_to"), F.greatest("edge_from", "edge_to")
    e = e.withColumns({"shape_id": low * 1_000_000_000 + high, "reversed": (F.col("edge_from") > F.col("edge_to")).cast("int")})
    e = e.withColumns({f"{c}{p}": f(F.col(k)) / 1e7 for p, k in (("1", "edge_from"), ("2", "edge_to")) for c, f in (("lat", lattice_lat), ("lon", lattice_lon))})
    return e.withColumn("length_m", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))


def shapes(edge_table: DataFrame) -> DataFrame:
    """One undirected segment for each pair of ends, from the lower vertex to the higher, with its lowest edge."""
    s = edge_table.groupBy("shape_id").agg(F.min("edge_id").alias("edge_id"), F.first(F.least("edge_from", "edge_to")).alias("a"), F.first(F.greatest("edge_from", "edge_to")).alias("b"), F.bit_or(F.when(F.col("reversed") == 1, 2).otherwise(1)).alias("directions"))
    return s.select("shape_id", "edge_id", "directions", *[(f(F.col(k)) / 1e7).alias(f"{k}{c}") for k in "ab" for c, f in (("lat", lattice_lat), ("lon", lattice_lon))])


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        e.alias("fix_id"), F.col("user_id").alias("device_id"), "ts",
        ((281000000 + F.col("user_id") % 37 * 12000 + e * 37 % 1201 * 10) / 1e7).alias("lat"), ((774000000 + F.col("user_id") * 7 % 40 * 12000 + e * 53 % 1201 * 10) / 1e7).alias("lon"),
        (e * 17 % 60).cast("double").alias("accuracy_m"), (e * 53 % 360).cast("double").alias("heading_deg"), (e % 30).cast("double").alias("speed_mps"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("place_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").cast("int").alias("importance"), (lattice_lat(k) / 1e7).alias("lat"), (lattice_lon(k) / 1e7).alias("lon"))


_HIGHWAYS = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "footway", "motorway_link", "living_street", "steps", "unclassified", "track", "trunk_link", "path", "road")
_SPEEDS = ("50", "30 mph", "none", "80 km/h", "walk", "250")


def tagged_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, tags): tag maps that exercise the road profile."""
    k = F.col("p_partkey")

    def pick(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    pairs = {
        "highway": pick(_HIGHWAYS, k), "maxspeed": F.when(k % 3 != 0, pick(_SPEEDS, F.floor(k / 3))), "oneway": F.when(k % 5 < 3, pick(("yes", "-1", "no", "reverse", "1"), F.floor(k / 5))),
        "junction": F.when(k % 23 == 0, F.lit("roundabout")), "access": F.when(k % 11 == 0, pick(("no", "private", "yes", "destination", "permissive"), F.floor(k / 11))), "motorcar": F.when(k % 29 == 0, pick(("no", "yes", "private"), F.floor(k / 29))),
        "toll": F.when(k % 7 == 0, pick(("yes", "no", "true", "1"), F.floor(k / 7))), "toll:motorcar": F.when(k % 13 == 0, F.lit("yes")), "name": F.when(k % 4 != 0, F.col("p_name")), "ref": F.when(k % 6 == 0, pick(("NE2", "NH 24; SH 1", "yamuna", " "), F.floor(k / 6))),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(t).alias("key"), v.alias("value")) for t, v in pairs.items()]), lambda x: x["value"].isNotNull())
    return read(spark, sf_dir, "part").select(k.alias("way_id"), F.map_from_entries(entries).alias("tags"))


def raw_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extract, way_id, pos, node_id): way references as two overlapping extracts deliver them. A line item's line
    status names its extract, and every seventh order comes in both."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") * 13 % 40 + F.floor(F.col("l_partkey") / 25) % 30 * 40).alias("node_id"), F.col("l_linestatus"))
    both = F.when(F.col("way_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("way_id") % 2).cast("int")))
    return li.select("way_id", F.col("pos").cast("int").alias("pos"), F.col("node_id").cast("long").alias("node_id"), F.explode(both).alias("extract"))
