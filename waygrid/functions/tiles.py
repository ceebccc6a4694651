"""Tile arithmetic of the public PMTiles v3 format, and layers of map tiles as projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waygrid.config import LANDUSES, LEISURE_AREAS, ROAD_ZOOM, WATERWAYS
from waygrid.operators.profile import lookup

LAYERS = "array<struct<layer: string, class: string, min_zoom: int, oneway: int, roundabout: boolean, ref: string, name: string, admin_level: double>>"


@F.pandas_udf(T.LongType())
def tile_id(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Place of a tile in the order of zooms and, in each, along the Hilbert curve."""
    z, x, y = (c.to_numpy(np.int64).copy() for c in (z, x, y))
    out = ((1 << (2 * z)) - 1) // 3
    side = (1 << z) >> 1
    while (side > 0).any():
        on = side > 0
        rx, ry = ((x & side) > 0).astype(np.int64), ((y & side) > 0).astype(np.int64)
        out = out + np.where(on, side * side * ((3 * rx) ^ ry), 0)
        turn = on & (ry == 0)
        flip = turn & (rx == 1)
        x, y = np.where(flip, side - 1 - (x & (side - 1)), x & np.maximum(side - 1, 0)), np.where(flip, side - 1 - (y & (side - 1)), y & np.maximum(side - 1, 0))
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        side = side >> 1
    return pd.Series(out)


def tile_xy(lat: Column, lon: Column, z: int) -> tuple[Column, Column]:
    """Column and row of the web mercator tile that holds a point."""
    n = float(1 << z)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.lit(np.pi)) / 2 * n)
    return x.cast("long"), y.cast("long")


def road_layers(tags: str = "tags") -> Column:
    """Layers of a way's tags: the first rule that holds; roads with a name are labelled too."""
    t = lambda k: F.element_at(F.col(tags), k)
    road = F.when(t("name").isNotNull(), F.array(F.lit("transportation"), F.lit("transportation_name"))).otherwise(F.array(F.lit("transportation")))
    rules = (("highway", road), ("waterway", "waterway"), ("natural", "water"), ("landuse", "landuse"), ("leisure", "landuse"), ("building", "building"), ("boundary", "boundary"))
    out = None
    for key, layer in rules:
        value = layer if isinstance(layer, Column) else F.array(F.lit(layer))
        out = F.when(t(key).isNotNull(), value) if out is None else out.when(t(key).isNotNull(), value)
    return F.coalesce(out, F.array().cast("array<string>"))


def way_layers(tags: str = "tags", closed: str = "closed") -> Column:
    """array<struct(layer, class, min_zoom, oneway, roundabout, ref, name, admin_level)>: what tiles show of a way. The first
    kind of use that holds decides; a road of a class without a zoom is shown in no layer, nor as anything else. A road
    with a name is labelled in a layer of its own, from zoom 12 on. Empty tags are absent ones."""
    t = lambda k: F.nullif(F.element_at(F.col(tags), k), F.lit(""))
    absent = F.lit(None).cast("string")

    def shown(layer, kind, zoom, *, oneway=None, roundabout=None, ref=None, name=None, level=None):
        parts = {"layer": F.lit(layer), "class": kind, "min_zoom": zoom, "oneway": F.lit(None) if oneway is None else oneway, "roundabout": F.lit(None) if roundabout is None else roundabout, "ref": absent if ref is None else ref}
        parts |= {"name": absent if name is None else name, "admin_level": F.lit(None) if level is None else level}
        kinds = {"min_zoom": "int", "oneway": "int", "roundabout": "boolean", "admin_level": "double"}
        return F.struct(*[v.cast(kinds.get(k, "string")).alias(k) for k, v in parts.items()])

    zoom = lookup(ROAD_ZOOM, t("highway"))
    oneway = F.when(t("oneway").isin("yes", "1", "true"), 1).when(t("oneway").isin("-1", "reverse"), -1)
    line = shown("transportation", t("highway"), zoom, oneway=oneway, roundabout=F.coalesce(t("junction") == "roundabout", F.lit(False)), ref=t("ref"))
    label = shown("transportation_name", t("highway"), F.greatest(zoom, F.lit(12)), ref=t("ref"), name=t("name"))
    road = F.when(zoom.isNotNull(), F.when(t("name").isNotNull(), F.array(line, label)).otherwise(F.array(line)))
    level = F.expr(f"try_cast({tags}['admin_level'] as double)")
    water = (t("natural") == "water") | (t("landuse") == "reservoir") | (t("waterway") == "riverbank")
    out = F.when(t("highway").isNotNull(), road)
    for holds, one in (
        (t("waterway").isin(*WATERWAYS), shown("waterway", t("waterway"), F.when(t("waterway") == "river", 8).otherwise(12), name=t("name"))),
        (water, shown("water", F.coalesce(t("water"), F.lit("lake")), F.lit(8), name=t("name"))),
        (t("landuse").isin(*LANDUSES), shown("landuse", t("landuse"), F.lit(10), name=t("name"))),
        (t("leisure").isin(*LEISURE_AREAS), shown("landuse", t("leisure"), F.lit(11), name=t("name"))),
        (t("building").isNotNull() & F.col(closed), shown("building", absent, F.lit(14))),
        ((t("boundary") == "administrative") & (level <= 6), shown("boundary", absent, F.lit(6), level=level)),
    ):
        out = out.when(holds, F.array(one))
    return F.coalesce(out, F.array().cast(LAYERS))


def stored_once(tiles: DataFrame) -> DataFrame:
    """Each tile (tile_id, body) with the first tile of the same content, which alone is stored."""
    keyed = tiles.select("tile_id", "body", F.sha2("body", 256).alias("content"))
    first = keyed.groupBy("content").agg(F.min("tile_id").alias("stored_as"))
    return keyed.join(first, "content").select("tile_id", "content", "stored_as", F.when(F.col("tile_id") == F.col("stored_as"), F.col("body")).alias("body"))
