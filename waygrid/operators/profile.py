"""Road profile: what a way's tags mean for driving, as one projection over the tag map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygrid.config import CLASS_RANK, CLASS_SPEED

ACCESS_KEYS = ("motorcar", "motor_vehicle", "vehicle", "access")
#: Access values that forbid, and that make a way private.
DENIED = ("no", "false")
PRIVATE = ("private", "destination", "delivery", "customers", "permit", "residents")


def tag(key: str, tags: str = "tags") -> Column:
    return F.element_at(F.col(tags), key)


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def access(tags: str = "tags") -> Column:
    """The most specific access key that is present decides."""
    value = F.coalesce(*[tag(k, tags) for k in ACCESS_KEYS])
    return F.when(value.isin(*DENIED), "denied").when(value.isin(*PRIVATE), "private").otherwise("allowed")


def max_speed(raw: Column) -> Column:
    """Speed in km/h of 50, 50 km/h, 50 kmh, 50 kph or 30 mph, if above 0 and below 200; else null."""
    number = F.regexp_extract(F.trim(raw), r"(?i)^([0-9]+(?:\.[0-9]+)?) *(km/h|kmh|kph|mph)?$", 1)
    unit = F.lower(F.regexp_extract(F.trim(raw), r"(?i)^([0-9]+(?:\.[0-9]+)?) *(km/h|kmh|kph|mph)?$", 2))
    value = F.when(number != "", number.cast("double") * F.when(unit == "mph", 1.609344).otherwise(1.0))
    return F.when((value > 0) & (value < 200), value)


def directions(tags: str = "tags") -> tuple[Column, Column]:
    """Whether a way may be driven forward and backward: an explicit oneway first, then what the road type implies."""
    oneway = tag("oneway", tags)
    implied = (F.coalesce(tag("junction", tags), F.lit("")) == "roundabout") | tag("highway", tags).isin("motorway", "motorway_link")
    backward_only = oneway.isin("-1", "reverse")
    forward_only = oneway.isin("yes", "true", "1") | ((oneway.isNull() | ~oneway.isin("no", "false", "0", "yes", "true", "1", "-1", "reverse")) & implied)
    return ~F.coalesce(backward_only, F.lit(False)), F.coalesce(backward_only, F.lit(False)) | ~F.coalesce(forward_only, F.lit(False))


def road_name(tags: str = "tags") -> Column:
    """Text before the first semicolon of name, else of ref. An empty name does not fall through."""
    return F.nullif(F.trim(F.split(F.coalesce(tag("name", tags), tag("ref", tags)), ";")[0]), F.lit(""))


def toll(tags: str = "tags") -> Column:
    return F.coalesce(F.coalesce(tag("toll", tags), tag("toll:motorcar", tags)).isin("yes", "true", "1"), F.lit(False))


def toll_road(is_toll: Column, tags: str = "tags") -> Column:
    """Number of the toll road whose pattern the name or ref matches first; 3 for tolled ways of no known road; 0 untolled."""
    both = F.concat_ws("\n", tag("name", tags), tag("ref", tags))
    return F.when(~is_toll, 0).when(both.rlike("(?i)yamuna"), 1).when(both.rlike(r"(?i)eastern[ -]*peripheral|\bNE-?2\b"), 2).otherwise(3)


def classify(ways: DataFrame, tags: str = "tags") -> DataFrame:
    """Adds the columns of the profile; a road class that is unknown is not drivable."""
    highway = tag("highway", tags)
    forward, backward = directions(tags)
    default = lookup(CLASS_SPEED, highway).cast("double")
    speed = F.coalesce(max_speed(tag("maxspeed", tags)), default)
    return (
        ways.withColumn("access", access(tags))
        .withColumn("drivable", F.coalesce(default.isNotNull() & (F.col("access") != "denied"), F.lit(False)))
        .withColumn("forward", forward).withColumn("backward", backward)
        .withColumn("speed_kmh", F.greatest(F.lit(1), F.least(F.lit(255), F.floor(speed + 0.5))).cast("int"))
        .withColumn("class_rank", lookup(CLASS_RANK, highway)).withColumn("private", F.col("access") == "private")
        .withColumn("toll", toll(tags)).withColumn("toll_road", toll_road(F.col("toll"), tags)).withColumn("road_name", road_name(tags))
    )


def gate_kind(is_gate: Column, highway: Column) -> Column:
    """A booth or gantry on a motorway or trunk is a mainline gate, elsewhere a ramp gate."""
    return F.when(~is_gate, F.lit(None)).when(highway.isin("motorway", "trunk"), "mainline").otherwise("ramp")


def toll_display(confidence: Column, toll_m: Column) -> Column:
    return F.when(toll_m <= 0, "none").when(confidence == "verified", "exact").otherwise("estimated")
