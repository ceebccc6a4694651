"""Fixed values and adjustable parameters of the road model. Parameters are arguments everywhere; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The build area in degrees x 1e7 (inclusive), and metres to degrees.
AREA_E7 = {"lat": (280581610, 286798990), "lon": (772622620, 777684780)}
EARTH_M = 6_371_008.8
M_PER_DEG_LAT, M_PER_DEG_LON = 110_540.0, 111_320.0

#: Default speed (km/h) and rank of each drivable road class.
CLASS_SPEED = {
    "motorway": 90, "trunk": 70, "primary": 50, "secondary": 40, "tertiary": 35, "unclassified": 30, "residential": 25, "living_street": 10, "service": 15, "road": 25,
    "motorway_link": 45, "trunk_link": 40, "primary_link": 30, "secondary_link": 25, "tertiary_link": 25,
}
CLASS_RANK = {
    "motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "unclassified": 5, "residential": 6, "living_street": 7, "service": 7, "road": 5,
    "motorway_link": 0, "trunk_link": 1, "primary_link": 2, "secondary_link": 3, "tertiary_link": 4,
}
RANK_SPEED = (90, 70, 50, 40, 35, 30, 25, 15)
#: Place ranks.
PLACE_RANK = {"city": 100, "town": 90, "suburb": 80, "village": 72, "quarter": 66, "neighbourhood": 62, "hamlet": 55, "locality": 50, "isolated_dwelling": 40}
AMENITY_RANK = {"hospital": 48, "university": 47, "college": 44, "bus_station": 44, "marketplace": 42, "townhall": 42, "police": 40, "fire_station": 40}
STATION_RANK, AERODROME_RANK, OTHER_AMENITY_RANK = 46, 49, 30
KIND_RANK = {"shop": 26, "tourism": 28, "leisure": 24, "office": 22}
#: Plaza chainages (km) along the matrix-priced expressway.
PLAZA_KM = (5.5, 15.36, 23.002, 44.512, 49.96, 52.192, 72.724, 83.005, 108.57, 126.137, 132.085)
#: Chainage (km) of that expressway's southern end, how far from a prediction a plaza may lie, how close
#: attachments are one interchange, and the anchors a fit tries (first, last, steps per km).
CHAINAGE_SOUTH_KM, PLAZA_CAP_KM, INTERCHANGE_KM, ANCHORS_KM = 134.548, 3.0, 2.0, (125, 150, 1000)
#: A segment's middle is covered by a road this near; metres that may lie beyond; speed of an uncovered metre.
COVERED_M, UNCOVERED_MOST_M, UNCOVERED_KMH = 25.0, 200.0, 10.0
#: Gaps to the road below this are not shown; least time between matching calls and between arrival times,
#: the change an arrival time must make, and the metres after which a driven line is drawn anew.
APPROACH_M, MATCH_EVERY_MS, ETA_EVERY_MS, ETA_CHANGE_S, REDRAW_M = 20.0, 1000, 1000, 30.0, 3.0
#: Zoom and rank of place classes in tiles, and amenities that are points of interest.
PLACE_ZOOM = {"city": 6, "town": 8, "suburb": 10, "village": 10, "neighbourhood": 12, "quarter": 12, "hamlet": 12, "locality": 13, "isolated_dwelling": 14}
PLACE_ORDER = {"city": 1, "town": 2, "suburb": 3, "village": 4, "neighbourhood": 5, "quarter": 5, "hamlet": 6, "locality": 7, "isolated_dwelling": 8}
POI_AMENITIES = (
    "hospital", "clinic", "doctors", "pharmacy", "school", "college", "university", "bank", "atm", "fuel", "police", "fire_station", "post_office",
    "place_of_worship", "restaurant", "cafe", "fast_food", "bus_station", "marketplace", "townhall", "library", "parking",
)
#: Code points of the scripts that maps can write.
SCRIPTS = {"Latin and common": ((0x0, 0x24F), (0x2000, 0x206F)), "Devanagari": ((0x900, 0x97F),), "Arabic (Urdu)": ((0x600, 0x6FF), (0x750, 0x77F))}
#: Chargeable kilometres between those plazas.
TOLLABLE_KM = (
    (0.0, 19.76, 28.032, 52.26, 58.608, 61.967, 83.147, 94.779, 126.824, 144.391, 156.09),
    (19.76, 0.0, 8.272, 32.5, 38.848, 42.207, 63.387, 75.019, 107.064, 124.631, 136.33),
    (28.032, 8.272, 0.0, 24.228, 30.576, 33.935, 55.115, 66.747, 98.792, 116.359, 128.058),
    (52.26, 32.5, 24.228, 0.0, 6.348, 9.707, 30.887, 42.519, 74.564, 92.131, 103.83),
    (58.608, 38.848, 30.576, 6.348, 0.0, 3.359, 24.539, 36.171, 68.216, 85.783, 97.482),
    (61.967, 42.207, 33.935, 9.707, 3.359, 0.0, 21.18, 32.813, 64.858, 82.425, 94.124),
    (83.147, 63.387, 55.115, 30.887, 24.539, 21.18, 0.0, 11.633, 43.678, 61.245, 72.944),
    (94.779, 75.019, 66.747, 42.519, 36.171, 32.813, 11.633, 0.0, 32.045, 49.612, 61.311),
    (126.824, 107.064, 98.792, 74.564, 68.216, 64.858, 43.678, 32.045, 0.0, 17.567, 29.266),
    (144.391, 124.631, 116.359, 92.131, 85.783, 82.425, 61.245, 49.612, 17.567, 0.0, 11.699),
    (156.09, 136.33, 128.058, 103.83, 97.482, 94.124, 72.944, 61.311, 29.266, 11.699, 0.0),
)
#: Gates this close together are one plaza; longest span of a circle that is a roundabout; how far ahead a name is looked for.
SAME_PLAZA_M, CIRCLE_M, NAME_AHEAD_M = 2000.0, 180.0, 800.0


@dataclass(frozen=True)
class TollRoad:
    """How a road is paid for: by gates and ramps (gate-hybrid), by entry and exit (matrix) or by distance (per-km)."""

    mechanism: str
    rate_per_km: float
    fee: float = 0.0
    step: float = 1.0
    confidence: str = "verified"
    with_ramp: str = "verified"


#: The toll roads by number.
TOLL_ROADS = {
    1: TollRoad("gate-hybrid", 2.95, fee=140.0, with_ramp="approximated"),
    2: TollRoad("matrix", 1.95, step=5.0),
    3: TollRoad("per-km", 1.95, confidence="unpriced", with_ramp="unpriced"),
}


# The defaults of the four classes below.


@dataclass(frozen=True)
class TurnCost:
    straight_deg: float = 25.0
    turn_s: float = 3.0
    cross_deg: float = 40.0
    cross_s: float = 3.0
    class_drop_s: float = 2.0
    uturn_s: float = 40.0


@dataclass(frozen=True)
class Objective:
    neutral_s_per_km: float = 24.0
    private_s_per_km: float = 180.0
    rupees_per_hour: float = 550.0
    quality: tuple = (0.3, 0.45, 0.65, 0.85, 1.0, 1.5, 2.0, 3.5)
    toll_rate_per_km: dict = field(default_factory=lambda: {1: 2.95, 2: 1.95, 3: 1.95})


@dataclass(frozen=True)
class Tracking:
    accuracy_m: float = 40.0
    max_speed_kmh: float = 150.0
    heading_gate_deg: float = 60.0
    off_route_m: float = 30.0
    off_route_ms: int = 3000
    dropout_ms: int = 5000
    sigma_floor_m: float = 4.0
    transition_m: float = 20.0
    candidates: int = 8
    heading_window_m: float = 25.0
    history: int = 15
    heading_min_mps: float = 2.0
    match_fixes: int = 12
    route_window_m: float = 250.0


@dataclass(frozen=True)
class SearchRanks:
    exact: float = 40.0
    prefix: float = 25.0
    token_prefix: float = 15.0
    all_tokens: float = 5.0
    locality: float = 55.0
    locality_m: float = 2500.0
    fuzzy: float = 0.35
    per_edit: float = 30.0
    limit: int = 10


CELL_DEG = 0.0045
SNAP_M = 500.0
MATCH_M = 40.0
#: Metres within which roads of one name are one place, and the seed of sampled pairs.
ROAD_CLUSTER_M, SAMPLE_SEED = 6000.0, 20260731
#: The zoom from which on road classes are in tiles, and the classes of waterways, landuse and leisure that are.
ROAD_ZOOM = {
    "motorway": 6, "trunk": 6, "primary": 8, "secondary": 10, "tertiary": 11, "unclassified": 12, "residential": 12, "living_street": 13, "service": 14,
    "motorway_link": 9, "trunk_link": 9, "primary_link": 10, "secondary_link": 11, "tertiary_link": 12, "road": 13, "pedestrian": 13, "footway": 14, "path": 14,
    "cycleway": 14, "steps": 15, "track": 14,
}
WATERWAYS = ("river", "stream", "canal", "drain", "ditch")
LANDUSES = ("residential", "industrial", "commercial", "retail", "farmland", "farmyard", "orchard", "cemetery", "quarry", "military", "construction")
LEISURE_AREAS = ("park", "garden", "playground", "pitch", "sports_centre", "stadium", "golf_course", "recreation_ground")
