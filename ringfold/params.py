"""Defaults of the operators, as frozen option sets."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Constants that results depend on.
EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = 111_320.0
PORTO_ORIGIN = (-8.6291, 41.1579)
LENGTH_TOLERANCE = 0.2
MIN_CENTRELINE_POINTS = 20
MIN_ROUTE_POINTS = 20
BBOX_EPSILON = 0.002
COORDINATE_EPSILON = 1e-9
MIN_SCALE, MAX_SCALE = 0.5, 3.0
DIRECTION_SPAN = 2
STRAIGHT_RATIO = (0.6, 1.6)
EXPAND_SNAP_M = 30.0
DEVIATION_SAMPLE_M = 10.0
FRECHET_SAMPLE_M = 20.0

#: (id, label, west, south, east, north)
REGIONS = (
    ("povoa-de-varzim", "Póvoa de Varzim", -8.775, 41.353, -8.725, 41.4),
    ("vila-do-conde", "Vila do Conde", -8.762, 41.2461147, -8.688, 41.38),
    ("matosinhos", "Matosinhos", -8.7291578, 41.156, -8.5954479, 41.2731147),
    ("porto", "Porto", -8.688, 41.135, -8.575, 41.183),
    ("vila-nova-de-gaia", "Vila Nova de Gaia", -8.676, 40.9987665, -8.58, 41.162),
    ("espinho", "Espinho", -8.6531193, 40.9647783, -8.5936229, 41.0257665),
)

RUNNABLE_CLASSES = (
    "residential", "living_street", "unclassified", "tertiary", "secondary", "primary", "pedestrian",
    "footway", "path", "track", "cycleway", "steps", "service",
)

#: Points where streets cross on different levels, in metres of the Porto frame.
GRADE_SEPARATED = (
    (3969.2, 2558.8), (4130.6, 693.4), (4286.4, 878.4), (1866.9, -1734.6),
    (-109.1, -2113.1), (2299.9, -1871.7), (1640.9, -1990.4), (3018.8, 2560.9),
)

RACETRACK_CLASSES = ("Q2338524", "Q926439")
METRES_PER_UNIT = {"Q11573": 1.0, "Q828224": 1000.0, "Q253276": 1609.344}
SLUG_STOP_WORDS = ("circuit", "de", "du", "di", "del", "of", "the")
PIT_NAME = r"(?i)pit[- ]?lane|pitlane|^pits?$|\bpit$"
RUNTIME_ERROR = r"(?i)runtime error|timed out|out of memory"
ENTITY_API = "https://www.wikidata.org/w/api.php"
MAP_SITE = "https://www.openstreetmap.org"


@dataclass(frozen=True)
class Bar:
    """What a route must meet to be accepted."""

    mean_m: float = 30.0
    max_m: float = 100.0
    ratio_lo: float = 0.9
    ratio_hi: float = 1.2
    retrace: float = 0.05


@dataclass(frozen=True)
class Proximity:
    near_m: float = 10.0
    sample_m: float = 5.0
    align_rad: float = math.radians(35)
    levels: int = 8
    cap_m: float = 40.0


@dataclass(frozen=True)
class GraphOptions:
    merge_m: float = 4.0
    corridor_m: float = 6.0
    exclude_m: float = 25.0
    exclusions: tuple[tuple[float, float], ...] = GRADE_SEPARATED
    cell_m: float = 50.0


@dataclass(frozen=True)
class CornerOptions:
    min_turn_rad: float = 0.35
    min_spacing_m: float = 60.0
    search_radius_m: float = 120.0


@dataclass(frozen=True)
class SearchOptions:
    results: int = 5
    grid_m: float = 300.0
    grid_deg: float = 30.0
    keep: int = 16
    refine_m: tuple[float, float] = (180.0, 90.0)  # span, step
    refine_deg: tuple[float, float] = (18.0, 9.0)
    samples: tuple[int, int] = (40, 80)  # coarse, fine
    min_coverage: float = 0.4
    dedup_m: float = 200.0
    dedup_deg: float = 12.0
    diversity_m: float = 800.0
    macro_m: float = 2000.0
    search_m: float = 40.0
    near_m: float = 10.0
    align_rad: float = math.radians(35)
    w_turning: float = 0.15
    w_procrustes: float = 0.2


@dataclass(frozen=True)
class RasterOptions:
    cell_m: float = 5.0
    layers: int = 12
    align_rad: float = math.radians(35)
    margin_m: float = 200.0


@dataclass(frozen=True)
class PoseOptions:
    anchor_m: float = 50.0
    rotation_deg: float = 15.0
    hole_threshold_m: float = 30.0
    max_hole_m: float = 200.0
    cap_m: float = 60.0
    count: int = 120
    dedup_m: float = 150.0
    dedup_deg: float = 10.0
    fine_m: float = 20.0
    coarse_m: float = 100.0


@dataclass(frozen=True)
class MatchOptions:
    step_m: float = 50.0
    radius_m: float = 90.0
    candidates: int = 8
    min_separation_m: float = 30.0
    emission_m: float = 70.0
    excess_weight: float = 3.0
    cost_cap: float = 10.0
    deficit_weight: float = 0.3
    hop_factor: float = 3.0


@dataclass(frozen=True)
class PruneOptions:
    passes: int = 3
    min_waypoints: int = 6


@dataclass(frozen=True)
class Tier:
    poses: int
    radius_m: float
    candidates: int
    passes: int


TIERS = (Tier(120, 90.0, 8, 3), Tier(240, 120.0, 12, 5), Tier(400, 150.0, 16, 8))


@dataclass(frozen=True)
class LadderOptions:
    bar: Bar = Bar()
    tiers: tuple[Tier, ...] = TIERS
    kept: int = 3
    separation_m: float = 500.0
    pool: int = 10


@dataclass(frozen=True)
class RingOptions:
    stitch_m: float = 5.0
    max_cycles: int = 5000
    max_steps: int = 3_000_000
    pick_tolerance: float = 0.05
    pick_margin: float = 0.03
    equivalent_m: float = 60.0
    equivalent_sample_m: float = 10.0
    ladder_m: tuple[float, ...] = (5.0, 15.0, 30.0)
    simplify_m: float = 2.5
    radius_m: float = 3500.0


@dataclass(frozen=True)
class NetworkOptions:
    simplify_m: float = 5.0
    grid_deg: float = 1e-5
