"""Feature configuration of the urgency score and of the routing cost."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Feature:
    """weight: share in the urgency score (0: none). impact: positive, negative or deviation (from optimal).

    routing_weight: multiplies an edge's length by 1 + value * routing_weight; None if the feature has no part in routing.
    """

    name: str
    weight: float
    low: float
    high: float
    impact: str = "positive"
    optimal: float | None = None
    routing_weight: float | None = None


#: Weights and ranges of the urgency features.
FEATURES = (
    Feature("distance_m", 0.25, 0.0, 2000.0, "negative"),
    Feature("waste_level", 0.35, 0.0, 1.0),
    Feature("gas_level", 0.25, 0.0, 1.0),
    Feature("temperature", 0.10, 10.0, 40.0, "deviation", 25.0),
    Feature("humidity", 0.05, 50.0, 100.0),
    Feature("traffic_density", 0.10, 0.0, 1.0, "negative", None, 3.0),
)
#: The four features that need neither a location nor traffic.
STATE_FEATURES = tuple(f for f in FEATURES if f.name in ("waste_level", "gas_level", "temperature", "humidity"))

#: Routing, aging and hazard constants.
ALPHA = 0.5
AGING_GAMMA, AGING_TAU_H = 0.5, 48.0
GAS_DANGER, HORIZON_H, TTO_CAP_H = 0.62, 6, 24
CO2_KG_PER_KM, SPEED_KMH = 1.05, 20.0
#: Fixed depot of the comparison experiments, and the user's place in the sample queries.
DEPOT = (23.8069, 90.3687)
USER = (23.81, 90.36)
EARTH_M = 6_371_000.0

#: Fixed values of the simulation: weather, demand, collection and decomposition.
MEAN_TEMP, YEAR_SWING, DAY_SWING, TEMP_NOISE, WARM_DAY, WARM_HOUR = 28, 4, 5, 1.2, 120, 9
MEAN_HUMIDITY, DRYING, RAIN_SHARE, RAIN_HUMIDITY, HUMIDITY_NOISE = 62, 0.8, 0.04, 22, 4
BASE_DEMAND, PEAKS, WEEKEND, DEMAND_NOISE = 0.6, ((0.7, 9, 8), (0.9, 20, 6)), 1.35, 0.15
HEAP_SHARE, HEAP, RESIDUE, FIRST_FILL, BRIM, SPILL = 0.01, (0.15, 0.45), 0.05, 0.3, 1.3, 1.25
Q10_TEMP, ROT_RATE, ROT_KEPT = 20, 0.010, 0.98
