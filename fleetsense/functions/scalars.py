"""Column builders. All of them are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import AGING_GAMMA, AGING_TAU_H, CO2_KG_PER_KM, EARTH_M, FEATURES, SPEED_KMH, STATE_FEATURES, Feature


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clip01(x) -> Column:
    """Clip to [0, 1]; null stays null (greatest and least would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def haversine_m(lat1, lon1, lat2, lon2, null_as_zero: bool = True) -> Column:
    """Great-circle metres. A null coordinate counts as 0 degrees by default."""
    p = [F.coalesce(_c(x), F.lit(0.0)) if null_as_zero else _c(x) for x in (lat1, lon1, lat2, lon2)]
    dp, dl = F.radians(p[2] - p[0]) / 2, F.radians(p[3] - p[1]) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(F.radians(p[0])) * F.cos(F.radians(p[2])) * F.sin(dl) * F.sin(dl)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a))


def min_max(x, low: float, high: float) -> Column:
    return (_c(x) - low) / (high - low) if high > low else F.lit(0.0)


def deviation(x, low: float, high: float, optimal: float) -> Column:
    reach = max(abs(high - optimal), abs(low - optimal))
    return F.abs(_c(x) - optimal) / reach if reach > 0 else F.lit(0.0)


def normalised(f: Feature, x=None) -> Column:
    """The feature's part in [0, 1], null where it is missing; a negative impact is turned after clipping."""
    x = F.col(f.name) if x is None else _c(x)
    n = deviation(x, f.low, f.high, f.optimal) if f.impact == "deviation" else min_max(x, f.low, f.high)
    n = clip01(F.when(x.isNotNull(), n))
    return 1 - n if f.impact == "negative" else n


def priority(features: Sequence[Feature] = FEATURES, values: dict[str, Column] | None = None, missing: str = "renormalise") -> Column:
    """Weighted mean of the features that are present, in [0, 1]; 0 if none is.

    missing: renormalise divides by the weights of those present, zero_fill by all.
    """
    top, present = F.lit(0.0), F.lit(0.0)
    total = sum(f.weight for f in features if f.weight > 0)
    for f in features:
        if f.weight <= 0:
            continue
        n = normalised(f, (values or {}).get(f.name))
        top = top + F.coalesce(n * f.weight, F.lit(0.0))
        present = present + F.when(n.isNotNull(), f.weight).otherwise(0.0)
    if missing == "zero_fill":
        return clip01(top / F.lit(total))
    return clip01(F.when(present > 0, top / present).otherwise(0.0))


def state_priority(values: dict[str, Column] | None = None, missing: str = "renormalise") -> Column:
    return priority(STATE_FEATURES, values, missing)


def weighted_state(distance, waste, gas, temperature, humidity) -> Column:
    """The older fixed formula: distance, waste, gas, and the mean of temperature (10 degrees) and humidity (50 to 90)."""
    near = 1 - clip01(_c(distance) / 2000.0)
    climate = 0.5 * clip01(F.abs(F.coalesce(_c(temperature), F.lit(0.0)) - 25.0) / 10.0) + 0.5 * clip01((F.coalesce(_c(humidity), F.lit(0.0)) - 50.0) / 40.0)
    return clip01(0.2 * near + 0.4 * F.coalesce(clip01(waste), F.lit(0.0)) + 0.3 * F.coalesce(clip01(gas), F.lit(0.0)) + 0.1 * climate)


def weighted_target(distance, waste, gas, temperature, humidity, traffic) -> Column:
    """The fixed formula that the forest of the cost model learns."""
    return clip01(
        0.20 * (1 - clip01(_c(distance) / 2000.0)) + 0.30 * clip01(waste) + 0.20 * clip01(gas) + 0.10 * clip01(F.abs(_c(temperature) - 25.0) / 15.0)
        + 0.05 * clip01((_c(humidity) - 50.0) / 50.0) + 0.15 * (1 - clip01(traffic))
    )


def circular_target(waste, gas, temperature, humidity) -> Column:
    """A target made of the inputs alone: what a model must not be judged by."""
    return clip01((0.35 * clip01(waste) + 0.25 * clip01(gas) + 0.10 * clip01(F.abs(_c(temperature) - 25.0) / 15.0) + 0.05 * clip01((_c(humidity) - 50.0) / 50.0)) / 0.75)


def edge_cost(distance, priority_, traffic=None, alpha: float = 0.5, features: Sequence[Feature] = FEATURES, clip_priority: bool = True) -> Column:
    """Length times the traffic factors, over 1 + 10 * alpha * priority of the end."""
    p = F.coalesce(_c(priority_), F.lit(0.0))
    cost = _c(distance)
    if traffic is not None:
        for f in features:
            if f.routing_weight is not None:
                cost = cost * (1 + F.coalesce(clip01(min_max(traffic, f.low, f.high)), F.lit(0.0)) * f.routing_weight)
    return cost / (1 + 10 * alpha * (clip01(p) if clip_priority else p))


def aged(priority_, wait_h, gamma: float = AGING_GAMMA, tau_h: float = AGING_TAU_H) -> Column:
    """Priority plus a boost that grows with the wait up to gamma; not clipped. A missing wait is none."""
    return _c(priority_) + gamma * F.least(F.lit(1.0), F.coalesce(_c(wait_h), F.lit(0.0)) / tau_h)


def risk(hazard, p10_hours) -> Column:
    return F.greatest(F.coalesce(_c(hazard), F.lit(0.0)), F.coalesce(1 - clip01(_c(p10_hours) / 24.0), F.lit(0.0)))


def co2_kg(km) -> Column:
    return _c(km) * CO2_KG_PER_KM


def travel_h(km) -> Column:
    return _c(km) / SPEED_KMH


def status(fill) -> Column:
    """critical from 0.85, warning from 0.65."""
    fill = _c(fill)
    return F.when(fill >= 0.85, "critical").when(fill >= 0.65, "warning").otherwise("normal")


def status_strict(fill) -> Column:
    fill = _c(fill)
    return F.when(fill > 0.8, "critical").when(fill > 0.6, "high").otherwise("normal")


def score_class(score) -> Column:
    score = _c(score)
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def percent(x, digits: int = 1) -> Column:
    return F.round(_c(x) * 100, digits)


def radar(fill, gas, temperature, humidity) -> Column:
    """Display values in percent."""
    return F.struct(
        percent(clip01(fill)).alias("fill"), percent(clip01(gas)).alias("gas"), percent(clip01(F.abs(_c(temperature) - 25.0) / 15.0)).alias("temperature"), percent(clip01((_c(humidity) - 50.0) / 50.0)).alias("humidity")
    )


def micros(ts) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def elapsed_h(from_ts, to_ts) -> Column:
    return (micros(to_ts) - micros(from_ts)) / 3.6e9


def parse_time(x) -> Column:
    """Unix seconds or a date-time string; what is neither is null."""
    seconds = _c(x).cast("string").try_cast("double")
    return F.when(seconds.isNotNull(), F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(_c(x).cast("string")))


def ago(ts, now) -> Column:
    """Relative time in words."""
    s = F.floor((micros(now) - micros(ts)) / 1e6)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
    )


def ago_short(ts, now) -> Column:
    return F.when(micros(now) - micros(ts) < 60_000_000, F.lit("Just now")).otherwise(ago(ts, now))


def label(name, node_id) -> Column:
    """Bin-X of a name if it has one, else B and the id."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(name), "(Bin-[A-F])", 1), F.lit("")), F.concat(F.lit("B"), _c(node_id).cast("string")))


def initials(first, last, username) -> Column:
    head = F.coalesce(F.nullif(F.trim(_c(first)), F.lit("")), F.nullif(F.trim(_c(username)), F.lit("")), F.lit(""))
    return F.upper(F.concat(F.substring(head, 1, 1), F.substring(F.coalesce(F.trim(_c(last)), F.lit("")), 1, 1)))


def number_or(x, default: float) -> Column:
    """A number read tolerantly, else the default."""
    return F.coalesce(_c(x).cast("string").try_cast("double"), F.lit(float(default)))


def demand(t) -> Column:
    """Waste arrival factor of an hour: two daily peaks, more on the week's last two days."""
    hour, dow = _c(t) % 24, F.floor(_c(t) / 24) % 7
    return (0.6 + 0.7 * F.exp(-((hour - 9) * (hour - 9)) / 8.0) + 0.9 * F.exp(-((hour - 20) * (hour - 20)) / 6.0)) * F.when(dow >= 5, 1.35).otherwise(1.0)


def ambient(t) -> Column:
    """Temperature of an hour without its noise: seasonal and daily waves."""
    two_pi = 2 * 3.141592653589793
    return 28.0 + 4.0 * F.sin(two_pi * (_c(t) / 24.0 - 120) / 365.0) + 5.0 * F.sin(two_pi * (_c(t) % 24 - 9) / 24.0)


def two_decimals(x) -> Column:
    """A number of less than 2^45 as C's %.2f writes it: the exact binary value to the nearest hundredth, of two the even one; null stays null.

    Java's %.2f rounds the shortest decimal form half up, and cuts "null" to "nu".
    """
    x = _c(x)
    size = F.abs(x)
    part = (size - F.floor(size)) * F.lit(float(1 << 52))
    whole = F.floor(part)  # below size 1 bits may be left
    cents, rest = F.shiftright(whole * 100, 52), (whole * 100).bitwiseAND(F.lit((1 << 52) - 1))
    over = (rest - F.lit(1 << 51)).cast("double") + (part - whole) * 100.0
    up = (over > 0) | ((over == 0) & (cents % 2 == 1))
    cents = F.floor(size) * 100 + cents + up.cast("long")
    sign = F.when(F.signum(x) < 0, "-").otherwise("")
    return F.when(x.isNotNull(), F.concat(sign, F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
