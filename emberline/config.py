"""Parameters, with the defaults of the detection service."""

from __future__ import annotations

import os
from dataclasses import dataclass

# Class names, thresholds and type lists of the rule chain.
GAS_FLARE, PERSISTENT, FIRE, UNKNOWN = "gas_flare", "persistent_industrial_source", "industrial_fire", "unknown"
KEEP_CLASSES = (GAS_FLARE, PERSISTENT, FIRE)
GAS_TYPES = ("oil_gas_facility", "lng_or_storage_terminal", "petrochemical", "refinery", "thermal_power_plant")
CONFIDENT_TYPES = ("thermal_power_plant", "refinery", "oil_gas_facility", "petrochemical", "steel_or_metal", "mining", "lng_or_storage_terminal")
SOURCES = ("VIIRS_NOAA20_NRT", "VIIRS_NOAA21_NRT")
CELL_METRES = 1113.2
MAX_WINDOW_DAYS = 5


@dataclass(frozen=True)
class Rules:
    near_m: float = 5000.0
    at_m: float = 1500.0
    bright_frp: float = 15.0
    persistence: float = 0.5
    gas_detections_7d: int = 3
    active_days: int = 3
    repeat_7d: int = 5
    night: float = 0.6
    surge: float = 2.5
    vision_flare: float = 0.6
    vision_industrial: float = 0.8
    vision_fire: float = 0.7


@dataclass(frozen=True)
class History:
    radius_m: float = 1000.0
    window_days: int = 7
    persistence_detections: float = 5.0
    causal: bool = False  # True leaves out neighbours later than the detection

    @staticmethod
    def from_env() -> History:
        env = os.environ.get
        return History(float(env("PERSIST_RADIUS_M", 1000)), int(env("PERSIST_WINDOW_DAYS", 7)), float(env("PERSIST_DENOM", 5)))


@dataclass(frozen=True)
class Screen:
    reach_m: float = 5000.0
    prior_days: int = 30
    percentile: float = 90.0
    frp_mw: float | None = None

    @staticmethod
    def from_env() -> Screen:
        env = os.environ.get
        return Screen(float(env("SCREEN_REACH_M", 5000)), int(env("SCREEN_PRIOR_DAYS", 30)), float(env("SCREEN_PERCENTILE", 90)), float(env("SCREEN_FRP_MW", 0)) or None)


def retention_days(explicit: int | None = None) -> int:
    """At least 30 days, whatever is asked for."""
    return max(30, int(explicit if explicit is not None else os.environ.get("RETENTION_DAYS", 30)))


def parse_sources(text: str) -> list[str]:
    """The named sources, of which each must be known."""
    names = [s.strip() for s in text.split(",") if s.strip()]
    if not names or (unknown := [s for s in names if s not in SOURCES]):
        raise ValueError(f"unknown sources: {unknown if names else 'none given'}")
    return names


def box_of(text: str | None, ordered: bool = True) -> tuple[float, float, float, float]:
    """(west, south, east, north) of "w,s,e,n"; ordered: west < east is asked for as well."""
    try:
        w, s, e, n = (float(x) for x in (text or "").split(","))
    except ValueError:
        raise ValueError(f"not a box of four numbers: {text!r}") from None
    if not (-180 <= w <= 180 and -180 <= e <= 180 and -90 <= s <= 90 and -90 <= n <= 90):
        raise ValueError(f"outside the globe: {text!r}")
    if ordered and not (w < e and s < n):
        raise ValueError(f"empty box: {text!r}")
    return w, s, e, n


def normalize_bbox(text: str | None) -> str:
    """"world" or a checked box."""
    name = (text or "").strip().lower()
    if name == "world":
        return name
    box_of(name)
    return name


def overpass_box(text: str) -> str:
    """south,west,north,east to six places, the order of the map query language."""
    w, s, e, n = box_of(text)
    return ",".join(f"{x:.6f}" for x in (s, w, n, e))
