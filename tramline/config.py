"""Defaults of every threshold, in one frozen object that operators take as an argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TransitConfig:
    watermark_s: int = 15
    geofence_m: float = 75.0
    trip_start_tolerance_s: int = 20 * 60
    bunching_s: int = 120
    bunching_join_s: int = 30
    service_gap_s: int = 10 * 60
    feature_window_s: int = 15 * 60
    timezone: str = "Europe/Bucharest"
    match_lookback_s: int = 120 * 60
    match_batch: int = 20
    schedule_tolerance_s: int = 90 * 60
    service_day_lookback: int = 0
    horizon_minutes: int = 30
    high_delay_s: float = 300.0
    search_window_s: int = 6 * 3600
    transfer_wait_s: int = 3600
    transfer_walk_m: float = 180.0
    min_transfer_s: int = 120
    city_box: tuple[float, float, float, float] = (44.0, 45.0, 25.5, 26.8)  # south, north, west, east
    location_stop_m: float = 900.0
    location_stops: int = 10
    walking_mps: float = 1.25
    max_walk_only_min: int = 45
    walk_first_max_min: int = 15
    walk_gain_min: int = 8
    first_legs: int = 900
    probe_s: int = 3600
    probe_sample: int = 64
    candidates: int = 30
    itineraries: int = 5
    walk_slack_min: int = 4
    time_gain_min: int = 3
    shape_cell_m: float = 250.0
    shape_part: int = 64
    trees: int = 200
    tree_step: float = 0.06
    model_version: str = "delay-gbt-v1"
    warm_start_version: str = "warm-start-v1"
    warm_start_confidence: float = 0.35


DEFAULT = TransitConfig()
