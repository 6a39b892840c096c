"""Operator settings. The numbers are fixed values of the detector family this library serves."""

from __future__ import annotations

from dataclasses import dataclass, field

OPEN, CLOSE = 0, 1
CLASS_NAMES = {0: "open", 1: "close"}

# Live thresholds per class id; other classes use DEFAULT_CONF.
LIVE_THRESHOLDS = {0: 0.35, 1: 0.60}
VIDEO_THRESHOLDS = {0: 0.30, 1: 0.60}
DEFAULT_CONF = 0.5

# Vehicle class ids of the first-stage detector.
VEHICLE_CLASSES = (2, 5, 7)

SWEEP_CONFS = (0.01, 0.03, 0.05, 0.10, 0.15, 0.25, 0.50)
COCO_IOUS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


@dataclass(frozen=True)
class BalanceConfig:
    target_ratio: float = 2.0
    scene_cap: int = 2
    max_bg_ratio: float = 0.2
    error_bonus: float = 10.0
    edge_penalty: float = -0.6
    seed: int = 10


@dataclass(frozen=True)
class SplitConfig:
    ratio: float = 0.8
    seed: int = 10
    domain_share: float = 0.40
    cap_seed_offset: int = 99
    val_share: float = 0.15
    train_floor: float = 0.60
    min_images: int = 3


@dataclass(frozen=True)
class AugmentConfig:
    open_multiplier: int = 5
    other_multiplier: int = 1
    small_area: float = 0.05
    min_visible: float = 0.3
    margin: float = 0.0001
    seed: int = 10


# Confidence buckets: (name, low, high), both ends inclusive, first match wins.
MINING_BUCKETS = (("high_conf_fp", 0.61, 1.00), ("low_conf_uncertain", 0.05, 0.60))


@dataclass(frozen=True)
class DoorConfig:
    open_conf: float = 0.80
    close_conf: float = 0.55
    min_area_ratio: float = 0.010
    min_aspect: float = 0.20
    max_aspect: float = 2.50
    match_iou: float = 0.50
    max_shift: float = 0.15
    window: int = 5
    required: int = 3
    open_enter: int = 3
    open_exit: int = 5
    close_enter: int = 3
    cooldown_ms: int = 2000
    timeout_ms: int = 3000
    roi: tuple[tuple[int, int], ...] | None = None
    timeout: str = "spec"  # "reference" never times out
    coast_as_evidence: bool = False


@dataclass(frozen=True)
class TrackerConfig:
    iou: float = 0.3
    max_missed: int = 12


@dataclass(frozen=True)
class WarningConfig:
    interval: int = 1
    low_interval: int = 5
    min_roi_px: int = 40
    max_speed: float = 15.0
    slow_speed: float = 3.0
    young_age: int = 5
    grace_frames: int = 20
    inherit_iou: float = 0.5
    votes: int = 3
    window: int = 5
    rearm: int = 5
    dark_threshold: float = 85.0


@dataclass(frozen=True)
class AlertConfig:
    open_frames: int = 2
    close_frames: int = 5
    open_min_area: float = 0.05
    alert_area: float = 0.10
    release_area: float = 0.08
    on_frames: int = 3
    off_frames: int = 5


# Motion presets per mode: alpha, max_translation (px), max_rotation (degrees), gain, rotation_gain.
MOTION_PRESETS = {
    "violent": (0.70, 6.0, 0.75, 0.55, 0.50),
    "large_sway": (0.88, 10.0, 1.10, 0.82, 0.80),
    "normal": (0.80, 8.0, 0.95, 0.72, 0.70),
}


@dataclass(frozen=True)
class GateConfig:
    recall_slack: float = 0.03
    ghost_slack: int = 2
    max_fp_ratio: float = 0.05
    max_drift: float = 0.20
    target_ratio: float = 2.0


@dataclass(frozen=True)
class FrameGateConfig:
    open_conf: float = 0.80
    close_conf: float = 0.85
    roi: tuple[int, int, int, int] = field(default=(100, 100, 1180, 700))
