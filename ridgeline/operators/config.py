"""What a scene is computed with: defaults filled in and impossible values refused, so that a result can say what it used."""

from __future__ import annotations

from dataclasses import dataclass, field

# How far summits are looked for, and how near one is the summit underfoot.
PEAK_RADIUS_KM, MIN_PEAK_KM = 200.0, 0.05


@dataclass(frozen=True)
class SceneConfig:
    """Settings of operators.visibility.annotate(); ``None`` and what isn't given are the defaults."""

    tolerance_deg: float | None = None
    col_tolerance_m: float | None = None
    near_field_m: float | None = None
    peak_radius_km: float | None = None
    min_peak_km: float | None = None
    judge_beyond_terrain: bool | None = None
    sweep: dict = field(default_factory=dict)

    def resolved(self) -> SceneConfig:
        given = {"tolerance_deg": 0.0, "col_tolerance_m": 0.0, "near_field_m": 0.0, "peak_radius_km": PEAK_RADIUS_KM, "min_peak_km": MIN_PEAK_KM, "judge_beyond_terrain": False}
        values = {k: v if getattr(self, k) is None else getattr(self, k) for k, v in given.items()}
        for name in ("tolerance_deg", "col_tolerance_m", "near_field_m"):
            if not values[name] >= 0:
                raise ValueError(f"{name} must be 0 or more, not {values[name]}")
        return SceneConfig(**values, sweep=dict(self.sweep))
