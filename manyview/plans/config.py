"""Parameters of a reconstruction. The numbers are fixed values that give the expected results."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Features:
    method: str = "gradient"
    most: int = 0
    contrast: float = 0.04
    edge: float = 10.0
    sigma: float = 1.6


@dataclass(frozen=True)
class Matching:
    ratio: float | None = None
    mutual: bool = True
    ransac_px: float | None = None
    most_epipolar: float = 3.0
    least_inliers: int | None = None
    pair_window: int | None = None
    pnp_px: float | None = None
    contour_points: int = 150
    contour_epipolar: float = 5.0
    contour_least: int = 8
    proximity: float = 5.0


@dataclass(frozen=True)
class Triangulation:
    most_error: float = 1.5
    least_angle: float = 3.0
    least_views: int = 3
    good_ratio: float = 0.60
    adaptive: bool = True
    mad_k: float = 3.5
    cap: float = 4.0
    depth_cov: float = 1.0


@dataclass(frozen=True)
class Adjustment:
    mode: str = "none"
    local_every: int = 3
    local_window: int = 4
    local_cap: int | None = None  # points of an adjustment, those with the most views; None: all
    global_cap: int | None = None
    global_points: int = 200
    global_obs: int = 800
    scale: float = 2.0
    loss: str = "cauchy"

    def has(self, part: str) -> bool:
        """Whether a mode such as local+global_end names the part."""
        return part in self.mode.split("+")


@dataclass(frozen=True)
class Cleanup:
    any_view: float = 5.0
    median: float = 1.0
    good_views: int = 3
    percentile: float = 0.95
    multiplier: float = 2.0


@dataclass(frozen=True)
class Config:
    features: Features = field(default_factory=Features)
    matching: Matching = field(default_factory=Matching)
    triangulation: Triangulation = field(default_factory=Triangulation)
    adjustment: Adjustment = field(default_factory=Adjustment)
    cleanup: Cleanup = field(default_factory=Cleanup)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        """Unknown names raise; values isn't changed."""
        made = cls()
        for name, part in values.items():
            own = getattr(made, name)
            made = replace(made, **{name: replace(own, **part) if is_dataclass(own) else part})
        return made

    def with_values(self, **values) -> Config:
        """Each value goes to the part that has a field of its name."""
        out = self
        for name, value in values.items():
            part = next((f.name for f in fields(self) if hasattr(getattr(self, f.name), name)), None)
            if part is None:
                raise ValueError(f"no part has a value named {name!r}")
            out = replace(out, **{part: replace(getattr(out, part), **{name: value})})
        return out

    def adapted(self, n_images: int, width: int, height: int) -> Config:
        """Fills the values that are None from the number and the size of the images."""
        largest = max(width, height)
        found = {
            "ratio": 0.75 if largest < 1500 else 0.80 if largest < 3000 else 0.85,
            "ransac_px": max(1.0, 0.002 * largest),
            "pnp_px": max(3.0, 0.002 * largest),
            "pair_window": min(max(8, n_images // 4), 20),
            "least_inliers": 20,
        }
        return replace(self, matching=replace(self.matching, **{k: v for k, v in found.items() if getattr(self.matching, k) is None}))


PRESETS = {
    "default": Config(),
    "multicam": Config(matching=Matching(ratio=0.80)),
    "textureless": Config(features=Features(most=150_000, contrast=0.004, edge=10.0, sigma=1.2), matching=Matching(ratio=0.80)),
    "singlecam": Config(triangulation=Triangulation(most_error=2.0, least_views=2, least_angle=2.0), adjustment=Adjustment(mode="local+global_end")),
    "turntable": Config(matching=Matching(ratio=0.85), triangulation=Triangulation(most_error=2.0, least_views=2, least_angle=1.0), adjustment=Adjustment(mode="local+global_end")),
}
