"""Options of the mapping job and their named presets."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

SEEDS = ("dictionary", "identical", "numerals", "unsupervised")
MAPS = ("advanced", "orthogonal", "unconstrained")
ACTIONS = ("unit", "center", "unitdim", "centeremb", "none")
DIRECTIONS = ("forward", "backward", "union")
SIDES = (None, "src", "trg")


@dataclass(frozen=True)
class MapConfig:
    init: str = "dictionary"
    unsupervised_vocab: int = 0
    normalize: tuple[str, ...] = ()
    map_type: str = "advanced"
    whiten: bool = False
    src_reweight: float = 0.0
    trg_reweight: float = 0.0
    src_dewhiten: str | None = None
    trg_dewhiten: str | None = None
    dim_reduction: int = 0
    self_learning: bool = False
    vocabulary_cutoff: int = 0
    direction: str = "union"
    csls: int = 0
    threshold: float = 1e-6
    stochastic_initial: float = 0.1
    stochastic_multiplier: float = 2.0
    stochastic_interval: int = 50
    seed: int = 0
    precision: str = "fp32"
    encoding: str = "utf-8"

    @classmethod
    def preset(cls, name: str, **override) -> MapConfig:
        """A recommended setting; explicit options win over it."""
        if name not in PRESETS:
            raise ValueError(f"preset must be one of {sorted(PRESETS)}")
        return cls(**{**PRESETS[name], **override}).validate()

    def with_options(self, **override) -> MapConfig:
        return replace(self, **override).validate()

    def validate(self) -> MapConfig:
        for value, allowed, name in (
            (self.init, SEEDS, "init"),
            (self.map_type, MAPS, "map_type"),
            (self.direction, DIRECTIONS, "direction"),
            (self.src_dewhiten, SIDES, "src_dewhiten"),
            (self.trg_dewhiten, SIDES, "trg_dewhiten"),
            (self.precision, ("fp32", "fp64"), "precision"),
        ):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {value!r}")
        unknown = set(self.normalize) - set(ACTIONS)
        if unknown:
            raise ValueError(f"unknown normalisation {sorted(unknown)}")
        if (self.src_dewhiten or self.trg_dewhiten) and not self.whiten:
            raise ValueError("de-whitening needs whitening first")
        return self

    def options(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


# The recommended settings and those of four published systems.
_RECOMMENDED = dict(
    normalize=("unit", "center", "unit"),
    whiten=True,
    src_reweight=0.5,
    trg_reweight=0.5,
    src_dewhiten="src",
    trg_dewhiten="trg",
)
_REFINED = dict(self_learning=True, vocabulary_cutoff=20000, csls=10)
_ROTATED = dict(normalize=("unit", "center"), map_type="orthogonal")
_FORWARD = dict(
    self_learning=True,
    direction="forward",
    stochastic_initial=1.0,
    stochastic_interval=1,
)
_BLIND = dict(init="unsupervised", unsupervised_vocab=4000)
PRESETS = {
    "supervised": dict(init="dictionary", **_RECOMMENDED),
    "semi_supervised": dict(init="dictionary", **_RECOMMENDED, **_REFINED),
    "identical": dict(init="identical", **_RECOMMENDED, **_REFINED),
    "unsupervised": dict(**_BLIND, **_RECOMMENDED, **_REFINED),
    "acl2018": dict(**_BLIND, **_RECOMMENDED, **_REFINED),
    "aaai2018": dict(
        init="dictionary",
        normalize=("unit", "center"),
        whiten=True,
        trg_reweight=1.0,
        src_dewhiten="src",
        trg_dewhiten="trg",
    ),
    "acl2017": dict(init="numerals", **_ROTATED, **_FORWARD),
    "acl2017_seed": dict(init="dictionary", **_ROTATED, **_FORWARD),
    "emnlp2016": dict(init="dictionary", **_ROTATED),
}
