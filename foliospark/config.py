"""Settings of a training table, checked on creation; unknown names are an error."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class TrainingSettings:
    """How page images become training rows. Defaults are the usual ones of the field."""

    # fixed values
    n_epochs: int = 20
    batch_size: int = 1
    make_patches: bool = True
    patch_height: int = 300
    patch_width: int = 300
    input_pixels: int = 720_000
    margin: int = 0
    augment_flip: bool = True
    augment_scale: float = 0.05
    augment_rotation: float = 0.2
    local_entropy_ratio: float = 0.0
    local_entropy_sigma: float = 3.0
    learning_rate: float = 1e-5
    exponential_learning: bool = True
    focal_gamma: float = 0.0
    weights: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        if 2 * self.margin >= min(self.patch_height, self.patch_width):
            raise ValueError("the margin leaves nothing of a patch")

    @classmethod
    def from_dict(cls, values: dict) -> TrainingSettings:
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    def to_dict(self) -> dict:
        return asdict(self)
