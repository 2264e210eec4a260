"""Index configuration and errors."""

from __future__ import annotations

from dataclasses import dataclass


class VectorError(ValueError):
    pass


class InvalidDimension(VectorError):
    pass


class EmptyIndex(VectorError):
    pass


class InvalidVectorIndex(VectorError):
    pass


class InvalidSchema(VectorError):
    pass


class VersionNotFound(VectorError):
    pass


class VersionConflict(VectorError):
    pass


class CorruptIndex(VectorError):
    pass


@dataclass(frozen=True)
class IndexConfig:
    """num_bits and epsilon_0 are kept as metadata; search doesn't read them."""

    num_partitions: int
    num_bits: int = 4
    epsilon_0: float = 1.9
    rotation_seed: int = 42
    refine_sq8: bool = True
    refine_k: int = 10
    fastscan: bool = True
    query_bits: int = 0
    compat: bool = False  # estimator scales without the corrections that the README names
    decimals: int = 9  # to which distances from centroids are rounded, so that close ones tie; the lower id wins

    def __post_init__(self):
        if self.num_partitions < 1:
            raise InvalidDimension("num_partitions must be positive")


def check_dim(dim: int) -> int:
    if dim <= 0 or dim % 64:
        raise InvalidDimension(f"dimension {dim} is no positive multiple of 64")
    return dim
