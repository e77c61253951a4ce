"""Settings, passed explicitly; nothing is global."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from typing import Self

from .errors import ToolError
from .messages import BAD_ENV


@dataclass(frozen=True)
class GridConfig:
    #: Largest number of cells that a box request may return.
    point_limit: int = 1_000_000
    #: Most calendar days of a point series.
    max_days: int = 31
    #: Fields of the store, in the order they are returned, and those that the tools give.
    fields: tuple[str, ...] = ("sst", "sst_anomaly", "sea_ice")
    tool_fields: tuple[str, ...] = ("sst", "sst_anomaly")
    #: Nominal grid step for the stride estimate, and how often an estimate may be doubled.
    degrees_per_cell: float = 0.01
    stride_attempts: int = 4
    #: How many days a fallback date may be away.
    nearest_days: int = 7
    #: Edge of a storage tile in cells, and days that source granules are kept.
    tile: int = 1024
    retention_days: int = 30

    @classmethod
    def from_env(cls, prefix: str = "PELAGIA_", env: dict[str, str] | None = None) -> Self:
        """Numbers from environment variables, such as PELAGIA_POINT_LIMIT; what is unset keeps its default."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            kind = {"int": int, "float": float}.get(str(f.type))
            raw = env.get(f"{prefix}{f.name.upper()}")
            if kind and raw is not None:
                try:
                    found[f.name] = kind(raw)
                except ValueError as e:
                    raise ToolError(BAD_ENV.format(kind=kind.__name__, name=f"{prefix}{f.name.upper()}", raw=raw)) from e
        return cls(**found)
