"""Masking statistics: a sum over files and partitions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MaskStats:
    processed: int = 0
    masked: int = 0
    files: int = 0

    def __add__(self, other: MaskStats) -> MaskStats:
        return MaskStats(self.processed + other.processed, self.masked + other.masked, self.files + other.files)

    @property
    def ratio(self) -> float:
        return self.masked / self.processed if self.processed else 0.0
