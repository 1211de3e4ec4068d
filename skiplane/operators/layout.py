"""How a table is laid out: its dimensions, kinds and bucket counts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiplane.functions import routing

#: Names of the bucket columns: the first two partition the files.
BUCKETS = ("bx", "by_", "bz")


@dataclass(frozen=True)
class Dimension:
    name: str
    kind: str = routing.HASH
    buckets: int = 16

    def __post_init__(self):
        if self.kind not in (routing.HASH, routing.MAGNITUDE) or self.buckets < 1:
            raise ValueError(f"bad dimension {self}")

    def bucket(self) -> Column:
        return routing.bucket(F.col(f"`{self.name}`"), self.kind, self.buckets)


@dataclass(frozen=True)
class Layout:
    dimensions: tuple[Dimension, ...]

    def __post_init__(self):
        if not 1 <= len(self.dimensions) <= 3:
            raise ValueError("a layout has one to three dimensions")

    @classmethod
    def of(cls, **dims: tuple[str, int]) -> Layout:
        return cls(tuple(Dimension(n, k, b) for n, (k, b) in dims.items()))

    def sizes(self) -> tuple[int, int, int]:
        own = [d.buckets for d in self.dimensions]
        return tuple(own + [1] * (3 - len(own)))  # type: ignore[return-value]

    def routed(self, df: DataFrame) -> DataFrame:
        """``df`` with bx, by_ and bz; 0 where there is no such dimension."""
        own = {name: d.bucket() for name, d in zip(BUCKETS, self.dimensions, strict=False)}
        return df.withColumns({name: own.get(name, F.lit(0)) for name in BUCKETS})

    def to_json(self) -> str:
        return json.dumps([asdict(d) for d in self.dimensions])

    @classmethod
    def from_json(cls, text: str) -> Layout:
        return cls(tuple(Dimension(**d) for d in json.loads(text)))
