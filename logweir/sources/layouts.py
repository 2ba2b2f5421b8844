"""Which columns a kind of log is partitioned by."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.errors import ValidationError

DEFAULT_LAYOUT = "default"
PIVOTS = ("_documentType", "_plugin")
PARTITIONABLE = ("_documentType", "_plugin", "year", "month", "day")

# The partition columns of each document type.
PARTITION_CONFIG = {
    "partitionStrategy": "variable",
    "partitionPivot": "_documentType",
    "defaultPartitions": ["_documentType", "_plugin", "year", "month", "day"],
    "partitionKeys": [
        {"pivotValue": "syslog", "keys": ["_documentType", "_plugin"]},
        {"pivotValue": "ESLogs", "keys": ["_documentType", "_plugin", "year", "month"]},
    ],
}


@dataclass(frozen=True)
class PartitionStrategy:
    """Partition columns per value of a pivot column, and those of everything else.

    Each layout is a dataset of its own: directories of unequal depth under one root could
    not be read together.
    """

    default: tuple[str, ...]
    pivot: str = "_documentType"
    by_value: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.pivot not in PIVOTS:
            raise ValidationError(f"pivot must be one of {PIVOTS}: {self.pivot!r}")
        for columns in (self.default, *self.by_value.values()):
            if not columns or set(columns) - set(PARTITIONABLE):
                raise ValidationError(f"cannot partition by {columns}")
        for value in self.by_value:
            if value == DEFAULT_LAYOUT or not value or "/" in value:
                raise ValidationError(f"pivot value cannot name a dataset: {value!r}")

    @classmethod
    def from_config(cls, config: Mapping) -> PartitionStrategy:
        """Read a configuration; any strategy but ``variable`` means one layout for all."""
        keys: Sequence[Mapping] = config.get("partitionKeys", [])
        variable = config["partitionStrategy"] == "variable"
        return cls(
            default=tuple(config["defaultPartitions"]),
            pivot=config["partitionPivot"],
            by_value={k["pivotValue"]: tuple(k["keys"]) for k in keys} if variable else {},
        )

    @property
    def layouts(self) -> dict[str, tuple[str, ...]]:
        """Partition columns per dataset name."""
        return {DEFAULT_LAYOUT: self.default, **self.by_value}

    def layout_of_row(self) -> Column:
        """Dataset name of a row, from the pivot column of its envelope."""
        pivot = F.col(self.pivot)
        return F.when(pivot.isin(list(self.by_value)), pivot).otherwise(F.lit(DEFAULT_LAYOUT))


STANDARD_STRATEGY = PartitionStrategy.from_config(PARTITION_CONFIG)
