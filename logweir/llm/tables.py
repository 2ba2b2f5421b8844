"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logweir.sources.storage import discard, new_path


class Scratch:
    """Writes frames as Parquet in the shared folder, which cuts their lineage for good.

    A lost executor then costs a re-read of files, never a new run of what made them. Tables
    named in ``drop`` are deleted; what a lazy result still reads has to stay.
    """

    def __init__(self, label: str):
        self.label = label
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = new_path(spark, self.label)
        df.write.parquet(path)
        again = spark.read.schema(df.schema).parquet(path)
        self.paths[id(again)] = path
        return again

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.paths.pop(id(frame), None)
            if path:
                discard(frame.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like this one that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name
