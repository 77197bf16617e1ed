"""Outputs: existing ones are left alone unless forced."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("parquet", "csv", "json")


def save(df: DataFrame, path: str, fmt: str = "parquet", force: bool = False,
         partition_by: list[str] | None = None) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    writer = df.write.mode("overwrite" if force else "ignore").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
