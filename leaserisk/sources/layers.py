"""RAW -> STAGING -> ANALYTICS for any entity.

RAW keeps each batch as text, as it came.  STAGING casts it, keeps one row per
key, normalises, and tags every row with the rules that it breaks, in one pass;
valid and quarantined rows lie in folders of their own.  A manifest row is written
when a batch's layer is complete: a rerun skips what the manifest lists and does
the rest again, so a batch that broke off or comes twice changes nothing.
ANALYTICS reads the valid rows of all batches, the newest batch of each key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaserisk.sources.io import path_exists
from leaserisk.sources.merge import newest

MANIFEST = "rows long, entity string, layer string, batch string"


@dataclass(frozen=True)
class Entity:
    """An entity's key, typed columns, and rules (name, SQL predicate that holds for good rows)."""

    name: str
    key: tuple[str, ...]
    schema: T.StructType
    rules: tuple[tuple[str, str], ...] = ()
    trim_lower: tuple[str, ...] = ()


def tagged(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``rows`` with ``broken`` (names of the rules that don't hold; null counts as broken) and ``status``."""
    marks = [F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(name)) for name, p in rules]
    broken = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    return rows.withColumn("broken", broken).withColumn(
        "status", F.when(F.size("broken") == 0, "valid").otherwise("quarantine"))


class Layers:
    """The three layers under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _place(self, layer: str, entity: str, batch: str) -> str:
        return f"{self.root}/{layer}/entity={entity}/batch={batch}"

    def manifest(self) -> DataFrame:
        """(rows, entity, layer, batch) of the complete batches."""
        if not path_exists(self.spark, f"{self.root}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")

    def _write(self, layer: str, entity: str, batch: str, make, partition: list[str]) -> bool:
        """Whether the batch had to be written; ``make`` gives its rows."""
        listed = f"{self.root}/manifest/entity={entity}/layer={layer}/batch={batch}"
        if path_exists(self.spark, listed):
            return False
        place = self._place(layer, entity, batch)
        make().write.mode("overwrite").partitionBy(*partition).parquet(place)
        self.spark.read.parquet(place).agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode("overwrite").parquet(listed)
        return True

    def land(self, entity: Entity, batch: str, rows: DataFrame, source_system: str) -> bool:
        """RAW: the rows as text."""
        text = rows.select(*[F.col(f.name).cast("string").alias(f.name) for f in entity.schema.fields],
                           F.lit(source_system).alias("source_system"))
        return self._write("raw", entity.name, batch, lambda: text, [])

    def stage(self, entity: Entity, batch: str) -> bool:
        """STAGING: typed (values that no cast takes are null), one row per key, normalised, tagged by the rules."""
        def make() -> DataFrame:
            raw = self.spark.read.parquet(self._place("raw", entity.name, batch))
            typed = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in entity.schema.fields])
            one = newest(typed, list(entity.key), None).select(*typed.columns)
            tidy = one.withColumns({c: F.lower(F.trim(F.col(c))) for c in entity.trim_lower}) if entity.trim_lower else one
            return tagged(tidy, entity.rules)
        return self._write("staging", entity.name, batch, make, ["status"])

    def staged(self, entity: Entity, status: str = "valid") -> DataFrame:
        """Rows of one status in all staged batches, with ``broken`` and ``batch``."""
        schema = T.StructType([*entity.schema.fields, T.StructField("broken", T.ArrayType(T.StringType())),
                               T.StructField("status", T.StringType()), T.StructField("batch", T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/staging/entity={entity.name}").filter(
            F.col("status") == status).drop("status")

    def current(self, entity: Entity) -> DataFrame:
        """ANALYTICS input: of each key's valid rows the one of the greatest batch."""
        rows = self.staged(entity).drop("broken")
        return newest(rows, list(entity.key), "batch").select(*rows.columns).drop("batch")
