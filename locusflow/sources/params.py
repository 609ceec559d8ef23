"""Settings of an analysis: a plain object, kept as a table of keys and JSON values."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Params:
    base: int = 1000
    missing: str = "0"
    seed: int = 12345
    conf: float = 0.95
    n_perm: int = 5000
    n_boot: int = 5000
    ploidy: int = 2
    genotype_format: str = "auto"
    markers: list[str] = field(default_factory=list)
    treatments: dict[str, str] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, json.dumps(v)) for k, v in asdict(self).items()], "key string, value string")

    @classmethod
    def of(cls, table: DataFrame) -> Params:
        """Unknown keys are passed over; of repeated keys the last one counts."""
        known = {f.name for f in fields(cls)}
        return cls(**{r["key"]: json.loads(r["value"]) for r in table.collect() if r["key"] in known})

    def upsert(self, **values) -> Params:
        return Params(**asdict(self) | values)


class Store:
    """Settings kept in a table of keys and JSON values; there are few, so a change writes the table anew, as a version of its own that readers see whole."""

    def __init__(self, spark: SparkSession, name: str = "params", path: str | None = None):
        """``path`` is where the table's files go, if not to the warehouse."""
        self.spark, self.name, self.path = spark, name, path

    def all(self) -> dict:
        """Every key with its value; none where there is no table."""
        if not self.spark.catalog.tableExists(self.name):
            return {}
        return {r["key"]: json.loads(r["value"]) for r in self.spark.table(self.name).collect()}

    def get(self, key: str, default=None):
        """The value, or ``default`` where the key is missing, null or empty text."""
        value = self.all().get(key)
        return default if value is None or value == "" else value

    def upsert(self, **values) -> dict:
        """Writes new keys and overwrites known ones; the others stay. No values change nothing."""
        now = self.all()
        if not values:
            return now
        self._write(now | values)
        return now | values

    def clear(self) -> None:
        """Takes all keys away; the table stays, if there is one."""
        if self.spark.catalog.tableExists(self.name):
            self._write({})

    def _write(self, values: dict) -> None:
        rows = [(k, json.dumps(v)) for k, v in sorted(values.items())]
        self.spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").options(**({"path": self.path} if self.path else {})).saveAsTable(self.name)
