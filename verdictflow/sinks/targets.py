"""Emission targets: callables that take a DataFrame of decisions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .formats import audit_lines, decision_json, stdout_lines


class Noop:
    def __call__(self, decisions: DataFrame) -> None:
        decisions.write.format("noop").mode("append").save()


@dataclass
class Stdout:
    """Prints decisions from the driver, an iterator's partition at a time."""

    audit: bool = False

    def __call__(self, decisions: DataFrame) -> None:
        for row in (audit_lines if self.audit else stdout_lines)(decisions).toLocalIterator():
            print(row["value"])


@dataclass
class JsonFiles:
    path: str
    audit: bool = False
    mode: str = "append"

    def __call__(self, decisions: DataFrame) -> None:
        (audit_lines if self.audit else decision_json)(decisions).write.mode(self.mode).text(self.path)

    def for_batch(self, batch: int) -> JsonFiles:
        """A micro-batch's own folder, replaced when the batch runs again."""
        return JsonFiles(f"{self.path}/batch={batch}", self.audit, "overwrite")


@dataclass
class ParquetFiles:
    path: str
    partition_by: tuple[str, ...] = ()
    mode: str = "append"

    def __call__(self, decisions: DataFrame) -> None:
        decisions.write.mode(self.mode).partitionBy(*self.partition_by).parquet(self.path)

    def for_batch(self, batch: int) -> ParquetFiles:
        """A micro-batch's own folder, replaced when the batch runs again."""
        return ParquetFiles(f"{self.path}/batch={batch}", self.partition_by, "overwrite")


@dataclass
class Table:
    name: str

    def __call__(self, decisions: DataFrame) -> None:
        decisions.write.mode("append").saveAsTable(self.name)


JSON_TARGETS: dict[str, Callable[[dict], Callable[[DataFrame], None]]] = {
    "noop": lambda c: Noop(),
    "stdout": lambda c: Stdout(),
    "audit": lambda c: JsonFiles(c["path"], audit=True) if "path" in c else Stdout(audit=True),
    "json": lambda c: JsonFiles(c["path"]),
    "parquet": lambda c: ParquetFiles(c["path"], tuple(c.get("partition_by", ()))),
    "table": lambda c: Table(c["name"]),
}
