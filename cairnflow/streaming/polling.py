"""A polled source: a folder into which snapshots come, one of which is a cycle."""

from __future__ import annotations

import json
import os
import random
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Rows of a cycle at most: positions and temperature readings.
GPS_ROWS, TEMPERATURE_ROWS = 100, 30


class SnapshotSource(DataSource):
    """Options: ``path``, a folder that the driver reads, of JSON arrays named in order of time; ``rows``, a cycle's at most; ``seed``; ``rename``, a JSON object from the snapshot's fields to columns."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        raise ValueError("a polled source needs a schema")

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802  the name is Spark's
        return SnapshotReader(self.options, schema)


class SnapshotReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.rows, self.seed = options["path"], int(options.get("rows", GPS_ROWS)), options.get("seed", "0")
        self.fields, self.kinds = schema.names, [f.dataType.typeName() for f in schema]
        self.back = {new: old for old, new in json.loads(options.get("rename", "{}")).items()}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": ""}

    def _sample(self, name: str) -> list[tuple]:
        """The same rows for a file whenever it is read: the sample is drawn by its name and the seed."""
        with open(os.path.join(self.path, name), encoding="utf-8") as f:
            found = json.load(f)
        out = []
        for r in random.Random(f"{self.seed}:{name}").sample(found, min(self.rows, len(found))):
            own = [r.get(self.back.get(c, c)) for c in self.fields]
            out.append(tuple(float(v) if k == "double" and v is not None else v for v, k in zip(own, self.kinds, strict=True)))
        return out

    def _names(self, after: str) -> list[str]:
        return sorted(n for n in os.listdir(self.path) if n.endswith(".json") and n > after)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        names = self._names(start["last"])[:1]
        return (iter(self._sample(names[0])), {"last": names[0]}) if names else (iter(()), start)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for name in self._names(start["last"]):
            if name <= end["last"]:
                yield from self._sample(name)


def polled(spark: SparkSession, path: str, schema: str, *, rows: int = GPS_ROWS, seed: int = 0, rename: dict[str, str] | None = None):
    """A stream of one snapshot a cycle; a restart goes on after the last one that was committed."""
    spark.dataSource.register(SnapshotSource)
    return spark.readStream.format("snapshots").schema(schema).options(path=path, rows=str(rows), seed=str(seed), rename=json.dumps(rename or {})).load()
