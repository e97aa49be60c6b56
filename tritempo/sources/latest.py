"""A stored table of the newest versions that batches of versions are merged into.

The table is cut by a hash of the series id. A merge reads the parts that its batch touches, and only those, takes the newest
version of each key among stored and new ones, and writes the parts anew as another generation beside the old files. Then a
manifest, which says for every part which generation holds it, is published under the next number. A reader that
began before goes on with the old files; a merge that is lost half way leaves none of its rows in sight, and of two merges
that start from the same manifest the later one fails and can be repeated. Merging is idempotent and batches may come in any order:
a late version loses against a newer one, and a deleted newest version stays as what hides its key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tritempo.constants import CREATED_ON, DELETED, VERSIONED_IDENTIFIER
from tritempo.functions.predicates import not_deleted
from tritempo.operators.joins import stored
from tritempo.operators.versions import DEFAULT_KEYS, latest_version

PART = "_part"
MANIFEST = "manifest-{:010d}.json"


class LatestTable:
    """The table under a path. ``parts`` is chosen when it is created: a part should be what a task can hold."""

    def __init__(
        self, spark: SparkSession, path: str, *, keys: Sequence[str] = DEFAULT_KEYS, id_col: str = VERSIONED_IDENTIFIER, created: str = CREATED_ON,
        deleted: str = DELETED, tiebreak: Sequence[str] = (),
    ) -> None:
        self.spark, self.path, self.keys, self.id_col = spark, path.rstrip("/"), tuple(keys), id_col
        self.created, self.deleted, self.tiebreak = created, deleted, tuple(tiebreak)
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._system = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, schema: str, *, parts: int = 64) -> LatestTable:
        """An empty table; ``schema`` is that of the versions."""
        self._publish(0, {"parts": parts, "schema": schema, "generations": {}})
        return self

    def manifest(self) -> tuple[int, dict]:
        """The newest number and what it says."""
        names = [each.getPath().getName() for each in self._system.listStatus(self._folder)]
        number = max(int(name[9:-5]) for name in names if name.startswith("manifest-") and name.endswith(".json"))
        file = self._system.open(self._child(MANIFEST.format(number)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()
        return number, json.loads(text)

    def _child(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _publish(self, number: int, content: dict) -> None:
        """Written under another name and renamed, which fails where the number is taken."""
        draft, final = self._child(f".draft-{uuid.uuid4().hex}"), self._child(MANIFEST.format(number))
        file = self._system.create(draft)
        file.write(bytearray(json.dumps(content).encode()))
        file.close()
        if self._system.exists(final) or not self._system.rename(draft, final):
            self._system.delete(draft, False)
            raise RuntimeError(f"{final} is there already: another merge was first, repeat this one")

    def _read(self, content: dict, chosen: Sequence[int] | None = None) -> DataFrame:
        held = {int(part): generation for part, generation in content["generations"].items()}
        folders = [f"{self.path}/{held[part]}/{PART}={part}" for part in sorted(held) if chosen is None or part in set(chosen)]
        if not folders:
            return self.spark.createDataFrame([], content["schema"])
        return self.spark.read.schema(content["schema"]).parquet(*folders)

    def versions(self) -> DataFrame:
        """The newest version of every key, deleted ones too."""
        return self._read(self.manifest()[1])

    def rows(self, *, include_deleted: bool = False) -> DataFrame:
        return self.versions().filter(not_deleted(include_deleted, field=self.deleted))

    def merge(self, batch: DataFrame) -> list[int]:
        """Takes in a batch of versions; the numbers of the parts that were written anew.

        The batch is reduced to its newest versions and kept first, as it is read twice.
        """
        number, content = self.manifest()
        names = [name for name in self.spark.createDataFrame([], content["schema"]).columns]
        own = F.pmod(F.xxhash64(F.col(self.id_col)), F.lit(content["parts"])).cast("int")
        newest = stored(self._newest(batch.select(*[f"`{name}`" for name in names])).withColumn(PART, own))
        touched = sorted(row[PART] for row in newest.select(PART).distinct().collect())
        if not touched:
            return []
        merged = self._newest(self._read(content, touched).unionByName(newest.select(*names))).withColumn(PART, own)
        generation = f"generation-{number + 1:010d}-{uuid.uuid4().hex[:8]}"
        # a part's rows go to one file unless they are many
        merged.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/{generation}")
        self._publish(number + 1, content | {"generations": content["generations"] | {str(part): generation for part in touched}})
        return touched

    def _newest(self, versions: DataFrame) -> DataFrame:
        return latest_version(versions, self.keys, created=self.created, tiebreak=self.tiebreak)

    def vacuum(self) -> int:
        """Removes generations that the newest manifest doesn't name, and older manifests; readers of those must have ended."""
        number, content = self.manifest()
        needed = {f"{generation}/{PART}={part}" for part, generation in content["generations"].items()}
        gone = 0
        for entry in self._system.listStatus(self._folder):
            name = entry.getPath().getName()
            if name.startswith("manifest-") and name != MANIFEST.format(number):
                self._system.delete(entry.getPath(), False)
            elif name.startswith("generation-"):
                for child in self._system.listStatus(entry.getPath()):
                    part = child.getPath().getName()
                    if part.startswith(f"{PART}=") and f"{name}/{part}" not in needed:
                        gone += self._system.delete(child.getPath(), True)
        return gone
