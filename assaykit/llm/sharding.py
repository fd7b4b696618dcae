"""Sharding by size-tiered compaction, with versioned manifests. DataFrame operations only.

`append` writes an arrival as small immutable shards (Parquet files) without a shuffle. `compact` sorts shards into
size tiers and merges each tier that holds at least `fan_in` of them into files of about `target_bytes`, also
without a shuffle: one read, coalesce and write for each tier. Every change ends in the commit of the next manifest, a
JSON file that names all live shards; it is written beside its final name and renamed, which fails if another
writer took that version. The loser reads the new manifest and tries again: an arrival adds its shards to it, a compaction is given
up only for tiers whose shards are gone. Readers of an older version keep their files until `vacuum`.

The driver holds one manifest line for each file, never rows. A failed job leaves files that no manifest names;
`vacuum` removes them once they are older than any job takes, so that a writer that has not committed yet keeps its own. Nulls,
repeated rows, long texts and any columns are stored as they are; an empty arrival commits a version without new shards.
Arrivals must have the columns of the first one, by name, order and type.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

from .common import shared_dir


#: Commits that are tried before a writer gives up.
TRIES = 20


def _bare(kind: T.DataType) -> T.DataType:
    """The type with everything nullable and without metadata, as Parquet files give it back."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _bare(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_bare(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(_bare(kind.keyType), _bare(kind.valueType))
    return kind


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    tier: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str | None = None, *, shard_rows: int = 2_000, target_bytes: int = 128 << 20, smallest_bytes: int = 1 << 20, fan_in: int = 4):
        self.spark, self.root = spark, root or shared_dir(spark, "shards")
        self.shard_rows, self.target_bytes, self.smallest_bytes, self.fan_in = shard_rows, target_bytes, smallest_bytes, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # files, through Hadoop so that any store works

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _list(self, path: str) -> list[tuple[str, int]]:
        fs, p = self._fs(), self._path(path)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.isFile())

    # manifests

    def versions(self) -> list[int]:
        return [int(p.rsplit("/v", 1)[1].removesuffix(".json")) for p, _ in self._list(f"{self.root}/manifest") if p.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default of the last one."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs().open(self._path(f"{self.root}/manifest/v{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _retry(self, change: Callable[[dict], tuple[dict | None, list[Shard]] | None]) -> int:
        """Commit what change makes of the last manifest; after a conflict, of the next one. None leaves things as they are."""
        for _ in range(TRIES):
            base = self.manifest()
            made = change(base)
            if made is None:
                return base["version"]
            try:
                return self._commit(base, *made)
            except Conflict:
                continue
        raise Conflict(f"no version was free in {TRIES} tries; nothing was committed")

    def _commit(self, base: dict, schema: dict | None, shards: list[Shard]) -> int:
        version = base["version"] + 1
        final = self._path(f"{self.root}/manifest/v{version:010d}.json")
        beside = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}.tmp")
        out = self._fs().create(beside, False)
        out.write(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, final, plain)
        except Exception as e:
            self._fs().delete(beside, False)
            if self._fs().exists(final):
                raise Conflict(f"version {version} is taken") from e
            raise
        return version

    # shards

    def tier(self, size: int) -> int:
        """0 up to smallest_bytes, then one more for each factor fan_in."""
        return max(0, math.ceil(math.log(max(1, size) / self.smallest_bytes, self.fan_in)))

    def _write(self, df: DataFrame, rows: int = 0) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(folder)
        return [Shard(p, n, self.tier(n)) for p, n in self._list(folder) if p.endswith(".parquet")]

    def append(self, df: DataFrame) -> int:
        """Add an arrival; returns the new version."""
        kinds = lambda schema: [(f.name, _bare(f.dataType)) for f in schema]

        def check(base: dict) -> None:
            if base["schema"] and kinds(T.StructType.fromJson(base["schema"])) != kinds(df.schema):
                raise ValueError("an arrival must have the columns of the first one, by name, order and type")

        check(self.manifest())
        new = self._write(df, self.shard_rows)

        def change(base: dict):
            check(base)
            return base["schema"] or _bare(df.schema).jsonValue(), [Shard(**s) for s in base["shards"]] + new

        return self._retry(change)

    def compact(self) -> int:
        """Merge tiers below the target size that hold fan_in shards or more; returns the version that is current then."""
        base = self.manifest()
        tiers: dict[int, list[Shard]] = {}
        for s in (Shard(**s) for s in base["shards"]):
            if s.bytes < self.target_bytes // 2:
                tiers.setdefault(s.tier, []).append(s)
        merged: list[tuple[set[str], list[Shard]]] = []
        for _, run in sorted(tiers.items()):
            if len(run) >= self.fan_in:
                files = max(1, math.ceil(sum(s.bytes for s in run) / self.target_bytes))
                merged.append(({s.path for s in run}, self._write(self._read(base, run).coalesce(files))))

        def change(now: dict):
            live = {s["path"] for s in now["shards"]}
            fit = [(old, new) for old, new in merged if old <= live]  # others were merged by another writer meanwhile
            if not fit:
                return None
            gone = set().union(*(old for old, _ in fit))
            return now["schema"], [Shard(**s) for s in now["shards"] if s["path"] not in gone] + [s for _, new in fit for s in new]

        return self._retry(change)

    def _read(self, manifest: dict, shards: list[Shard]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default of the last one."""
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError("nothing was appended yet")
        return self._read(manifest, [Shard(**s) for s in manifest["shards"]])

    def vacuum(self, *, keep_versions: int = 1, older_than_seconds: float = 7 * 24 * 3600) -> int:
        """Delete data files that none of the last keep_versions versions names and that were written so long ago; returns how many.

        older_than_seconds must exceed the time of the longest job: younger files may belong to a writer that has not committed yet.
        Versions before those kept stay listed, but can't be read any more."""
        kept = self.versions()[-max(1, keep_versions) :]
        live = {s["path"] for v in kept for s in self.manifest(v)["shards"]}
        before = (time.time() - older_than_seconds) * 1000
        fs, gone = self._fs(), 0
        for folder in fs.listStatus(self._path(f"{self.root}/data")) if fs.exists(self._path(f"{self.root}/data")) else []:
            for s in fs.listStatus(folder.getPath()):
                path = s.getPath().toString()
                if s.isFile() and path not in live and path.endswith(".parquet") and s.getModificationTime() <= before:
                    fs.delete(s.getPath(), False)
                    gone += 1
        return gone

    def drop(self) -> None:
        """Delete the store with all its versions."""
        self._fs().delete(self._path(self.root), True)
