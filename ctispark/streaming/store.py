"""Stored tables that batches keep current: buckets of keys, of which a batch rewrites those it touches, and a manifest a commit.

A store is a folder: NAME/vN/__bucket=K are the rows of table NAME whose keys
hash to K, as batch N wrote them; manifests/N.json says which N holds each
bucket of each table, and which later ones added rows to it. A manifest is
written under another name and renamed, so readers see all tables before a
batch or all tables after it, and a batch that failed halfway has written
nothing that is read. Bytes written by a batch are those of the buckets that its
keys fall into, whatever the size of the table, and of rows that it only adds
no more than these.
"""

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType



@dataclass(frozen=True)
class Added:
    """Rows that a merge adds to what a table holds, none of which changes."""

    rows: DataFrame


Tables = dict[str, DataFrame]
BUCKET = "__bucket"
#: Tables of a commit that are written at one time.
WRITERS = 4
#: A bucket that batches have added to so often is rewritten by the next one, so that its files stay few.
ADDED = 8


class Store:
    """Tables that share a key. buckets: so many that a bucket of the largest table fits a task; fixed when the store is first written.

    gather=False is for few buckets of tables of any size: no task gets a whole
    bucket, each writes its rows of a bucket as a file, and nothing is moved for it.
    """

    def __init__(self, spark: SparkSession, root: str, key: tuple[str, ...], buckets: int = 64, keep: int = 2, gather: bool = True) -> None:
        self.spark, self.root, self.key, self.keep, self.gather = spark, root.rstrip("/"), key, keep, gather
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest = self._newest()
        self.buckets = self.manifest["buckets"] if self.manifest else buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith(("_", ".")))

    def _load(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version}.json", wholetext=True).first()[0])

    def _newest(self) -> dict | None:
        versions = self._versions()
        return self._load(versions[-1]) if versions else None

    def bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _held(table: dict) -> list[tuple[int, str]]:
        """(version, bucket) of all that a manifest's entry names."""
        return [(v, b) for b, v in table["buckets"].items()] + [(v, b) for b, more in table.get("added", {}).items() for v in more]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as of the newest manifest, or those buckets of it; None if it was never written."""
        held = (self.manifest or {"tables": {}})["tables"].get(name)
        if held is None:
            return None
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.root}/{name}/v{v}/{BUCKET}={b}" for v, b in self._held(held) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: int, touched: DataFrame | None, merge: Callable[[Tables], dict[str, DataFrame | Added]], query: str | None = None) -> bool:
        """Rewrites the buckets of touched's keys (None: all buckets), as one commit; False if the batch was committed before.

        merge gets what these buckets hold of each table, and returns the tables
        that change: rows of touched keys only, beside what it was given, or
        Added rows alone. touched is read once here, and by merge as often as it
        likes. A table that merge doesn't return stays. Another query than the
        first is refused: its batches would be taken for those of the first.
        """
        self.manifest = self._newest()
        last = self.manifest or {"batch": -1, "query": query, "buckets": self.buckets, "tables": {}}
        if query and last["query"] and query != last["query"]:
            raise ValueError(f"{self.root} was written by query {last['query']}; start again with its checkpoint, or with a new table")
        if batch <= last["batch"]:
            return False
        hit = list(range(self.buckets)) if touched is None else [r[0] for r in touched.select(self.bucket().alias("b")).distinct().collect()]
        tables = dict(last["tables"])
        old = {name: self.read(name, hit) for name in tables}
        # tables are written side by side: their jobs are small and independent
        with ThreadPoolExecutor(max_workers=WRITERS) as pool:
            for name, held in pool.map(lambda x: (x[0], self._write(*x, batch, set(hit), tables.get(x[0]))), merge(old).items()):
                tables[name] = held
        self._publish({"batch": batch, "query": last["query"] or query, "buckets": self.buckets, "tables": tables})
        self.vacuum()
        return True

    def _write(self, name: str, rows: DataFrame | Added, batch: int, hit: set[int], before: dict | None) -> dict:
        """Writes a table's touched buckets, or what is added to them; its entry in the manifest."""
        before = before or {"buckets": {}}
        older, added = before["buckets"], before.get("added", {})
        more = isinstance(rows, Added)
        if more:
            kinds = lambda schema: [(f.name, f.dataType) for f in schema]
            old, rows = self.read(name, list(hit)), rows.rows
            if old is not None and (kinds(old.schema) != kinds(rows.schema) or any(len(added.get(str(b), [])) >= ADDED for b in hit)):
                rows, more = old.unionByName(rows), False
        place = f"{name}/v{batch}"
        out = rows.withColumn(BUCKET, self.bucket())
        (out.repartition(BUCKET) if self.gather else out).write.partitionBy(BUCKET).mode("overwrite").parquet(f"{self.root}/{place}")
        written = [n.removeprefix(f"{BUCKET}=") for n in self._names(place) if n.startswith(f"{BUCKET}=")]
        if stray := {int(b) for b in written} - hit:
            raise ValueError(f"the merge of {name} returned keys that the batch doesn't touch (buckets {sorted(stray)[:5]})")
        if more:
            return {"schema": json.loads(rows.schema.json())} | before | {"added": added | {b: [*added.get(b, []), batch] for b in written}}
        stays = lambda entries: {b: v for b, v in entries.items() if int(b) not in hit}
        return {"buckets": stays(older) | dict.fromkeys(written, batch), "added": stays(added), "schema": json.loads(rows.schema.json())}

    def _publish(self, manifest: dict) -> None:
        draft, final = self._path(f"manifests/_{manifest['batch']}.draft"), self._path(f"manifests/{manifest['batch']}.json")
        out = self.fs.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not self.fs.rename(draft, final):
            raise OSError(f"batch {manifest['batch']} of {self.root} can't be published: another writer was there first")
        self.manifest = manifest

    def vacuum(self) -> None:
        """Removes what none of the newest manifests (keep of them, for readers that began with an older one) names."""
        versions = self._versions()
        for version in versions[: -self.keep]:
            self.fs.delete(self._path(f"manifests/{version}.json"), False)
        held = [self._load(v)["tables"] for v in versions[-self.keep :]]
        for name in {n for tables in held for n in tables}:
            used = {x for tables in held for x in self._held(tables.get(name, {"buckets": {}}))}
            for folder in self._names(name):
                version = int(folder[1:])
                gone = [n for n in self._names(f"{name}/{folder}") if n.startswith(f"{BUCKET}=") and (version, n.removeprefix(f"{BUCKET}=")) not in used]
                if version <= versions[-1]:
                    for n in gone:
                        self.fs.delete(self._path(f"{name}/{folder}/{n}"), True)
                    if not any(v == version for v, _ in used):
                        self.fs.delete(self._path(f"{name}/{folder}"), True)
