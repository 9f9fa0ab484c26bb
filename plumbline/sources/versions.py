"""Keyed tables with versions: a write is seen whole or not at all, and a writer whose base has moved on starts again.

Layout of a table:

    <path>/data/<commit>/bucket=<n>/*.parquet    rows by key hash; a commit's folder is written once and never changed
    <path>/manifest/<version>.json               per bucket the commits that hold its rows and how many, the bucket count, notes

A version exists once its manifest does. The manifest is written aside and renamed to its number, and a rename onto a file that
exists fails, so of two writers with one base only one gets the next number. The other keeps its files if the versions in
between touched none of its buckets, else merges again on the new version. A writer that dies leaves files no manifest names;
readers never see them and `vacuum` deletes them.

A manifest is small, one entry per bucket, whatever the table holds; it is the only thing the driver reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.sinks import insert_absent, upsert

ROWS_PER_FILE = 2_000_000
ATTEMPTS = 20


class Moved(Exception):
    """The table, or something the write depends on, is no longer at the expected version."""


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    columns: str
    files: dict[str, list[str]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


def _hadoop(spark: SparkSession, path: str):
    """(file context, path) on whatever store the path names."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    where = jvm.Path(path)
    return jvm.FileContext.getFileContext(where.getFileSystem(conf).getUri(), conf), where


def with_bucket(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


class Table:
    """A keyed table at a path. Reads go to the newest version unless another one is named."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # versions

    def versions(self) -> list[int]:
        files, folder = _hadoop(self.spark, f"{self.path}/manifest")
        if not files.util().exists(folder):
            return []
        names = [status.getPath().getName() for status in files.util().listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith("."))

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> Manifest | None:
        version = self.version() if version is None else version
        if not version:
            return None
        text = self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()["value"]
        return Manifest(**json.loads(text))

    def _publish(self, manifest: Manifest) -> None:
        """Write the manifest and give it its number; `Moved` if the number is taken."""
        text = json.dumps(manifest.__dict__, sort_keys=True)
        files, aside = _hadoop(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        jvm = self.spark._jvm
        _, target = _hadoop(self.spark, f"{self.path}/manifest/{manifest.version:012d}.json")
        files.mkdir(aside.getParent(), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
        flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
        out = files.create(aside, flags, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
        out.write(bytearray(text.encode()))
        out.close()
        rename = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            files.rename(aside, target, rename)
        except Exception as error:
            files.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise Moved(f"{self.path} already has version {manifest.version}") from error
            raise

    # rows

    def _rows(self, manifest: Manifest | None, only: list[int] | None, empty: DataFrame | None) -> DataFrame:
        chosen = [] if manifest is None else [
            f"{self.path}/data/{commit}/bucket={bucket}" for bucket, commits in manifest.files.items() if only is None or int(bucket) in only for commit in commits
        ]
        if chosen:
            return self.spark.read.schema(manifest.columns).parquet(*chosen)
        if manifest is not None:
            return self.spark.createDataFrame([], manifest.columns)
        if empty is None:
            raise FileNotFoundError(f"{self.path} has no version")
        return empty.limit(0)

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version; with `keys` (the key columns) only of the buckets these fall into, which may hold others too."""
        manifest = self.manifest(version)
        only = None
        if keys is not None and manifest is not None:
            only = sorted(self._counts(with_bucket(keys, keys.columns, manifest.buckets)))
        return self._rows(manifest, only, None)

    @staticmethod
    def _counts(rows: DataFrame) -> dict[int, int]:
        """Rows per bucket: at most as many entries as buckets."""
        return {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}

    def _write(self, rows: DataFrame, keys: list[str], held: list[int]) -> tuple[str, dict[int, int]]:
        """One new commit folder: one shuffle by bucket and key hash, a bucket in as many tasks as the rows of the largest need.
        `held` is up to how many rows each bucket gets. Tables of more than one file have four tasks for each of theirs, so that
        seldom two fall together: a task sorts what it writes."""
        commit = uuid.uuid4().hex
        tasks = max(1, -(-max(held, default=0) // ROWS_PER_FILE))
        places = ("bucket", F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(tasks)))
        spread = rows.repartition(4 * tasks * len(held), *places) if sum(held) > ROWS_PER_FILE else rows.repartition(*places)
        spread.write.partitionBy("bucket").parquet(f"{self.path}/data/{commit}")
        files, folder = _hadoop(self.spark, f"{self.path}/data/{commit}")
        if not any(status.isDirectory() for status in files.util().listStatus(folder)):
            return commit, {}
        # footers only
        return commit, self._counts(self.spark.read.parquet(f"{self.path}/data/{commit}").select("bucket"))

    def commit(
        self, df: DataFrame, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int, replace: bool,
        expected: int | None = None, note: tuple[str, str] | None = None, still: Callable[[], bool] = lambda: True, columns: str | None = None,
    ) -> int:
        """Merge `df` into the buckets it falls into and publish the next version; returns the version that holds the rows.

        `merge(stored, incoming)` gives the rows to write, which replace the buckets (`replace`) or are added to them. With
        `expected` the write is refused when the table is at another version. `note` (name, value) is kept in the manifest; a
        write whose note is already there has been done before and changes nothing. `still` is asked right before publishing.
        `columns` are those of a table that does not exist yet, where they differ from those of `df`.
        """
        for _ in range(ATTEMPTS):
            base = self.manifest()
            at = base.version if base else 0
            if base and base.buckets != buckets:
                raise ValueError(f"{self.path} has {base.buckets} buckets, not {buckets}")
            if expected is not None and at != expected:
                raise Moved(f"{self.path} is at version {at}, not {expected}")
            if note and base and base.notes.get(note[0]) == note[1]:
                return at
            touched = self._counts(with_bucket(df, keys, buckets))
            if not touched and base:
                return at
            stored = self._rows(base, sorted(touched), self.spark.createDataFrame([], columns) if columns else df)
            merged = merge(stored, df)
            if base and {f.name for f in stored.schema} != {f.name for f in merged.schema}:
                raise ValueError(f"{self.path} has the columns {stored.columns}, not {merged.columns}")
            held = base.rows if base and replace else {}
            sizes = [n + held.get(str(b), 0) for b, n in touched.items()]
            commit, filled = self._write(with_bucket(merged, keys, buckets), keys, sizes)
            while True:
                files, rows = (dict(base.files), dict(base.rows)) if base else ({}, {})
                for name in [str(b) for b in touched if replace and b not in filled]:
                    files.pop(name, None), rows.pop(name, None)  # nothing is left of the bucket
                for bucket, n in filled.items():
                    name = str(bucket)
                    files[name], rows[name] = ([commit], n) if replace else ([*files.get(name, []), commit], rows.get(name, 0) + n)
                notes = {**(base.notes if base else {}), **(dict([note]) if note else {})}
                if not still():
                    raise Moved("what the write depends on has changed")
                layout = base.columns if base else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)
                try:
                    self._publish(Manifest(at + 1, buckets, layout, files, rows, notes))
                    return at + 1
                except Moved:
                    if expected is not None:
                        raise
                    newer = self.manifest()
                    old = base.files if base else {}
                    if newer.buckets != buckets or any(newer.files.get(str(b)) != old.get(str(b)) for b in touched) or note and newer.notes.get(note[0]) == note[1]:
                        break  # merge again on what is there now
                    base, at = newer, newer.version
        raise Moved(f"{self.path} moved on {ATTEMPTS} times")

    def upsert(self, df: DataFrame, keys: list[str], order: list[str], buckets: int = 64, **guards) -> int:
        """Insert or replace by key: the greatest `order` wins, incoming over stored on a tie."""

        return self.commit(df, keys, lambda stored, incoming: upsert(stored, incoming, keys, order), buckets, True, **guards)

    def insert_absent(self, df: DataFrame, keys: list[str], order: list[str], buckets: int = 64, **guards) -> int:
        """Add the rows whose key is not stored yet, of each key the first by `order`; stored files stay as they are."""

        return self.commit(df, keys, lambda stored, incoming: insert_absent(stored, incoming, keys, order), buckets, False, **guards)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the newest `keep` versions and the commits none of these names; returns the number of commits deleted.

        Not to be run beside a writer: its files are named by no manifest yet.
        """
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        named = {commit for m in kept for commits in m.files.values() for commit in commits}
        for version in versions[:-keep]:
            files, path = _hadoop(self.spark, f"{self.path}/manifest/{version:012d}.json")
            files.delete(path, False)
        files, data = _hadoop(self.spark, f"{self.path}/data")
        gone = [] if not files.util().exists(data) else [s.getPath() for s in files.util().listStatus(data) if s.getPath().getName() not in named]
        for path in gone:
            files.delete(path, True)
        return len(gone)


def publish_guarded(
    results: DataFrame, inputs: Table, outputs: Table, keys: list[str], version: str = "input_hash", buckets: int = 64, attempts: int = ATTEMPTS,
) -> DataFrame:
    """Publish the results whose inputs are still current, and return the others, which go back to the work list.

    A result carries in `version` the hash of the inputs it was computed from; `inputs` holds the hash that is current now. The
    rows are checked against one version of `inputs`, and the outputs are only published while `inputs` is still there; else
    they are checked again.
    """
    for _ in range(attempts):
        at = inputs.version()
        current = inputs.read(at).select(*keys, F.col(version).alias("_now"))
        checked = results.join(current, keys, "left").withColumn("_ok", F.coalesce(F.col(version) == F.col("_now"), F.lit(False))).drop("_now")
        try:
            outputs.upsert(checked.where("_ok").drop("_ok"), keys, [], buckets, still=lambda at=at: inputs.version() == at)
        except Moved as moved:
            if "depends" not in str(moved):
                raise
            continue
        return checked.where(~F.col("_ok")).drop("_ok")
    raise Moved(f"{inputs.path} moved on {attempts} times")

