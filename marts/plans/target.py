"""A keyed target on Parquet files with atomic commits.

Built-in Parquet tables refuse ``MERGE INTO``; this class gives them a keyed
upsert. Where the catalog has a table format with MERGE, use
:func:`marts.plans.catalog.merge_into` instead.

Layout below the target's folder::

    manifests/manifest-00000007.json   version 7: bucket -> files, schema, cursors
    data/<snapshot>/*.parquet          Spark bucket files, hashed and sorted by key
    staging/<id>/                      deduplicated incoming rows of one upsert

An upsert rewrites the buckets its keys fall into, into a new snapshot folder,
and then publishes one manifest that holds data and checkpoint. Nothing is
visible before that, so a lost executor, a failed job or a crash leaves the old
version and the old checkpoint.

A version that lies in one snapshot is read as a Spark bucketed table: merging
into it, and joining or grouping it by key, needs no shuffle of the target.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checks import not_null_rules, violated
from ..operators.conform import document, match_names, project
from ..operators.cursor import Cursor
from ..operators.merge import free_name, latest_rows, upsert_rows
from ..operators.widen import as_schema, grown, inexact
from ..session import require_ansi
from .spec import TargetSpec
from .storage import Folder

# A bucket is one task's work in a merge.
BUCKET_BYTES = 128 << 20
# Below this, a table is not worth more tasks.
_SMALL_BYTES = 1 << 20
_MAX_ATTEMPTS = 8
# More snapshots than this make the next upsert rewrite all buckets into one.
_MAX_SNAPSHOTS = 32
# Spark ends the name of a bucket's file with the bucket number.
_BUCKET_FILE = re.compile(r"part-.*_(\d+)(?:\..*)?")


class ConcurrentChange(RuntimeError):
    """Another run of the same job moved its checkpoint meanwhile."""


@dataclass(frozen=True)
class Files:
    """Where one bucket's rows are."""

    snapshot: str
    names: tuple[str, ...]


@dataclass(frozen=True)
class Manifest:
    """One published version. Its size is bounded by the number of buckets."""

    version: int
    buckets: int | None = None
    schema: T.StructType | None = None
    files: dict[int, Files] = field(default_factory=dict)
    cursors: dict[str, Cursor] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    # Of snapshots written when a field was narrower: the types in their files.
    types: dict[str, T.StructType] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(
            {
                "version": self.version,
                "buckets": self.buckets,
                "schema": self.schema.jsonValue() if self.schema else None,
                "files": {b: [f.snapshot, *f.names] for b, f in self.files.items()},
                "cursors": {job: cursor.to_json() for job, cursor in self.cursors.items()},
                "streams": self.streams,
                "types": {name: types.jsonValue() for name, types in self.types.items()},
            }
        )

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        value = json.loads(text)
        return cls(
            version=value["version"],
            buckets=value["buckets"],
            schema=T.StructType.fromJson(value["schema"]) if value["schema"] else None,
            files={
                int(bucket): Files(entry[0], tuple(entry[1:]))
                for bucket, entry in value["files"].items()
            },
            cursors={job: Cursor(**cursor) for job, cursor in value["cursors"].items()},
            streams=value["streams"],
            types={n: T.StructType.fromJson(t) for n, t in value.get("types", {}).items()},
        )

    def snapshots(self) -> set[str]:
        return {files.snapshot for files in self.files.values()}


@dataclass(frozen=True)
class Staged:
    """Checked, deduplicated incoming rows, written but not yet visible."""

    schema: T.StructType
    buckets: int
    touched: tuple[int, ...]
    rows_sent: int
    folder: str | None = None
    snapshot: str | None = None  # already laid out as buckets of an empty target
    order: tuple[str, ...] = ()  # what the target stores of the order, if all of it


@dataclass(frozen=True)
class Merged:
    """New files of the rewritten buckets, and the old ones they replace."""

    buckets: int
    new: dict[int, Files]
    old: dict[int, Files | None]
    schema: T.StructType  # in the new files

    def fits(self, base: Manifest) -> bool:
        """True if nothing this merge has read was changed since."""
        same = all(base.files.get(bucket) == files for bucket, files in self.old.items())
        return same and base.buckets in (None, self.buckets)


@dataclass(frozen=True)
class UpsertResult:
    version: int
    rows_written: int
    buckets_touched: int


class MartTable:
    def __init__(
        self, spark: SparkSession, root: str, spec: TargetSpec, attempts: int = _MAX_ATTEMPTS
    ) -> None:
        """``attempts``: tries to publish a finished merge against other writers."""
        self.spark = spark
        self.attempts = attempts
        self.spec = spec
        self.folder = Folder(spark, f"{root.rstrip('/')}/{spec.name}")
        declared = spec.struct()
        if spec.mode == "replace" and not set(spec.key) <= set(declared.names):
            raise ValueError(f"key {spec.key} is not in the schema of target {spec.name}")

    # -- versions -----------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(
            int(name[len("manifest-") : -len(".json")])
            for name, _ in self.folder.entries("manifests")
            if name.startswith("manifest-") and name.endswith(".json")
        )

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max(self.versions(), default=0)
            if not version:
                return Manifest(0)
        return Manifest.from_json(self.folder.read(_manifest_name(version)))

    def cursor(self, job_id: str) -> Cursor | None:
        return self.manifest().cursors.get(job_id)

    def read(self, version: int | None = None) -> DataFrame:
        """The target as of a version (the latest one by default)."""
        manifest = self.manifest(version)
        return self._read(manifest)

    def _read(
        self, manifest: Manifest, buckets: Sequence[int] | None = None
    ) -> DataFrame:
        """The rows of some buckets, or of all."""
        schema = manifest.schema or self.spec.struct()
        if schema is None:
            raise ValueError(f"target {self.spec.name} was never written")
        if not manifest.files or (buckets is not None and not buckets):
            return self.spark.createDataFrame([], _nullable(schema))
        snapshots = manifest.snapshots()
        if buckets is None and len(snapshots) == 1:
            # Holds: a snapshot's buckets are only ever replaced, and a bucket
            # replaced would have added a second snapshot.
            snapshot = snapshots.pop()
            types = manifest.types.get(snapshot, schema)
            return as_schema(self._read_bucketed(snapshot, manifest.buckets, types), _nullable(schema))
        by_type: dict[str, list[str]] = {}
        for bucket in manifest.files if buckets is None else buckets:
            files = manifest.files[bucket]
            types = manifest.types.get(files.snapshot, schema)
            paths = by_type.setdefault(_nullable(types).json(), [])
            paths.extend(self.folder.at(f"data/{files.snapshot}/{name}") for name in files.names)
        frames = [
            as_schema(self.spark.read.schema(T.StructType.fromJson(json.loads(types))).parquet(*paths), _nullable(schema))
            for types, paths in by_type.items()
        ]
        return reduce(DataFrame.unionAll, frames)

    def _read_bucketed(self, snapshot: str, buckets: int, schema: T.StructType) -> DataFrame:
        name = _lent_name()
        key = ", ".join(f"`{column}`" for column in self.spec.key)
        path = self.folder.at(f"data/{snapshot}").replace("'", "\\'")
        # An external table only lends its bucketing to the frame: dropping the
        # name leaves the files alone.
        self.spark.sql(
            f"CREATE TABLE {name} ({_nullable(schema).toDDL()}) USING parquet "
            f"OPTIONS (path '{path}') CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS"
        )
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    # -- upsert -------------------------------------------------------------

    def upsert(
        self, df: DataFrame, order: Sequence[str] = (), now: datetime | None = None
    ) -> UpsertResult:
        """Insert or update ``df`` by key and publish the result."""
        return self.publish(self.stage(df, order, now))

    def stage(
        self,
        df: DataFrame,
        order: Sequence[str] = (),
        now: datetime | None = None,
        is_empty: Callable[[], bool] = lambda: False,
    ) -> Staged:
        """Run the incoming plan once: fit, check, deduplicate, write aside.

        Counts come from the written rows, not from accumulators, so they stay
        exact when Spark repeats tasks. ``is_empty`` is asked after the write; a
        caller that then knows of no rows spares the look at them.
        """
        require_ansi(self.spark)
        base = self.manifest()
        rows, ranking = self._conform(df, order, now, base)
        carried = [name for name in ranking if name not in order]
        present = T.StructType([f for f in self._declared().fields if f.name in rows.columns])
        rules = {**not_null_rules(present, self.spec.key), **self.spec.rules}
        broken = [free_name(f"_broken_{i}", rows.columns) for i in range(len(rules))]
        counters = {n: F.count_if(violated(rule)) for n, rule in zip(broken, rules.values(), strict=True)}
        sent = free_name("_sent", rows.columns)
        unique = latest_rows(rows, self.spec.key, ranking, counters, sent).drop(*carried)
        schema = T.StructType([f for f in rows.schema.fields if f.name not in carried])
        buckets = base.buckets or self.spec.buckets
        name = _new_id()
        if buckets and not base.files:
            path = f"data/{name}"
            if buckets % _shuffle_width(self.spark):
                unique = unique.repartition(buckets, *self.spec.key)
            # Otherwise the grouping above has already put every bucket whole
            # into one task.
            self._write_buckets(unique, buckets, name)
        else:
            path = f"staging/{name}"
            unique.write.parquet(self.folder.at(path))
            buckets = buckets or self._bucket_count(self.folder.size(path))
        if is_empty():
            self.folder.delete(path)
            return Staged(schema, buckets, (), 0)
        try:
            touched, rows_sent = self._inspect(
                path, buckets, unique.schema, dict(zip(broken, rules, strict=True)), sent, order
            )
        except Exception:
            self.folder.delete(path)
            raise
        laid_out = path.startswith("data/")
        return Staged(
            schema=schema,
            buckets=buckets,
            touched=touched,
            rows_sent=rows_sent,
            folder=None if laid_out else path,
            snapshot=name if laid_out else None,
            order=() if carried else tuple(order),
        )

    def publish(
        self,
        staged: Staged,
        job_id: str | None = None,
        start: Cursor | None = None,
        cursor: Cursor | None = None,
        stream: tuple[str, int] | None = None,
    ) -> UpsertResult:
        """Merge staged rows and publish them with the checkpoint in one step.

        Of two writers on one version the second finds the manifest taken; it
        keeps its files if the buckets it read are unchanged, else merges again.
        """
        if not staged.touched and cursor is None and stream is None:
            self._discard(staged)
            return UpsertResult(self.manifest().version, 0, 0)
        self._grow(staged)
        merged: Merged | None = None
        for _ in range(self.attempts):
            base = self.manifest()
            if cursor is not None and base.cursors.get(job_id) != start:
                self._discard(staged)
                raise ConcurrentChange(f"job {job_id!r} was advanced by another run")
            if stream is not None and base.streams.get(stream[0], -1) >= stream[1]:
                self._discard(staged)
                return UpsertResult(base.version, 0, 0)
            if staged.touched and (merged is None or not merged.fits(base)):
                merged = self._merge(base, staged)
            result = self._successor(base, staged, merged)
            if cursor is not None:
                result.cursors[job_id] = cursor
            if stream is not None:
                result.streams[stream[0]] = stream[1]
            try:
                self.folder.publish(_manifest_name(result.version), result.to_json())
            except FileExistsError:
                continue
            if staged.folder:
                self.folder.delete(staged.folder)
            return UpsertResult(result.version, staged.rows_sent, len(staged.touched))
        self._discard(staged)
        raise ConcurrentChange(f"target {self.spec.name}: no free version")

    def _discard(self, staged: Staged) -> None:
        if staged.folder:
            self.folder.delete(staged.folder)

    def _grow(self, staged: Staged) -> None:
        """Let the bucket count follow the target's size, unless the spec fixes it.

        Rewrites the target when its bytes ask for twice the buckets or more, so
        over its whole growth every row is rewritten about once more.
        """
        base = self.manifest()
        if self.spec.buckets or not base.files or not staged.folder:
            return
        size = sum(self.folder.size(f"data/{name}") for name in base.snapshots())
        wanted = self._bucket_count(size + self.folder.size(staged.folder))
        if wanted >= 2 * base.buckets:
            with contextlib.suppress(FileExistsError):  # another writer was faster
                self.rebucket(wanted)

    def _declared(self) -> T.StructType:
        return self.spec.struct() or T.StructType([])

    def _fixed(self) -> frozenset[str]:
        """Columns whose type never grows."""
        return frozenset([*self._declared().names, *self.spec.key])

    def _conform(
        self, df: DataFrame, order: Sequence[str], now: datetime | None, base: Manifest
    ) -> tuple[DataFrame, list[str]]:
        """Rows in the target's shape, and the columns that rank equal keys. An
        order column the target drops or changes is carried along hidden."""
        stored = base.schema.names if base.schema else []
        df = match_names(df, [*self._declared().names, *stored, *self.spec.key, *order])
        absent = [name for name in order if name not in df.columns]
        if absent:
            raise ValueError(f"rows lack order columns {absent}")
        if self.spec.mode == "replace":
            now = now or datetime.now(timezone.utc)

            def fit(frame: DataFrame, carry: Sequence[str]) -> DataFrame:
                return project(
                    frame, self.spec.struct(), self.spec.required_columns(),
                    self.spec.load_time, now, carry,
                )
        else:
            known = {f.name: f for f in self._declared().fields}
            if base.schema:
                given = document(df, self._declared(), self.spec.key).schema
                stored = self._grow_types(base, given)
                known.update({f.name: f for f in stored.fields})

            def fit(frame: DataFrame, carry: Sequence[str]) -> DataFrame:
                fields = T.StructType(list(known.values()))
                return document(frame, fields, self.spec.key, carry)

        kept = fit(df, ()).schema
        hidden = {
            name: free_name(f"_order_{i}", df.columns)
            for i, name in enumerate(order)
            if name == self.spec.load_time
            or name not in kept.names
            or kept[name].dataType != df.schema[name].dataType
        }
        if hidden:
            df = df.withColumns({alias: F.col(name) for name, alias in hidden.items()})
        rows = fit(df, tuple(hidden.values()))
        return rows, [hidden.get(name, name) for name in order]

    def _grow_types(self, base: Manifest, given: T.StructType) -> T.StructType:
        """The stored schema, wide enough for ``given``. Declared fields keep their type."""
        try:
            schema = grown(base.schema, given, self._fixed())
        except ValueError as error:
            raise ValueError(f"target {self.spec.name}: {error}") from None
        lost = {
            f.name: inexact(F.col(f"`{f.name}`"), base.schema[f.name].dataType, f.dataType)
            for f in schema.fields
        }
        lost = {name: where for name, where in lost.items() if where is not None}
        if lost and base.files:  # once per field: it is a double from then on
            counts = self._read(base).agg(*(F.count_if(w).alias(n) for n, w in lost.items())).first()
            for name in lost:
                if counts[name]:
                    raise ValueError(
                        f"target {self.spec.name}: {counts[name]} values of field {name!r} would lose digits as double"
                    )
        return schema

    def _inspect(
        self,
        path: str,
        buckets: int,
        schema: T.StructType,
        rules: dict[str, str],
        sent: str,
        order: Sequence[str],
    ) -> tuple[tuple[int, ...], int]:
        """Touched buckets and row count of what was written; raises on bad rows.
        Reads the counter columns only and returns one row per bucket."""
        null_key = F.lit(False)
        for name in self.spec.key:
            null_key = null_key | F.col(name).isNull()
        written = self.spark.read.schema(_nullable(schema)).parquet(self.folder.at(path))
        bucket = F.pmod(F.hash(*self.spec.key), F.lit(buckets))
        per_bucket = written.groupBy(bucket.alias("bucket")).agg(
            F.sum(sent).alias("sent"),
            F.coalesce(F.sum(F.when(null_key, F.col(sent))), F.lit(0)).alias("null_keys"),
            F.count_if(F.col(sent) > 1).alias("repeated"),
            *[F.sum(name).alias(name) for name in rules],
        )
        found = per_bucket.collect()
        problems = []
        null_keys = sum(row["null_keys"] for row in found)
        if null_keys:
            problems.append(f"{null_keys} rows with a NULL key {self.spec.key}")
        repeated = sum(row["repeated"] for row in found)
        if repeated and not order:
            problems.append(f"{repeated} keys are repeated and no order decides which row is last")
        for name, rule in rules.items():
            broken = sum(row[name] for row in found)
            if broken:
                problems.append(f"{broken} rows break rule {rule!r}")
        if problems:
            raise ValueError(f"target {self.spec.name}: " + "; ".join(problems))
        touched = tuple(sorted(row["bucket"] for row in found))
        return touched, sum(row["sent"] for row in found)

    def _merge(self, base: Manifest, staged: Staged) -> Merged:
        """Write the next version of the buckets the staged rows fall into."""
        if staged.snapshot and not base.files and base.buckets in (None, staged.buckets):
            written = self._files(staged.snapshot)
            return Merged(staged.buckets, written, dict.fromkeys(written), staged.schema)
        buckets = base.buckets or staged.buckets
        touched = _touched(staged, buckets)
        new = self.spark.read.schema(_nullable(staged.schema)).parquet(
            self.folder.at(staged.folder or f"data/{staged.snapshot}")
        )
        existing = [bucket for bucket in touched if bucket in base.files]
        # A rewrite of most buckets takes in the rest: the version then lies in
        # one snapshot and stays bucketed for its readers and the next merge.
        whole = 2 * len(existing) >= len(base.files) or len(base.snapshots()) >= _MAX_SNAPSHOTS
        if whole:
            existing = list(base.files)
        # Spark's hash partitioning and its bucket number are the same function,
        # and the width divides the bucket count: a bucket is whole in one task,
        # joined and written without another shuffle.
        width = buckets if whole else min(buckets, _power_of_two(4 * len(touched)))
        new = new.repartition(width, *self.spec.key)
        if existing:
            old = self._read(base, None if whole else existing)
            if not whole or len(base.snapshots()) > 1:
                old = old.repartition(width, *self.spec.key)
            new = upsert_rows(old, new, self.spec.key, staged.order)
        schema = _merged_schema(base.schema, staged.schema, self._fixed())
        snapshot = _new_id()
        self._write_buckets(as_schema(new, schema), buckets, snapshot)
        written = self._files(snapshot)
        replaced = {*existing, *touched}
        if set(written) != replaced:
            raise RuntimeError(f"wrote buckets {sorted(written)}, expected {sorted(replaced)}")
        return Merged(buckets, written, {b: base.files.get(b) for b in replaced}, schema)

    def _write_buckets(self, df: DataFrame, buckets: int, snapshot: str) -> None:
        name = _lent_name()
        writer = df.write.format("parquet").bucketBy(buckets, *self.spec.key)
        writer = writer.sortBy(*self.spec.key).option("path", self.folder.at(f"data/{snapshot}"))
        try:
            writer.saveAsTable(name)
        finally:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")

    def _files(self, snapshot: str) -> dict[int, Files]:
        names: dict[int, list[str]] = {}
        for name, _ in self.folder.entries(f"data/{snapshot}"):
            match = _BUCKET_FILE.fullmatch(name)
            if match:
                names.setdefault(int(match.group(1)), []).append(name)
        return {bucket: Files(snapshot, tuple(found)) for bucket, found in names.items()}

    def _successor(self, base: Manifest, staged: Staged, merged: Merged | None) -> Manifest:
        schema, buckets, files = base.schema, base.buckets, dict(base.files)
        types = {name: base.types.get(name, schema) for name in base.snapshots()}
        if merged is not None:
            schema = _merged_schema(base.schema, staged.schema, self._fixed())
            buckets = merged.buckets
            files.update(merged.new)
            types.update({f.snapshot: merged.schema for f in merged.new.values()})
        live = {f.snapshot for f in files.values()}
        return replace(
            base,
            version=base.version + 1,
            buckets=buckets,
            schema=schema,
            files=files,
            types={n: t for n, t in types.items() if n in live and _narrower(t, schema)},
            cursors=dict(base.cursors),
            streams=dict(base.streams),
        )

    def _bucket_count(self, size: int) -> int:
        cores = self.spark.sparkContext.defaultParallelism
        wanted = _power_of_two(max(size // BUCKET_BYTES, min(cores, size // _SMALL_BYTES), 1))
        most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        return min(wanted, 1 << (most.bit_length() - 1))

    # -- maintenance --------------------------------------------------------

    def reset(self) -> None:
        """Publish an empty version without checkpoints."""
        base = self.manifest()
        self.folder.publish(
            _manifest_name(base.version + 1), Manifest(base.version + 1).to_json()
        )

    def rebucket(self, buckets: int) -> None:
        """Rewrite the target with another bucket count as it grows; raises
        FileExistsError if another writer published meanwhile."""
        base = self.manifest()
        if not base.files:
            raise ValueError("nothing to rewrite")
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("the bucket count must be a power of two")
        snapshot = _new_id()
        rows = self._read(base).repartition(buckets, *self.spec.key)
        self._write_buckets(rows, buckets, snapshot)
        result = replace(
            base, version=base.version + 1, buckets=buckets, files=self._files(snapshot), types={}
        )
        self.folder.publish(_manifest_name(result.version), result.to_json())

    def vacuum(self, keep: int = 2, orphan_age: timedelta = timedelta(days=7)) -> list[str]:
        """Drop versions before the last ``keep`` and the snapshots only they
        list. Snapshots and staging folders no version lists belong to running
        or crashed writers and go once they are older than ``orphan_age``."""
        if keep < 1:
            raise ValueError("keep at least one version")
        versions = self.versions()
        kept, dropped = versions[-keep:], versions[:-keep]
        live = {snapshot for v in kept for snapshot in self.manifest(v).snapshots()}
        dead = {snapshot for v in dropped for snapshot in self.manifest(v).snapshots()} - live
        oldest = (time.time() - orphan_age.total_seconds()) * 1000
        doomed = []
        for name, modified in self.folder.entries("data"):
            if name in dead or (name not in live and modified < oldest):
                doomed.append(f"data/{name}")
        for name, modified in self.folder.entries("staging"):
            if modified < oldest:
                doomed.append(f"staging/{name}")
        doomed.extend(_manifest_name(version) for version in dropped)
        for name in doomed:
            self.folder.delete(name)
        return doomed


def _manifest_name(version: int) -> str:
    return f"manifests/manifest-{version:08d}.json"


def _lent_name() -> str:
    """A catalog name that lives for one statement."""
    return f"spark_catalog.default.marts_{_new_id()}"


def _new_id() -> str:
    return uuid.uuid4().hex


def _power_of_two(value: int) -> int:
    """The smallest power of two that is at least ``value``."""
    return 1 << max(value - 1, 0).bit_length()


def _shuffle_width(spark: SparkSession) -> int:
    """Partitions of a planned shuffle, before adaptive execution joins some."""
    width = spark.conf.get("spark.sql.shuffle.partitions")
    if spark.conf.get("spark.sql.adaptive.enabled", "true").lower() == "true":
        width = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", width)
    return int(width)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _merged_schema(old: T.StructType | None, new: T.StructType, fixed: frozenset[str]) -> T.StructType:
    if old is None:
        return _nullable(new)
    added = [f for f in new.fields if f.name not in old.names]
    return _nullable(T.StructType(list(grown(old, new, fixed).fields) + added))


def _narrower(types: T.StructType, schema: T.StructType) -> bool:
    return any(f.dataType != schema[f.name].dataType for f in types.fields)


def _touched(staged: Staged, buckets: int) -> list[int]:
    """The staged rows' buckets in a target of another bucket count. Counts are
    powers of two, so the smaller one is a remainder of the larger."""
    if buckets <= staged.buckets:
        return sorted({bucket % buckets for bucket in staged.touched})
    return sorted(
        bucket for low in staged.touched for bucket in range(low, buckets, staged.buckets)
    )
