"""Type-2 dimension as plain Parquet folders, one commit record per run.

For tables of a format with row-level changes, `plans.rowlevel` merges in place; this store rewrites its folder.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import literal_mark, mark_text
from tidemark.operators.positions import last_positions, merged_positions, read_unseen
from tidemark.operators.scd2 import Scd2Spec, alters, dimension_columns, is_open, live, open_versions, scd2_merge, stage_changes
from tidemark.operators.splice import REPEATS, point_columns, splice
from tidemark.operators.watermark import read_increment
from tidemark.schemas import commit_schema
from tidemark.settings import DEFAULT_PIPELINE

#: Types of tie-break columns that a spliced dimension keeps; others are given by `tie_types`.
TIE_TYPES = {"seq": "bigint", "source_ts": "timestamp", "ingest_ts": "timestamp"}
#: Keys of a batch, for each bucket, up to which the dimension meets them by hash and is not sorted.
HASHED_KEYS = 200_000


class DimensionStore:
    """`versions/N` holds all rows of version N, bucketed by key; `staged/B` the batch of run B; `commits` one row
    per finished run, which is the watermark log too. Readers and the next run trust `commits` only, which is
    written last: what a stopped run left is not visible and is overwritten by the next one.

    A run stages its batch, joins it with the last version and writes the next one; a batch that alters nothing
    only advances the mark. The batch is shuffled, the dimension is not. Choose `buckets` so that one bucket fits a
    task; a store keeps its count until another is given. One writer per store is assumed.

    With `late="ignore"` a change older than its key's open row is left out. With `late="splice"` it is put between
    the versions that are there, so that the dimension depends on the batches but not on their order.

    `positions` names part and position columns: increments are then what lies behind the last positions read
    (`operators.positions`) instead of above the time mark. File times only spare reading, and are set back by
    `clock_slack`.

    With `view`, each run publishes what it committed under that name.
    """

    def __init__(
        self, spark: SparkSession, root: str, spec: Scd2Spec | None = None, pipeline: str = DEFAULT_PIPELINE,
        key_type: str = "int", ts_type: str = "timestamp", buckets: int | None = None, view: str | None = None,
        late: str = "ignore", positions: tuple[str, str] | None = None,
        clock_slack: dt.timedelta = dt.timedelta(hours=1), tie_types: Mapping[str, str] | None = None,
    ) -> None:
        if late not in ("ignore", "splice"):
            raise ValueError(f"unknown way to treat late changes {late!r}")
        self.spark, self.root, self.spec, self.pipeline = spark, root.rstrip("/"), spec or Scd2Spec(), pipeline
        self.key_type, self.ts_type, self.buckets, self.view = key_type, ts_type, buckets, view
        self.spliced, self.positions, self.clock_slack = late == "splice", positions, clock_slack
        self.tie_types = {**TIE_TYPES, **(tie_types or {})}
        self.commits_path = f"{self.root}/commits"
        # "ignore" writes the empty log only where none exists yet.
        spark.createDataFrame([], self.commit_schema).write.mode("ignore").parquet(self.commits_path)

    @property
    def commit_schema(self) -> T.StructType:
        return commit_schema(self.ts_type)

    @property
    def stored_schema(self) -> T.StructType:
        types = {**self.tie_types, self.spec.key: self.key_type, "is_current": "boolean", REPEATS: "boolean"}
        types |= dict.fromkeys((self.spec.order_by, "effective_from", "effective_to"), self.ts_type)
        types |= dict.fromkeys((*self.spec.tracked, "business_key", "hashdiff"), "string")
        names = point_columns(self.spec) if self.spliced else dimension_columns(self.spec)
        return T.StructType.fromDDL(", ".join(f"`{name}` {types[name]}" for name in names))

    # Reading

    def commits(self) -> DataFrame:
        log = self.spark.read.schema(self.commit_schema).parquet(self.commits_path)
        return log.where(F.col("pipeline") == self.pipeline)

    def last_batch(self, stream: str) -> int | None:
        """The last batch of a stream that is in the dimension."""
        return self.commits().where(F.col("stream") == stream).agg(F.max("batch_id")).first()[0]

    def last_commit(self) -> Row | None:
        """State after the newest finished run, with the high-water mark as text."""
        newest = F.max_by(F.struct("version", "run", "buckets", "positions", "read_at"), "run")
        row = self.commits().agg(newest.alias("at"), mark_text(F.max("updated_at_gte"), self.ts_type).alias("mark"))
        row = row.select("at.*", "mark").first()
        return None if row.version is None else row

    def stored(self, version: int, buckets: int) -> DataFrame:
        """All rows of a version with their bucketing, made known to Spark by an external table."""
        path, columns = f"{self.root}/versions/{version}", ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in self.stored_schema)
        table = _table_name(path)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"CLUSTERED BY (`{self.spec.key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def dimension(self) -> DataFrame:
        """Every committed version."""
        commit = self.last_commit()
        if commit is None:
            return self.spark.createDataFrame([], self.stored_schema).select(*dimension_columns(self.spec))
        rows = self.stored(commit.version, commit.buckets)
        rows = rows.where(~F.col(REPEATS)) if self.spliced else rows
        return live(rows, self.spec).select(*dimension_columns(self.spec))

    def current(self) -> DataFrame:
        return self.dimension().where("is_current")

    def current_at(self, version: int) -> DataFrame:
        """Current versions of a version that has not been expired."""
        first = self.commits().where(F.col("version") == version).agg(F.min_by("buckets", "run").alias("buckets")).first()
        return self.stored(version, first.buckets).where("is_current").select(*dimension_columns(self.spec))

    def moved(self, since: int, until: int) -> tuple[DataFrame, DataFrame]:
        """Versions that became current, and those that ceased to be, from one version to a later one.

        Read from the rows of the keys that the runs between staged; a row that did neither is in both.
        """
        between = self.commits().where((F.col("version") > since) & (F.col("version") <= until))
        batches = [f"{self.root}/staged/{row.run}" for row in between.select("run").collect()]
        keys = self.spark.read.parquet(*batches).select(self.spec.key).distinct()
        old, new = (self.current_at(v).join(keys, self.spec.key, "left_semi") for v in (since, until))
        return new, old

    # Writing

    def run(self, bronze: DataFrame, day_column: str | None = None, lookback: str | None = None) -> int | None:
        """Merges what the bronze table holds at or above the stored mark, or behind the stored positions; the
        dimension's version, or None where there is nothing new."""
        commit = self.last_commit()
        if self.positions is None:
            mark = literal_mark(commit.mark, self.ts_type) if commit else None
            return self._merge(commit, read_increment(bronze, mark, self.spec.order_by, day_column, lookback))
        started = self.spark.sql("SELECT current_timestamp()").first()[0]
        since = commit.read_at - self.clock_slack if commit and commit.read_at else None
        seen = (commit.positions or {}) if commit else {}
        changes = read_unseen(bronze, seen, *self.positions, day_column, since if day_column else None)
        read = last_positions(changes, *self.positions).first()
        if read.unplaced:
            raise ValueError(f"{read.unplaced} rows have no position in {self.positions[1]}")
        return self._merge(commit, changes, positions=merged_positions(seen, read.positions), read_at=started)

    def apply(self, changes: DataFrame, batch_id: int | None = None, stream: str = "") -> int | None:
        """Merges a batch of changes. An empty batch, or one of `stream` that is in already, changes nothing.

        Batch ids count per stream: a stream that starts anew needs another name.
        """
        if batch_id is not None:
            last = self.last_batch(stream)
            if last is not None and batch_id <= last:
                return None
        return self._merge(self.last_commit(), changes, batch_id, stream)

    def _merge(
        self, commit: Row | None, changes: DataFrame, batch_id: int | None = None, stream: str = "",
        positions: Mapping[str, int] | None = None, read_at: dt.datetime | None = None,
    ) -> int | None:
        run, version = (commit.run + 1, commit.version) if commit else (1, 0)
        staged = self._pin(changes, run)
        totals = self._judged(commit, staged).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if("alters").alias("altering"),
            mark_text(F.max(self.spec.order_by), self.ts_type).alias("mark")).first()
        if totals.rows == 0:
            return None
        buckets = self.buckets or (commit.buckets if commit else int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        if totals.altering:
            version += 1
            self._write_version(self._next_rows(commit, staged, totals.rows, buckets), version, buckets)
        elif commit:
            buckets = commit.buckets
        known = positions if positions is not None else (commit.positions if commit else None)
        self._commit((self.pipeline, totals.mark, version, run, buckets, batch_id, stream, known, read_at))
        if self.view:
            self.publish(self.view)
        return version

    def _pin(self, changes: DataFrame, run: int) -> DataFrame:
        """Writes the staged batch, so merge and watermark see the same rows while ingest goes on."""
        staged = stage_changes(changes, self.spec, with_ties=self.spliced)
        staged.write.mode("overwrite").parquet(f"{self.root}/staged/{run}")
        return self.spark.read.schema(staged.schema).parquet(f"{self.root}/staged/{run}")

    def _touched(self, commit: Row, staged: DataFrame) -> DataFrame:
        return self.stored(commit.version, commit.buckets).join(staged.select(self.spec.key), self.spec.key, "left_semi")

    def _judged(self, commit: Row | None, staged: DataFrame) -> DataFrame:
        """The staged rows with `alters`: whether the dimension changes by them."""
        if commit is None:
            return staged.withColumn("alters", F.lit(True))
        rows, key, time = self._touched(commit, staged), self.spec.key, self.spec.order_by
        old = (rows if self.spliced else rows.where(is_open(rows))).alias("old")
        on = F.col(f"new.{key}") == F.col(f"old.{key}")
        if not self.spliced:
            changed = alters("new.hashdiff", "old.hashdiff", F.col(f"new.{time}"), F.col(f"old.{time}"))
            joined = staged.alias("new").join(old, on, "left")
            return joined.select("new.*", (F.col(f"old.{key}").isNull() | changed).alias("alters"))
        for name in dict.fromkeys((time, *self.spec.final_order, "hashdiff")):
            on &= F.col(f"new.{name}").eqNullSafe(F.col(f"old.{name}"))
        return staged.alias("new").join(old, on, "left").select("new.*", F.col(f"old.{key}").isNull().alias("alters"))

    def _next_rows(self, commit: Row | None, staged: DataFrame, staged_rows: int, buckets: int) -> DataFrame:
        """All rows of the next version. What is kept is joined bucket by bucket, so it stays in few files."""
        key = self.spec.key
        if commit is None:
            rows = splice(staged, self.spec) if self.spliced else open_versions(staged, self.spec)
            return rows.repartition(buckets, key)
        touched = self._touched(commit, staged)
        rest = self.stored(commit.version, commit.buckets)
        asked = staged.select(F.col(key).alias("_asked")).hint(
            "shuffle_hash" if staged_rows <= HASHED_KEYS * commit.buckets else "merge")
        if self.spliced:
            rest = rest.join(asked, F.col(key) == F.col("_asked"), "left_anti")
            altered = splice(touched.select(*staged.columns).unionByName(staged), self.spec)
        else:
            rest = rest.join(asked, F.col(key) == F.col("_asked"), "left").where(~is_open(rest) | F.col("_asked").isNull())
            altered = scd2_merge(touched.where(is_open(touched)), staged, self.spec)
        if buckets != commit.buckets:
            rest = rest.repartition(buckets, key)
        names = self.stored_schema.names
        return rest.select(*names).unionByName(altered.select(*names).repartition(buckets, key))

    def _write_version(self, rows: DataFrame, version: int, buckets: int) -> None:
        path = f"{self.root}/versions/{version}"
        # What a stopped run left of this name; the table is external, so no files go.
        self.spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
        writer = rows.select(*self.stored_schema.names).write.mode("overwrite").bucketBy(buckets, self.spec.key)
        writer.option("path", path).saveAsTable(_table_name(path))

    def _commit(self, record: tuple) -> None:
        pipeline, mark, version, run, buckets, batch_id, stream, positions, read_at = record
        told = (version, run, buckets, batch_id, stream, positions, read_at)
        rest = self.spark.createDataFrame([told], T.StructType(self.commit_schema.fields[3:]))
        row = rest.select(
            F.lit(pipeline).alias("pipeline"), literal_mark(mark, self.ts_type).alias("updated_at_gte"),
            F.current_timestamp().alias("written_at"), "*")
        row.write.mode("append").parquet(self.commits_path)

    def expire(self, keep: int = 2) -> None:
        """Deletes all but the last `keep` versions, and batches before them; no reader may still use them."""
        rows = self.commits().groupBy("version").agg(F.min("run").alias("run")).orderBy(F.desc("version")).limit(keep).collect()
        for name, oldest in (("versions", rows[-1].version), ("staged", rows[-1].run)) if rows else ():
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for entry in files.listStatus(folder):
                if int(entry.getPath().getName()) < oldest:
                    files.delete(entry.getPath(), True)

    # Publishing

    def expose_staged(self, view: str) -> None:
        """A temporary view of the batch that the last finished run pinned."""
        self.spark.read.parquet(f"{self.root}/staged/{self.last_commit().run}").createOrReplaceTempView(view)

    def publish(self, view: str) -> None:
        """Points a catalog view at the committed versions."""
        commit = self.last_commit()
        if commit is None:
            raise ValueError("nothing has been committed yet")
        shown = [*["NOT repeats"] * self.spliced, *["hashdiff IS NOT NULL"] * (self.spec.deletes is not None)]
        where = f" WHERE {' AND '.join(shown)}" if shown else ""
        names = ", ".join(f"`{c}`" for c in dimension_columns(self.spec))
        self.spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT {names} FROM parquet.`{self.root}/versions/{commit.version}`{where}")


def _table_name(path: str) -> str:
    return f"tidemark_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
