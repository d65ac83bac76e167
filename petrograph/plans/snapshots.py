"""Versioned snapshots that replace only what changed.

A store is one stable folder::

    <root>/data/<entity>/v=<version>/<partition column>=<value>/part-...   rows
    <root>/versions/v=<version>/...            manifest: entity, part, version, n, mark
    <root>/CURRENT                             the version that readers use

Each entity is cut into parts (days, months, or one).  A part's mark is the number of its rows and an
order-free hash of them, found in one partially aggregated pass.  Parts whose mark is the former
snapshot's keep their files; only the others are written, into a folder of the new version; parts that are
gone leave the manifest.  ``CURRENT`` is replaced last, so a write that fails at any point before leaves the
former snapshot as it was, and what it wrote is in folders that nobody reads.

The rows written are counted while they are written (``observe``) and held against the marks; the
manifest has a row per entity and part, and only the list of changed parts is known to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WHOLE = "all"
_MANIFEST = "entity string, part string, version long, n long, mark long"


def mark_of(df: DataFrame) -> list[Column]:
    """n, mark: rows and their order-free hash (equal rows don't cancel out: each hash is added, not xored)."""
    row = F.pmod(F.xxhash64(*[F.to_json(F.struct(c)) if df.schema[c].dataType.typeName() in ("map",) else F.col(c)
                              for c in df.columns]), F.lit(2 ** 31 - 1))
    return [F.count(F.lit(1)).alias("n"), F.sum(row).cast("long").alias("mark")]


class SnapshotStore:
    """The snapshots in one folder.  ``parts``: entity -> (partition column, its expression over the rows)."""

    def __init__(self, spark: SparkSession, root: str, parts: dict[str, tuple[str, Column]] | None = None,
                 max_records_per_file: int = 5_000_000):
        self.spark, self.root, self.parts, self.max_records = spark, root.rstrip("/"), parts or {}, max_records_per_file
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # -- versions --------------------------------------------------------------------------
    def current(self) -> int | None:
        """The version that readers use; None before the first."""
        pointer = self._path("CURRENT")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return int(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/versions/v={version}")

    def _publish(self, version: int) -> None:
        """Point at the version: write beside the pointer, then take its place in one step."""
        fresh, pointer = self._path(f"CURRENT.{version}"), self._path("CURRENT")
        out = self._fs.create(fresh, True)
        out.write(bytearray(str(version).encode()))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(),
                                                                            self.spark._jsc.hadoopConfiguration())
        replace = self.spark.sparkContext._gateway.new_array(options, 1)
        replace[0] = options.OVERWRITE
        context.rename(fresh, pointer, replace)

    # -- writing ---------------------------------------------------------------------------
    def _with_part(self, name: str, df: DataFrame) -> DataFrame:
        return df.withColumn("_part", self.parts[name][1].cast("string") if name in self.parts else F.lit(WHOLE))

    def write(self, frames: dict[str, DataFrame], after_entity=None) -> int:
        """A new snapshot of the entities; ``after_entity(name)`` is called when one is written (for tests)."""
        before = self.current()
        version = 1 + max([before or 0, *self._tried()])
        kept = None
        for name, df in frames.items():
            tagged = self._with_part(name, df)
            marks = (tagged.groupBy("_part").agg(*mark_of(df))
                     .select(F.lit(name).alias("entity"), F.coalesce("_part", F.lit("null")).alias("part"), "n", "mark"))
            old = self.manifest(before).filter(F.col("entity") == name).select(
                "part", F.col("version").alias("_v"), F.col("n").alias("_n"), F.col("mark").alias("_m"))
            same = (F.col("n") == F.col("_n")) & (F.col("mark") == F.col("_m"))
            lines = marks.join(old, "part", "left").select(
                "entity", "part", F.when(same, F.col("_v")).otherwise(F.lit(version)).cast("long").alias("version"), "n", "mark")
            path = f"{self.root}/versions/v={version}"
            lines.write.mode("append").parquet(path)
            mine = self.manifest(version).filter((F.col("entity") == name) & (F.col("version") == version))
            # One string a changed part, one number in all.
            changed = [r["part"] for r in mine.select("part").collect()]
            if changed:
                self._write_parts(name, tagged, changed, version, mine.agg(F.sum("n")).first()[0])
            kept = name
            if after_entity:
                after_entity(kept)
        self._publish(version)
        return version

    def _tried(self) -> list[int]:
        """Versions that were begun, published or not."""
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return []
        return [int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(folder) if "=" in s.getPath().getName()]

    def _write_parts(self, name: str, tagged: DataFrame, changed: list[str], version: int, expected: int) -> None:
        seen = Observation()
        rows = tagged.filter(F.coalesce("_part", F.lit("null")).isin(changed))
        count = F.count(F.lit(1)).alias("n")
        path = f"{self.root}/data/{name}/v={version}"
        if name in self.parts:
            column = self.parts[name][0]
            # Contiguous slices of parts for each task: few files, and a hot part is split.
            rows = rows.withColumnRenamed("_part", column).repartitionByRange(column, *[c for c in ("id",) if c in tagged.columns])
            # Observed behind the exchange: what lies before it also runs to find the ranges.
            rows.observe(seen, count).write.option("maxRecordsPerFile", self.max_records).partitionBy(column).parquet(path)
        else:
            rows.drop("_part").observe(seen, count).write.option("maxRecordsPerFile", self.max_records).parquet(path)
        if seen.get["n"] != expected:
            raise ValueError(f"{name}: the rows changed while the snapshot was written")

    # -- reading ---------------------------------------------------------------------------
    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The entity's rows in a version (default: the current); None if it has none."""
        lines = self.manifest(version).filter(F.col("entity") == name).select("part", "version").collect()
        if not lines:
            return None
        column = self.parts[name][0] if name in self.parts else None
        out = None
        for v in sorted({r["version"] for r in lines}):
            base = f"{self.root}/data/{name}/v={v}"
            if column is None:
                paths = [base]
            else:
                paths = [f"{base}/{column}={'__HIVE_DEFAULT_PARTITION__' if r['part'] == 'null' else r['part']}"
                         for r in lines if r["version"] == v]
            df = self.spark.read.option("basePath", base).parquet(*paths)
            out = df if out is None else out.unionByName(df)
        return out

    def counts(self, version: int | None = None) -> DataFrame:
        """entity, n of a version, from the manifest: no entity is read."""
        return self.manifest(version).groupBy("entity").agg(F.sum("n").cast("long").alias("n"))
