"""A keyed table in versions: rows replace stored rows of the same key, and a reader always sees one whole version."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut_lineage

BUCKET = "_bucket"


def read_if_there(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The Parquet table in ``paths``; None if there is none."""
    try:
        return spark.read.parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class Store:
    """Rows by key under ``path``, in ``buckets`` by the hash of the key.

    Every change writes the buckets it touches under a new version and then a manifest that names the version of each
    bucket; the newest whole manifest is the table. A change that dies on the way leaves the table as it was, one that
    runs again under its own version number writes the same files again. A read is one scan of the named buckets.
    Manifests have one row per bucket, so they may pass the driver; rows never do. ``compact`` deletes what no
    manifest but the newest ones names. One writer at a time. A key is not null.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    # --- files

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        """The versions that are there, oldest first; of manifests only those written to their end."""
        folder, files = self._folder(name)
        if not files.exists(folder):
            return []
        found = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("version=")]
        whole = [p for p in found if name != "manifest" or files.exists(p.suffix("/_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in whole)

    def manifest(self, before: int | None = None) -> tuple[int, dict[int, int]]:
        """The newest version (-1: none) older than ``before``, and the version of each bucket in it."""
        versions = [v for v in self._versions("manifest") if before is None or v < before]
        if not versions:
            return -1, {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/version={versions[-1]}").collect()
        return versions[-1], {r["bucket"]: r["version"] for r in rows}

    # --- rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, named: dict[int, int]) -> DataFrame | None:
        if not named:
            return None
        paths = [f"{self.path}/data/version={v}/{BUCKET}={b}" for b, v in sorted(named.items())]
        return self.spark.read.parquet(*paths)

    def read(self) -> DataFrame | None:
        """The table; None before the first change."""
        return self._rows(self.manifest()[1])

    def _commit(self, rows: DataFrame, touched: list[int], named: dict[int, int], version: int) -> None:
        """Write ``rows``, all there is in the touched buckets, and the manifest that names them."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # a bucket is dealt over several tasks where there are more tasks than buckets
        within = F.pmod(F.floor(F.xxhash64(*self.keys) / self.buckets), F.lit(parts // self.buckets + 1))
        dealt = rows.withColumn(BUCKET, self._bucket()).repartition(parts, BUCKET, within)
        data = f"{self.path}/data/version={version}"
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(data)
        filled = read_if_there(self.spark, data)
        filled = [] if filled is None else [r[0] for r in filled.select(BUCKET).distinct().collect()]  # partition names only
        now = {b: v for b, v in named.items() if b not in touched} | dict.fromkeys(filled, version)
        table = self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def change(
        self,
        rows: DataFrame | None = None,
        gone: DataFrame | None = None,
        newest: list[str] | None = None,
        version: int | None = None,
    ) -> int:
        """Put ``rows`` in place of stored ones of their keys and drop the keys of ``gone``; the version made.

        With ``newest`` the row with the highest of these columns stays, stored or new, so rows may come in any order
        and more than once; without it ``rows`` have each key once. A ``version`` that is already there is made again.
        """
        rows, gone = (df if df is None else cut_lineage(df, self.spark) for df in (rows, gone))
        version = self.manifest()[0] + 1 if version is None else version
        named = self.manifest(before=version)[1]
        changed = [df.select(*self.keys) for df in (rows, gone) if df is not None]
        keys = changed[0] if len(changed) == 1 else changed[0].unionByName(changed[1])
        touched = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # at most one per bucket
        old = self._rows({b: v for b, v in named.items() if b in touched})
        if old is not None and gone is not None:
            old = old.join(gone.select(*self.keys), self.keys, "left_anti")
        if rows is None:
            merged = old
        elif newest is None:
            merged = rows if old is None else old.join(rows.select(*self.keys), self.keys, "left_anti").unionByName(rows)
        else:
            merged = rows if old is None else old.unionByName(rows)
            row = F.struct(*merged.columns)
            merged = merged.groupBy(*self.keys).agg(F.max_by(row, F.struct(*newest)).alias("_row")).select("_row.*")
        if touched and merged is not None:
            self._commit(merged, touched, named, version)
        return version

    def compact(self, keep: int = 1) -> int:
        """Delete all but the newest ``keep`` manifests and the buckets that only those named; how many buckets went.

        A stream that may run its last batch again keeps two.
        """
        versions = self._versions("manifest")
        named = {item for v in versions[-keep:] for item in self.manifest(before=v + 1)[1].items()}
        done = 0
        for v in self._versions("data"):
            folder, files = self._folder(f"data/version={v}")
            for status in files.listStatus(folder):
                name = status.getPath().getName()
                if name.startswith(f"{BUCKET}=") and (int(name.split("=")[1]), v) not in named:
                    files.delete(status.getPath(), True)
                    done += 1
            if v not in {x for _, x in named}:
                files.delete(folder, True)
        for v in versions[:-keep]:
            folder, files = self._folder(f"manifest/version={v}")
            files.delete(folder, True)
        return done
