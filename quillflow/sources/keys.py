"""Keys of the stored articles, in hash buckets.

Two narrow tables (url, content_hash, run, seg) hold every stored pair, one in buckets of the url, one in buckets of the hash.
They are plain Parquet folders; each session declares them in its own catalog, so no metastore has to
remember the buckets. A batch of few keys reads only the buckets that its keys hash to; a large one is
shuffled into the buckets and meets the stored rows where they lie.

Every run writes a segment of its own. `merge` joins segments in tiers of `FAN_IN`; rows keep their run, and a
run's own segment hides what merged ones still hold of an earlier try of it, so that a run can always be
written again.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
FAN_IN = 8
FEW_KEYS = 1000  # up to so many distinct keys of a batch are named in the scan's filter
KEYS = ("url", "content_hash")
_COLUMNS = "url string, content_hash string, run string, seg string"


class KeyIndex:
    """The key tables under one folder. `without` leaves out the rows of one run, the one that is being written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, without: str | None = None):
        self.spark, self.root, self.buckets, self.left_out = spark, root.rstrip("/"), buckets, without

    def without(self, run_id: str) -> KeyIndex:
        return KeyIndex(self.spark, self.root, self.buckets, run_id)

    # --- Folders -----------------------------------------------------------------------------------

    def path(self, key: str) -> str:
        return f"{self.root}/by_{key}_{self.buckets}"

    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        folder, files = self._files(self.path(KEYS[1]))
        return files.exists(folder)

    def segments(self, key: str = KEYS[0]) -> list[str]:
        folder, files = self._files(self.path(key))
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return sorted(unescape(n.removeprefix("seg=")) for n in names if n.startswith("seg="))

    def _drop(self, key: str, segment: str) -> None:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        folder, files = self._files(f"{self.path(key)}/seg={escape(segment)}")
        files.delete(folder, True)
        self.spark.catalog.refreshByPath(self.path(key))

    def _table(self, key: str) -> str:
        name = f"keys_{hashlib.sha256(self.path(key).encode()).hexdigest()[:16]}"
        place = self.path(key).replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({_COLUMNS}) USING parquet PARTITIONED BY (seg) "
            f"CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return name

    # --- Reading -----------------------------------------------------------------------------------

    def rows(self, key: str = KEYS[0]) -> DataFrame:
        """(url, content_hash, run) of all visible rows, in buckets of `key`."""
        own = [s for s in self.segments(key) if not _is_merged(s)]
        self.spark.catalog.refreshByPath(self.path(key))
        held = self.spark.table(self._table(key)).filter(F.col(key).isNotNull())
        if own:  # bounded: the next merge takes them away
            held = held.filter((F.col("seg") == F.col("run")) | ~F.col("run").isin(own))
        if self.left_out is not None:
            held = held.filter(F.col("run") != self.left_out)
        return held.select("url", "content_hash", "run")

    def matching(self, key: str, wanted: DataFrame) -> DataFrame:
        """Stored rows (url, content_hash, run) whose `key` is among the distinct keys of `wanted`.

        Few keys become literals, which select the buckets before a file is opened. More are joined: the stored
        side is bucketed by the join key and stays where it is.
        """
        few = [r[0] for r in wanted.select(key).limit(FEW_KEYS + 1).collect()]
        held = self.rows(key)
        if len(few) <= FEW_KEYS:
            return held.filter(F.col(key).isin([k for k in few if k is not None]))
        return held.join(wanted.select(key), key, "left_semi").select("url", "content_hash", "run")

    def held(self, key: str, wanted: DataFrame) -> DataFrame:
        """Those of the distinct keys `wanted` that are stored."""
        return self.matching(key, wanted).select(key).distinct()

    # --- Writing -----------------------------------------------------------------------------------

    def _write(self, key: str, rows: DataFrame) -> None:
        """Replace the segments that `rows` (url, content_hash, run, seg) name."""
        bucket = F.expr(f"pmod(hash({key}), {self.buckets})")
        placed = rows.select("url", "content_hash", "run", "seg", bucket.alias("_bucket"))
        shaped = placed.hint("rebalance", "seg", "_bucket").drop("_bucket")
        mode = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            shaped.write.mode("overwrite").insertInto(self._table(key))
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)

    def write_run(self, run_id: str, rows: DataFrame) -> None:
        """Replace a run's keys by those of `rows` (url, content_hash)."""
        if _is_merged(run_id):
            raise ValueError("run ids that begin with ~ are kept for merged segments")
        pairs = rows.select("url", "content_hash").distinct()
        if pairs.isEmpty():
            self._empty_run(run_id)
            return
        for key in KEYS:
            self._write(key, pairs.withColumns({"run": F.lit(run_id), "seg": F.lit(run_id)}))

    def _empty_run(self, run_id: str) -> None:
        """A run without keys: overwriting by partition would leave an earlier try of it in place.

        A row that no key can equal keeps the run's segment there, so that merged rows of it stay hidden.
        """
        nothing = self.spark.range(1).select(
            F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("content_hash"),
            F.lit(run_id).alias("run"), F.lit(run_id).alias("seg"))
        for key in KEYS:
            self._write(key, nothing)

    def build(self, articles: DataFrame) -> None:
        """The whole index from stored articles (url, content_hash, run_id): a segment per run."""
        pairs = articles.select("url", "content_hash", F.col("run_id").alias("run"), F.col("run_id").alias("seg")).distinct()
        for key in KEYS:
            self._write(key, pairs)

    def merge(self, fan_in: int = FAN_IN) -> int:
        """Join segments, tier by tier, where `fan_in` of a tier have gathered; gives the number of segments left.

        The joined segment is complete before the old ones go, older merged ones first: at every moment each
        visible row is there, and rows that are there twice tell the same.
        """
        for key in KEYS:
            for tier in range(64):
                names = self.segments(key)
                ready = [s for s in names if _tier(s) == tier]
                if len(ready) < fan_in:
                    if not any(_tier(s) > tier for s in names):
                        break
                    continue
                visible = self.spark.table(self._table(key))
                own = [s for s in names if not _is_merged(s)]
                if own:
                    visible = visible.filter((F.col("seg") == F.col("run")) | ~F.col("run").isin(own))
                # Merged segments that still hold rows of these runs are taken along, or those would come back.
                taken = set(ready)
                if tier == 0:
                    stale = self.spark.table(self._table(key)).filter(
                        F.col("run").isin(ready) & (F.col("seg") != F.col("run"))).select("seg").distinct()
                    taken |= {r["seg"] for r in stale.collect()}
                level = max(_tier(s) for s in taken) + (1 if not taken - set(ready) else 0)
                name = f"~{max(level, 1)}-{uuid.uuid4().hex}"
                rows = visible.filter(F.col("seg").isin(list(taken)) & F.col(key).isNotNull())
                self._write(key, rows.select("url", "content_hash", "run", F.lit(name).alias("seg")))
                for old in sorted(taken, key=lambda s: (not _is_merged(s), s)):
                    self._drop(key, old)
        return len(self.segments())


def _is_merged(segment: str) -> bool:
    return segment.startswith("~")


def _tier(segment: str) -> int:
    return int(segment[1:].split("-")[0]) if _is_merged(segment) else 0
