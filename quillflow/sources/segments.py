"""Stored tables as folders of rows that never change, listed by a manifest.

A folder holds rows of one date (or of one term bucket). The manifest names the folders that make up the table, with their runs, row counts and the
least and greatest time and id in each. Every change writes new folders aside, checks them, and then
publishes the next manifest; a change that breaks off before that has changed nothing, and folders that it did not
touch keep their files. Readers choose folders by the manifest before a file is opened.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.articles import after_cursor, page_order
from ..operators.maintenance import backfill_from_join, conditional_update, upsert_by_key
from ..session import TEXTS, freed_shuffles, written

FAN_IN = 8
ROWS_PER_SEGMENT = 5_000_000
FIRST_WAVE = 2


@dataclass(frozen=True)
class Segment:
    """A folder: its date or other part (None: undated), its runs, and the range of times (microseconds) and ids in it."""

    name: str
    part: str | None
    runs: tuple[str, ...]
    rows: int
    first: int | None
    last: int | None
    low: str | None
    high: str | None

    def path(self, column: str) -> str:
        return f"seg={self.name}/{column}={self.part or '__HIVE_DEFAULT_PARTITION__'}"


def _micros(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return round(at.timestamp() * 1_000_000)


class SegmentedTable:
    """One table. `schema` has the partition column `part` and the column `run_id`; `key` is the id column, `sort` the
    order of rows in a file."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", blooms: Sequence[str] = (),
                 part: str = "published_date", sort: Sequence[str] = ()):
        self.spark, self.root, self.key, self.blooms = spark, root.rstrip("/"), key, tuple(blooms)
        self.part, self.sort = part, list(sort)
        self.schema = StructType.fromDDL(schema)
        self.time = "published_at" if "published_at" in self.schema.names else None

    # --- Manifest ----------------------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, files = self._path("_manifest")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"[0-9]{12}\.json", n))

    def _load(self, version: int) -> list[Segment] | None:
        path, files = self._path(f"_manifest/{version:012d}.json")
        stream = files.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return [Segment(**{**s, "runs": tuple(s["runs"])}) for s in json.loads(text)["segments"]]
        except ValueError:  # its writer broke off
            return None

    def version(self) -> int:
        """Number of the newest complete manifest, 0 before the first."""
        return next((v for v in reversed(self._versions()) if self._load(v) is not None), 0)

    def segments(self) -> list[Segment]:
        version = self.version()
        return (self._load(version) or []) if version else []

    def _publish(self, segments: list[Segment], after: int) -> None:
        """The next manifest. A second writer with the same base finds the name taken and fails."""
        number = max([after, *self._versions()]) + 1
        if self.version() != after:
            raise RuntimeError(f"{self.root} has been changed by another writer")
        path, files = self._path(f"_manifest/{number:012d}.json")
        stream = files.create(path, False)
        stream.write(bytearray(json.dumps({"segments": [asdict(s) for s in segments]}).encode()))
        stream.close()

    # --- Reading -----------------------------------------------------------------------------------

    def read(self, segments: list[Segment] | None = None) -> DataFrame:
        """All rows, or those of some segments."""
        segments = self.segments() if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self._files(segments).select(*self.schema.names)

    def _files(self, segments: list[Segment]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data").parquet(
            *[f"{self.root}/data/{s.path(self.part)}" for s in segments])

    def read_run(self, run_id: str) -> DataFrame:
        return self.read([s for s in self.segments() if run_id in s.runs]).filter(F.col("run_id") == run_id)

    def lookup(self, value) -> DataFrame:
        """Rows of one id: folders whose range holds it."""
        inside = [s for s in self.segments() if s.low is not None and s.low <= str(value) <= s.high]
        return self.read(inside).filter(F.col(self.key) == value)

    def latest_page(self, limit: int, cursor: tuple | None = None, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
                    told: Callable[[list[Segment]], None] | None = None) -> DataFrame:
        """Newest rows first, undated last, one more than `limit`; `keep` filters them.

        Folders are opened in waves, newest first, until the page is proven: no folder that is left has a time as
        late as the page's last row. `told` hears what each wave opens.
        """
        left = sorted(self.segments(), key=lambda s: (s.last is not None, s.last or 0, s.high or ""), reverse=True)
        if cursor is not None and cursor[0] is not None:
            left = [s for s in left if s.first is None or s.first <= _micros(cursor[0])]
        elif cursor is not None:
            left = [s for s in left if s.last is None]
        page, size = None, FIRST_WAVE
        while left:
            wave, left, size = left[:size], left[size:], size * 2
            if told:
                told(wave)
            rows = keep(self.read(wave))
            if cursor is not None:
                rows = rows.filter(after_cursor(*cursor))
            best = rows.orderBy(*page_order()).limit(limit + 1)
            if page is not None:
                best = page.unionByName(best).orderBy(*page_order()).limit(limit + 1)
            page = written(best, "page")
            times = [r[0] for r in page.select(F.unix_micros("published_at")).collect()]
            if len(times) > limit and None not in times:
                left = [s for s in left if s.last is not None and s.last >= min(times)]
        return self.read([]) if page is None else page.orderBy(*page_order())

    # --- Writing -----------------------------------------------------------------------------------

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def _stage(self, rows: DataFrame, gather: bool = True) -> list[Segment]:
        """Write rows into new folders, one per date, and describe them; nothing refers to them yet."""
        name = uuid.uuid4().hex
        shaped = self._shaped(rows)
        options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in self.blooms}
        if gather:
            shaped = shaped.hint("rebalance", self.part)
        if self.sort:
            shaped = shaped.sortWithinPartitions(self.part, *self.sort)
        with freed_shuffles(self.spark):
            shaped.write.options(**options, **TEXTS).partitionBy(self.part).parquet(f"{self.root}/data/seg={name}")
        path, files = self._path(f"data/seg={name}")
        if not any(s.isDirectory() for s in files.listStatus(path)):
            return []
        held = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/seg={name}")
        time = F.unix_micros(self.time) if self.time else F.lit(None).cast("bigint")
        key = F.col(self.key).cast("string")
        about = held.groupBy(F.col(self.part).cast("string").alias("part")).agg(
            F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"), F.min(key).alias("low"),
            F.max(key).alias("high"), F.collect_set("run_id").alias("runs"))
        return [Segment(name, r["part"], tuple(sorted(r["runs"])), r["rows"], r["first"], r["last"], r["low"], r["high"])
                for r in about.collect()]

    def _replace(self, old: list[Segment], rows: DataFrame, expected: int | None = None) -> None:
        """Rows in place of the old segments: written aside, counted, published."""
        self._exchange(old, [rows], expected)

    def _exchange(self, old: list[Segment], shares: Sequence[DataFrame], expected: int | None = None, gather: bool = True) -> None:
        """As `_replace`, for rows in shares that are written one after the other and published together."""
        base, current = self.version(), self.segments()
        new = [s for rows in shares for s in self._stage(rows, gather)]
        found = sum(s.rows for s in new)
        if expected is not None and found != expected:
            raise RuntimeError(f"{self.root}: {found} rows written where {expected} were due")
        gone = set(old)
        self._publish([s for s in current if s not in gone] + new, base)

    def write_run(self, run_id: str, *shares: DataFrame, late: Callable[[DataFrame], DataFrame] | None = None,
                  gather: bool = True) -> None:
        """Replace a run's rows. Merged folders that hold some are written again without them.

        Rows in several shares are written one after the other, and what a share has shuffled is freed before the next one: the
        disk then holds the shuffle of one share and not of all. `late` adds columns that need not be shuffled. Rows that a
        shuffle has gathered already need no second one (`gather`).
        """
        old = [s for s in self.segments() if run_id in s.runs]
        merged = [s for s in old if len(s.runs) > 1]
        stamped = lambda rows: self._shaped((late(rows) if late else rows).withColumn("run_id", F.lit(run_id)))
        gathered = lambda rows: rows.hint("rebalance", self.part) if gather else rows
        shaped = lambda rows: stamped(gathered(rows)) if late else gathered(stamped(rows))
        first, *others = shares or (self.read([]),)
        if merged:  # what other runs have there goes with the first share
            first = gathered(stamped(first).unionByName(self.read(merged).filter(F.col("run_id") != run_id)))
        else:
            first = shaped(first)
        self._exchange(old, [first, *map(shaped, others)], gather=False)

    def touched(self, condition: Column) -> list[Segment]:
        """Segments with a row for which the condition holds."""
        segments = self.segments()
        return self._of(self._files(segments).filter(condition), segments) if segments else []

    def _with_keys(self, keys: DataFrame, column: str) -> list[Segment]:
        """Segments that hold one of the keys."""
        segments = self.segments()
        if not segments:
            return []
        marked = self._files(segments).select(column, "_metadata.file_path")
        return self._of(marked.join(written(keys.select(column).distinct(), "keys"), column, "left_semi"), segments, "file_path")

    def _of(self, rows: DataFrame, segments: list[Segment], file: str = "_metadata.file_path") -> list[Segment]:
        """The segments that the rows come from; the driver sees one name per folder."""
        folder = F.regexp_extract(F.col(file), rf"(seg=[^/]+/{self.part}=[^/]+)/[^/]+$", 1)
        found = {r[0] for r in rows.select(folder.alias("folder")).distinct().collect()}
        return [s for s in segments if s.path(self.part) in found]

    def update(self, condition: Column, **changes: Column) -> int:
        """Set columns where the condition holds; gives the number of folders written again."""
        old = self.touched(condition)
        if old:
            self._replace(old, conditional_update(self.read(old), condition, **changes), sum(s.rows for s in old))
        return len(old)

    def delete(self, condition: Column) -> int:
        old = self.touched(condition)
        if old:
            self._replace(old, self.read(old).filter(~F.coalesce(condition, F.lit(False))))
        return len(old)

    def delete_keys(self, keys: DataFrame, column: str) -> int:
        """Delete the rows whose `column` is among the keys."""
        old = self._with_keys(keys, column)
        if old:
            doomed = written(keys.select(column).distinct(), "doomed")
            self._replace(old, self.read(old).join(doomed, column, "left_anti"))
        return len(old)

    def upsert(self, incoming: DataFrame, key: str, update: Sequence[str]) -> int:
        """Insert new keys; overwrite the `update` columns of known ones. `incoming` holds a key once, with run and date."""
        incoming = written(incoming, "incoming")
        old = self._with_keys(incoming, key)
        self._replace(old, upsert_by_key(self.read(old), incoming, key, update))
        return len(old)

    def backfill(self, sources: DataFrame, column: str = "source_name", **names: str) -> int:
        """Fill null or empty values of a column from the rows' sources."""
        old = self.touched(F.coalesce(F.col(column), F.lit("")) == "")
        if old:
            self._replace(old, backfill_from_join(self.read(old), sources, column, **names), sum(s.rows for s in old))
        return len(old)

    # --- Upkeep ------------------------------------------------------------------------------------

    def merge(self, before: date | None = None, fan_in: int = FAN_IN, rows: int = ROWS_PER_SEGMENT) -> int:
        """Join the folders of a closed part that has `fan_in` or more: of dates before `before`, and all other parts.

        Only folders smaller than `rows` are joined, so a row is written a bounded number of times. Rows keep their
        run. Readers of the older manifest go on with the old folders. Gives the number of folders joined.
        """
        by_part: dict[str | None, list[Segment]] = {}
        for s in self.segments():
            if s.rows < rows and (s.part is None or before is None or s.part < before.isoformat()):
                by_part.setdefault(s.part, []).append(s)
        old = [s for group in by_part.values() if len(group) >= fan_in for s in group]
        if old:
            self._replace(old, self.read(old), sum(s.rows for s in old))
        return len(old)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last `keep` manifests names, and older manifests. No writer may be at work."""
        versions = [v for v in self._versions() if self._load(v) is not None]
        kept, gone = versions[-keep:], versions[:-keep]
        needed = {s.path(self.part) for v in kept for s in self._load(v)}
        data, files = self._path("data")
        removed = 0
        for seg in (files.listStatus(data) if files.exists(data) else []):
            name = seg.getPath().getName()
            inner = [d.getPath() for d in files.listStatus(seg.getPath()) if d.isDirectory()]
            doomed = [d for d in inner if f"{name}/{d.getName()}" not in needed]
            for folder in [seg.getPath()] if len(doomed) == len(inner) else doomed:
                files.delete(folder, True)
            removed += len(doomed)
        for version in gone:
            files.delete(self._path(f"_manifest/{version:012d}.json")[0], False)
        return removed


def cascade_delete(articles: SegmentedTable, children: Sequence[SegmentedTable], sources: DataFrame) -> dict[str, int]:
    """Delete the articles of sources (`id`) and their child rows, children first, so that no child is ever without its article."""
    doomed = sources.select(F.col("id").alias("feed_source_id")).distinct()
    ids = written(articles.read().join(doomed, "feed_source_id", "left_semi").select(F.col("id").alias("article_id")), "ids")
    done = {child.root: child.delete_keys(ids, "article_id") for child in children}
    done[articles.root] = articles.delete_keys(doomed, "feed_source_id")
    return done
