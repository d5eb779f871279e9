"""Stored tables: layout, schemas and writers.

All tables are Parquet folders under one root, and writing a run again replaces it and adds nothing twice. Articles, their
child tables and the search index are segmented tables; the others keep a run's rows in its own
partition, which is overwritten.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.articles import EXPORT_COLUMNS, export_rows, export_scan
from ..operators.search import article_shares, bucketed, described_postings, doc_lengths, listed_postings, posting_blocks
from ..operators.trends import entity_article_join, hourly_trends, sentiment_daily
from ..session import TEXTS, bytes_read
from .keys import KeyIndex
from .segments import SegmentedTable

SCHEMAS = {
    "articles": (
        "id string, title string, url string, feed_source_id string, source_name string, content_hash string, "
        "summary string, body string, author string, published_at timestamp, collected_at timestamp, "
        "quality_score double, category string, tags array<string>, image_url string, sentiment string, "
        "sentiment_label string, sentiment_score double, generated_summary string, "
        "published_date date, run_id string"),
    "raw_articles": (
        "id string, source_id string, source_url string, fetched_at timestamp, published_at_raw string, "
        "raw_payload string, run_id string"),
    "failed_articles": (
        "id string, source_id string, failure_stage string, error_type string, error_message string, "
        "raw_payload string, created_at timestamp, run_id string"),
    "entities": (
        "article_id string, entity string, entity_type string, confidence double, extractor_version int, "
        "published_date date, run_id string"),
    "sectors": "article_id string, sector string, score double, published_date date, run_id string",
    "keywords": "article_id string, keyword string, weight double, published_date date, run_id string",
    "pipeline_runs": (
        "id string, started_at timestamp, completed_at timestamp, duration_ms bigint, articles_ingested bigint, "
        "articles_saved bigint, duplicates_detected bigint, failures bigint, source_count bigint, status string, "
        "trigger_type string, error_summary string, failed_sources array<string>, run_id string"),
    "outcomes": "payload_id string, source_id string, fetched_at timestamp, entries bigint, ok boolean, error string, run_id string",
    "source_health": (
        "source_id string, success_count bigint, failure_count bigint, last_success_at timestamp, "
        "last_failure_at timestamp, last_error string, health_score double, circuit_breaker_state string, "
        "consecutive_failures bigint, applied_at timestamp, run_id string"),
    "postings": (
        "term string, id string, tf bigint, doc_len int, positions array<int>, doc_block int, run_id string, term_bucket int"),
    "posting_blocks": "term string, doc_block int, df bigint, max_tf bigint, min_len int, run_id string, term_bucket int",
    "doc_lengths": "id string, doc_len bigint, run_id string",
    "hourly_trends": "entity string, entity_type string, time_bucket timestamp, article_count bigint, bucket_date date",
    "sentiment_summaries": "date_bucket timestamp, sentiment_label string, article_count bigint, bucket_date date",
}
BLOCK_BUCKETS = 8  # the block table is small beside the postings
SHARE_BYTES = 64 << 20  # of articles; an index of more is written in shares
MOST_SHARES = 8  # each reads the articles once
SUMMARIES = ("hourly_trends", "sentiment_summaries")
DATED = ("articles", "entities", "sectors", "keywords")
INDEXED = {"postings": ["term", "doc_block"], "posting_blocks": ["term"]}


class NewsStore:
    """Paths, reads and writes of the stored tables. `stem` is the word stem that the search index is kept with."""

    def __init__(self, spark: SparkSession, root: str, stem=None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.stem = stem

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def table(self, table: str) -> SegmentedTable:
        """A dated table or a table of the search index with its updates, merges and pages."""
        if table in INDEXED:
            return SegmentedTable(
                self.spark, self.path(table), SCHEMAS[table], "term", part="term_bucket", sort=INDEXED[table])
        if table not in DATED:
            raise ValueError(f"{table} is kept in plain folders")
        key, blooms = ("id", ("id", "url")) if table == "articles" else ("article_id", ("article_id",))
        return SegmentedTable(self.spark, self.path(table), SCHEMAS[table], key, blooms)

    def read_run(self, table: str, run_id: str) -> DataFrame:
        """Rows of one run; only folders with rows of it are opened."""
        if table in DATED or table in INDEXED:
            return self.table(table).read_run(run_id)
        return self.read(table).filter(F.col("run_id") == run_id)

    def health(self, without: str) -> DataFrame:
        """Stored health as other runs have left it: a row per source of the snapshot, and the runs after it."""
        recent = self.read("source_health").filter(F.col("run_id") != without)
        upto = self._snapshots()
        if not upto:
            return recent
        base = self.spark.read.schema(SCHEMAS["source_health"]).parquet(f"{self.path('source_health_base')}/{upto[-1]}")
        return recent.unionByName(base.filter(F.col("run_id") != without))

    def _snapshots(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path("source_health_base"))
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        done = [s.getPath() for s in files.listStatus(folder)]
        success = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.getName() for p in done if files.exists(success(p, "_SUCCESS")))

    def fold_health(self, keep: int = 8) -> int:
        """Fold the health of all but the `keep` newest runs into a snapshot, once as many more have gathered.

        Health rows are running totals, so the newest of a source stands for all before it. The snapshot is complete
        before the folders that it stands for go; rows that are there twice tell the same. Gives the number of runs folded.
        """
        runs = self.read("source_health").groupBy("run_id").agg(F.max("applied_at").alias("at")).orderBy("at", "run_id").collect()
        if len(runs) < 2 * keep:
            return 0
        old = [r["run_id"] for r in runs[:-keep]]
        held, before = self.read("source_health").filter(F.col("run_id").isin(old)), self._snapshots()
        if before:
            held = held.unionByName(
                self.spark.read.schema(SCHEMAS["source_health"]).parquet(f"{self.path('source_health_base')}/{before[-1]}"))
        names = self._schema("source_health").names
        last = F.max(F.struct("applied_at", "run_id", *[c for c in names if c not in ("applied_at", "run_id", "source_id")]))
        newest = held.groupBy("source_id").agg(last.alias("_last")).select(
            *[F.col("source_id") if c == "source_id" else F.col("_last")[c].alias(c) for c in names])
        newest.write.mode("overwrite").parquet(f"{self.path('source_health_base')}/{len(before) + 1:012d}")
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for run in old:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path('source_health')}/run_id={escape(run)}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return len(old)

    def maintain(self, before: date) -> None:
        """Join the folders of dates before `before`, of the search index and of the key index where many have gathered, and
        fold old health."""
        self.fold_health()
        for table in (*DATED, *INDEXED):
            self.table(table).merge(before if table in DATED else None)
        self.keys().merge()

    def read(self, table: str) -> DataFrame:
        """The table, empty when nothing has been written yet."""
        if table in DATED or table in INDEXED:
            return self.table(table).read()
        try:
            rows = self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))
            return rows.filter("article_count > 0") if table in SUMMARIES else rows
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise
            return self.spark.createDataFrame([], SCHEMAS[table])

    def keys(self) -> KeyIndex:
        """The index of stored urls and hashes, built from the articles where a store has none yet."""
        index = KeyIndex(self.spark, self.path("keys"))
        if not index.exists():
            articles = self.read("articles")
            if not articles.isEmpty():
                index.build(articles)
        return index

    def write_run(self, table: str, rows: DataFrame, run_id: str, gather: bool = True) -> None:
        """Replace this run's rows of `table`. Rows that come from large files need not be gathered into few by a shuffle."""
        if table in DATED or table in INDEXED:
            self.table(table).write_run(run_id, rows)
            return
        stamped = rows.withColumn("run_id", F.lit(run_id))
        shaped = stamped.select(*[
            F.col(f.name).cast(f.dataType).alias(f.name) for f in self._schema(table).fields])
        (shaped.hint("rebalance", "run_id") if gather else shaped).write.mode("overwrite").options(
            **TEXTS, partitionOverwriteMode="dynamic").partitionBy("run_id").parquet(self.path(table))

    def write_index(self, articles: DataFrame, run_id: str, stem=None) -> None:
        """Postings, their blocks and article lengths of a run, in the run's own folders.

        Postings are several times as large in a shuffle as they are when stored, so large runs are written in shares. A block
        lies in one share; its rows are counted there.
        """
        stem, shares, size = stem or self.stem, 1, bytes_read(articles) or 0
        while shares < MOST_SHARES and shares * SHARE_BYTES < size:
            shares *= 2
        postings = self.table("postings")
        postings.write_run(
            run_id, *[bucketed(listed_postings(a, stem=stem)) for a in article_shares(articles, shares)], late=described_postings)
        written: dict[str, list] = {}
        for s in postings.segments():
            if run_id in s.runs:
                written.setdefault(s.name, []).append(s)
        blocks = [posting_blocks(postings.read(held).filter(F.col("run_id") == run_id)) for held in written.values()]
        self.table("posting_blocks").write_run(run_id, *[bucketed(b, BLOCK_BUCKETS) for b in blocks], gather=False)
        self.write_run("doc_lengths", doc_lengths(articles, stem=stem), run_id)

    def _schema(self, table: str):
        from pyspark.sql.types import StructType

        return StructType.fromDDL(SCHEMAS[table])

    def write_summary(self, table: str, rows: DataFrame, bucket: str, dates: DataFrame | None = None) -> None:
        """Replace a summary table, or only the given dates (`bucket_date`).

        A date that has no rows any more gets one row that counts nothing and that `read` leaves out:
        overwriting partitions replaces them but never removes any.
        """
        dated, every_date = rows.withColumn("bucket_date", F.to_date(bucket)), dates is None
        if dates is not None:
            nothing = dates.select("bucket_date", F.lit(0).cast("bigint").alias("article_count"))
            dated = dated.unionByName(nothing, allowMissingColumns=True)
        (dated.hint("rebalance", "bucket_date").write.mode("overwrite")
         .option("partitionOverwriteMode", "static" if every_date else "dynamic")
         .partitionBy("bucket_date").parquet(self.path(table)))


def article_id(url: Column) -> Column:
    """Key of an article: a function of its url, the same on every run."""
    return F.sha2(url, 256)


def raw_append(store: NewsStore, raw: DataFrame, run_id: str, fetched_at: Column) -> None:
    """Raw payloads of a run, kept before any cleaning."""
    rows = raw.select(
        F.sha2(F.concat(F.lit(run_id), F.to_json(F.struct("seq"))), 256).alias("id"),
        "source_id", F.col("url").alias("source_url"), fetched_at.alias("fetched_at"),
        "published_at_raw", F.coalesce("raw_payload", F.lit("{}")).alias("raw_payload"))
    store.write_run("raw_articles", rows, run_id, gather=False)


def dead_letter_rows(failures: DataFrame, created_at: Column) -> DataFrame:
    """Failures as stored: the type cut to 256 characters, UNKNOWN when empty."""
    kind = F.coalesce(F.nullif(F.substring("error_type", 1, 256), F.lit("")), F.lit("UNKNOWN"))
    return failures.withColumns({"error_type": kind, "created_at": created_at})


def dead_letter(store: NewsStore, failures: DataFrame, run_id: str, created_at: Column) -> None:
    rows = dead_letter_rows(failures, created_at).withColumn(
        "id", F.sha2(F.concat(F.lit(run_id), F.to_json(F.struct("seq")), F.col("error_type")), 256))
    store.write_run("failed_articles", rows, run_id)


def open_run(store: NewsStore, run_id: str, started_at: Column, trigger_type: str = "SCHEDULED") -> None:
    """Record that a run has started."""
    row = store.spark.range(1).select(
        F.lit(run_id).alias("id"), started_at.alias("started_at"),
        F.lit(None).alias("completed_at"), F.lit(0).alias("duration_ms"),
        *[F.lit(0).alias(c) for c in (
            "articles_ingested", "articles_saved", "duplicates_detected", "failures", "source_count")],
        F.lit("RUNNING").alias("status"), F.lit(trigger_type).alias("trigger_type"),
        F.lit(None).alias("error_summary"), F.array().alias("failed_sources"))
    store.write_run("pipeline_runs", row, run_id)


def run_record(
    store: NewsStore, run_id: str, result: DataFrame, started_at: Column, completed_at: Column,
    trigger_type: str = "SCHEDULED",
) -> None:
    """Replace the open row with the finished one. `result` is the one-row run summary."""
    millis = (F.unix_millis(completed_at) - F.unix_millis(started_at))
    row = result.withColumns({
        "id": F.lit(run_id), "started_at": started_at, "completed_at": completed_at,
        "duration_ms": millis, "trigger_type": F.lit(trigger_type),
    })
    store.write_run("pipeline_runs", row, run_id)


def refresh_summaries(store: NewsStore, dates: DataFrame | None = None) -> None:
    """Recompute both summary tables from the stored articles.

    A bucket depends on the articles of its own date only. With `dates` (one column, `bucket_date`),
    the ones a run has touched, just those partitions are read and replaced, so the cost follows the
    run and not the store.
    """
    articles, entities = store.read("articles"), store.read("entities")
    if dates is not None:
        touched = dates.select(F.col("bucket_date").alias("published_date"))
        articles, entities = (rows.join(touched, "published_date", "left_semi") for rows in (articles, entities))
    store.write_summary("hourly_trends", hourly_trends(entity_article_join(entities, articles)), "time_bucket", dates)
    store.write_summary("sentiment_summaries", sentiment_daily(articles), "date_bucket", dates)


def export_csv(articles: DataFrame, path: str, max_rows: int | None = None) -> None:
    """Write the rows as CSV files with a header, in page order across the files.

    With `max_rows` a larger result is refused, never cut.
    """
    if max_rows is not None:
        found = articles.limit(max_rows + 1).count()
        if found > max_rows:
            raise ValueError(f"export holds more than {max_rows} rows")
    rows = export_rows(export_scan(articles)).select(*EXPORT_COLUMNS)
    rows.write.mode("overwrite").options(
        header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
