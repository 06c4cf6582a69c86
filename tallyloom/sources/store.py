"""Tables with versions: idempotent appends, deletes by rewriting few partitions, and reads of any version.

Rows are Parquet files under ``data/write=<id>/<partitions>``, and a version is a
list of the writes and partitions that belong to it, kept as one small Parquet file
under ``versions/version=<n>``. Files are never changed. A change first writes its
data and then its version; Spark's commit makes that one file appear at once, so
readers see the version before or the one after, and data of a change that broke
off belongs to no version. Of two writers that make the same version, the one with
the smaller id has won; the other sees that and tries again on top of it.

Only Spark reads and writes here, so the table can lie in any store that Spark knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Times that a change is tried again after another writer took its version.
TRIES = 5


class Conflict(RuntimeError):
    """Other writers took every version that a change tried to make."""


class VersionedTable:
    """A table at ``path`` with ``schema``, parted by ``partitions``, in which ``keys`` tell rows apart."""

    def __init__(self, spark: SparkSession, path: str, schema: str | S.StructType, keys: list[str], partitions: list[str]):
        self.spark, self.path, self.keys, self.partitions = spark, path.rstrip("/"), keys, partitions
        self.schema = S.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.names
        kept = [f for f in self.schema.fields if f.name not in partitions]
        parts = [self.schema[p] for p in partitions]
        self._stored = S.StructType([*kept, S.StructField("write", S.StringType()), *parts])
        self._listed = S.StructType([S.StructField("write", S.StringType()), *parts, S.StructField("rows", S.LongType()), S.StructField("maker", S.StringType()), S.StructField("version", S.LongType())])

    def create(self) -> VersionedTable:
        """Make version 0, with no rows; a table that is there already stays as it is."""
        self.spark.createDataFrame([], self._stored).write.mode("ignore").parquet(f"{self.path}/data")
        self._mark("").write.mode("ignore").parquet(f"{self.path}/versions/version=0")
        return self

    def _mark(self, maker: str) -> DataFrame:
        """A row of no write, with which a version's list names its maker even where it is empty."""
        listed = S.StructType([f for f in self._listed if f.name != "version"])
        return self.spark.createDataFrame([(*[None] * (len(listed) - 2), 0, maker)], listed).coalesce(1)

    def _versions(self) -> DataFrame:
        """The lists of all versions, each by the writer that won it."""
        listed = self.spark.read.schema(self._listed).parquet(f"{self.path}/versions")
        first = F.min(F.struct(F.col("_metadata.file_modification_time").alias("at"), "maker"))
        won = listed.groupBy("version").agg(first.alias("won")).select("version", "won.maker")
        return listed.join(F.broadcast(won), ["version", "maker"])  # one row for each version

    def version(self) -> int:
        """The newest version."""
        return self.spark.read.schema(self._listed).parquet(f"{self.path}/versions").agg(F.max("version")).first()[0]

    def _list(self, version: int) -> DataFrame:
        return self._versions().filter((F.col("version") == version) & F.col("write").isNotNull()).select("write", *self.partitions, "rows")

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, the newest if none is named; only the partitions that it lists are read."""
        return self._rows(self._list(self.version() if version is None else version)).select(*self.columns)

    def _rows(self, listed: DataFrame) -> DataFrame:
        data = self.spark.read.schema(self._stored).parquet(f"{self.path}/data")
        own = F.broadcast(listed.select("write", *self.partitions))  # one row for each partition of a write: less than a file listing
        same = [data[c].eqNullSafe(own[c]) for c in ("write", *self.partitions)]
        return data.join(own, same, "left_semi")

    def history(self) -> DataFrame:
        """``(version, rows, partitions)`` of every version."""
        return self._versions().groupBy("version").agg(F.sum("rows").alias("rows"), F.count("write").alias("partitions")).orderBy("version")

    def _write(self, rows: DataFrame) -> DataFrame:
        """Put rows down as a write that no version lists yet; its list."""
        write = uuid.uuid4().hex
        rows.select(*self.columns).hint("rebalance", *self.partitions).write.partitionBy(*self.partitions).parquet(f"{self.path}/data/write={write}")
        data = self.spark.read.schema(self._stored).parquet(f"{self.path}/data").filter(F.col("write") == write)
        return data.groupBy("write", *self.partitions).agg(F.count("*").alias("rows"))

    def _commit(self, base: int, listed: DataFrame) -> bool:
        """Make version ``base + 1`` of a list; whether it is ours."""
        maker = uuid.uuid4().hex
        rows = self._mark(maker).unionByName(listed.select("write", *self.partitions, "rows").withColumn("maker", F.lit(maker)))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/versions/version={base + 1}")
        return self._versions().filter(F.col("version") == base + 1).select("maker").first()[0] == maker

    def _change(self, change: Callable[[int], DataFrame | None]) -> int:
        """Make a version of the list that ``change`` gives for a base, again on a newer base where another writer was first."""
        for _ in range(TRIES):
            base = self.version()
            listed = change(base)
            if listed is None:
                return base
            if self._commit(base, listed):
                return base + 1
        raise Conflict(f"{self.path}: other writers took {TRIES} versions in a row")

    @staticmethod
    def _same(a: DataFrame, b: DataFrame, columns: list[str], how: str) -> DataFrame:
        """A semi or anti join on columns that may be null."""
        return a.alias("a").join(b.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns], how)

    def append(self, rows: DataFrame | Callable[[int], DataFrame]) -> int:
        """Add the rows whose key is not there yet, each key once; the version that holds them.

        Appending the same rows again changes nothing. Keys are compared within the
        partitions that the new rows touch, so a key must decide its partition. Rows
        that depend on the table are given as a function of the version they are added to.
        """
        def change(base: int) -> DataFrame | None:
            once = (rows(base) if callable(rows) else rows).select(*self.columns).dropDuplicates(self.keys)
            listed = self._list(base)
            old = self._rows(self._same(listed, once.select(*self.partitions).distinct(), self.partitions, "left_semi"))
            added = self._write(self._same(once, old, self.keys, "left_anti"))
            return None if added.isEmpty() else listed.unionByName(added)

        return self._change(change)

    def delete(self, where: Column) -> int:
        """Take out the rows for which ``where`` is true, and count them; only partitions that hold some are written again."""
        gone = 0

        def change(base: int) -> DataFrame | None:
            nonlocal gone
            listed, parts = self._list(base), ["write", *self.partitions]
            hit = self._rows(listed).groupBy(*parts).agg(F.count_if(where).alias("n"), F.count("*").alias("total")).filter("n > 0")
            gone = hit.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if not gone:
                return None
            mixed = self._rows(hit.filter("n < total")).filter(~F.coalesce(where, F.lit(False)))
            untouched = self._same(listed, hit.select(*parts), parts, "left_anti")
            return untouched.unionByName(self._write(mixed))

        self._change(change)
        return gone


def natural_key(*columns: str) -> Column:
    """A digest of columns that tells nulls, empty texts and shifted texts apart."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


#: Analyses as they are stored.
SUMMARY = (
    "summary_id string, timestamp timestamp, log_source_type string, site_name string, system_status string, summary string, "
    "critical_issues array<string>, warnings array<string>, recommendations array<string>, metrics string, "
    "input_tokens bigint, output_tokens bigint, cost_usd double, summary_date date"
)


class SummaryStore:
    """Stored analyses, and beside them partial statistics of every day.

    ``partials`` holds for each day, source, site and status the counts and sums that
    statistics (A10) and cost reports (A11) are made of. They add up, so a report of
    any span reads a row for each group and day instead of the analyses, and what
    retention deletes is subtracted from them by rows with negative counts.
    """

    PARTIAL = (
        "part_id string, log_source_type string, site_name string, system_status string, n bigint, cost decimal(38,12), paid bigint, paid_cost decimal(38,12), "
        "input_n bigint, input_tokens decimal(38,0), output_n bigint, output_tokens decimal(38,0), summary_date date"
    )
    SUMS = ("n", "cost", "paid", "paid_cost", "input_n", "input_tokens", "output_n", "output_tokens")

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = VersionedTable(spark, f"{path.rstrip('/')}/summaries", SUMMARY, ["summary_id"], ["log_source_type", "summary_date"])
        self.partials = VersionedTable(spark, f"{path.rstrip('/')}/partials", self.PARTIAL, ["part_id"], ["summary_date"])

    def create(self) -> SummaryStore:
        self.table.create()
        self.partials.create()
        return self

    @staticmethod
    def rows(analyses: DataFrame) -> DataFrame:
        """Analyses in the stored form: empty sources are ``logwatch``, missing columns null, and the id is that of the content."""
        types = S.StructType.fromDDL(SUMMARY)
        given = analyses.select(*[(F.col(f.name) if f.name in analyses.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in types])
        given = given.withColumns({
            "log_source_type": F.coalesce(F.nullif("log_source_type", F.lit("")), F.lit("logwatch")), "site_name": F.coalesce("site_name", F.lit("")),
            "summary_date": F.to_date("timestamp"),
        })
        return given.withColumn("summary_id", F.coalesce("summary_id", natural_key("timestamp", "log_source_type", "site_name", "system_status", "summary")))

    def append(self, analyses: DataFrame) -> int:
        """Add analyses that are not there yet, and their statistics; the version of the summaries.

        The statistics of a day belong to a version of the summaries by its number
        (``part_id``), so an append that broke off between the two is made whole by the next.
        """
        version = self.table.append(self.rows(analyses))
        self._sum_up(version)
        return version

    def _sum_up(self, version: int) -> None:
        """Bring the statistics to a version: what its list has more, and what it has less, than the version they stand at."""
        def difference(base: int) -> DataFrame:
            done = self.partials.read(base).agg(F.max(F.split("part_id", "/")[0].cast("long"))).first()[0] or 0
            new, old = self.table._list(max(version, done)), self.table._list(done)
            parts = ["write", "log_source_type", "summary_date"]
            grown = self.table._rows(self.table._same(new, old, parts, "left_anti")).withColumn("sign", F.lit(1))
            shrunk = self.table._rows(self.table._same(old, new, parts, "left_anti")).withColumn("sign", F.lit(-1))
            return self._partials(grown.unionByName(shrunk), version)

        self.partials.append(difference)

    def _partials(self, rows: DataFrame, version: int) -> DataFrame:
        cost, paid = F.col("cost_usd").cast("decimal(24,12)"), F.col("cost_usd") > 0
        some = lambda c: F.when(F.col(c).isNotNull(), F.col("sign")).otherwise(0)
        tokens = lambda c: F.sum((F.col(c) * F.col("sign")).cast("decimal(28,0)")).cast("decimal(38,0)")
        keys = ["summary_date", "log_source_type", "site_name", "system_status"]
        summed = rows.groupBy(*keys).agg(
            F.sum("sign").alias("n"), F.sum(cost * F.col("sign")).cast("decimal(38,12)").alias("cost"), F.sum(F.when(paid, F.col("sign")).otherwise(0)).alias("paid"),
            F.sum(F.when(paid, cost * F.col("sign"))).cast("decimal(38,12)").alias("paid_cost"), F.sum(some("input_tokens")).alias("input_n"), tokens("input_tokens").alias("input_tokens"),
            F.sum(some("output_tokens")).alias("output_n"), tokens("output_tokens").alias("output_tokens"),
        )
        return summed.withColumn("part_id", F.concat(F.lit(f"{version}/"), natural_key(*keys)))

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def retain(self, now: Column, days: int = 90) -> int:
        """Delete analyses older than ``days`` before ``now``, subtract them from the statistics, and count them."""
        gone = self.table.delete(F.col("timestamp") < now - F.expr(f"INTERVAL {int(days)} DAYS"))
        self._sum_up(self.table.version())
        return gone

    def _merged(self, *keys: str) -> DataFrame:
        merged = self.partials.read().groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self.SUMS])
        return merged.filter("n > 0")

    def statistics(self) -> DataFrame:
        """A10 in every scope, from the partial statistics: what ``history.statistics`` finds by reading all analyses."""
        scopes = [[], ["system_status"], ["log_source_type", "site_name"], ["log_source_type", "site_name", "system_status"]]
        grouped = self._merged("log_source_type", "site_name", "system_status").groupingSets(scopes, "log_source_type", "site_name", "system_status")
        return grouped.agg(F.sum("n").alias("n"), F.sum("cost").cast("double").alias("cost"), F.grouping_id().alias("scope"))

    def daily_costs(self, days: int = 30) -> DataFrame:
        """A11 from the partial statistics: the latest days that have any analysis."""
        mean = lambda total, n: F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n))
        per_day = self._merged("summary_date").select(
            F.col("summary_date").alias("day"), F.col("cost").cast("double").alias("cost"), "n", mean("paid_cost", "paid").alias("avg_cost"),
            mean("input_tokens", "input_n").alias("avg_input"), mean("output_tokens", "output_n").alias("avg_output"),
        )
        return per_day.orderBy(F.desc("day")).limit(days)


#: Message parts that were handed to channels, with what tells them apart.
OUTBOX = "report_id string, channel string, part_no int, text string"


def outbox_table(spark: SparkSession, path: str) -> VersionedTable:
    """The outbox, in which a part of a report goes to a channel once."""
    return VersionedTable(spark, path, OUTBOX, ["report_id", "channel", "part_no"], ["channel"])
