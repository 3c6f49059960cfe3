"""Reading raw bar files, building the clean panel, and storing it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import known, six_digit_code

PRICES = ("open", "high", "low", "close", "volume")
REQUIRED = ("code", "date", *PRICES)

RAW_CSV = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED])


def number(c: str | Column) -> Column:
    """Text to double; anything unreadable is unknown."""
    text = F.col(c) if isinstance(c, str) else c
    return known(text.try_cast("double"))


def read_bar_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Bar CSV with a header; every field is read as text and converted explicitly.

    ``columns`` names the file's columns in file order when it holds more than the required ones.
    """
    names = columns or list(REQUIRED)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return clean_source(raw.select(*REQUIRED, F.col("_metadata.file_name").alias("source_file")))


def clean_source(raw: DataFrame) -> DataFrame:
    """Text columns to typed bars: six-digit code, date, numbers, source tag."""
    return raw.select(
        six_digit_code("code").alias("code"),
        F.to_date("date", "yyyy-MM-dd").alias("date"),
        *[number(c).alias(c) for c in PRICES],
        "source_file")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by suffix; a CSV is read as text so that codes keep their zeros."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".txt", ".gz")):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    raise ValueError(f"unsupported table format: {path}")


def read_signals(spark: SparkSession, path: str, columns: list[str], date_column: str = "date") -> DataFrame:
    """Signal CSV: text code padded to six digits, parsed date, numeric labels and scores."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    text = {"code", date_column, "strategy_id", "version", "regime"}
    return raw.select(
        F.lpad("code", 6, "0").alias("code"),
        F.to_date(date_column).alias(date_column),
        *[F.col(c) if c in text else number(c).alias(c)
          for c in columns if c not in ("code", date_column)])


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Sources stacked in order; ``source_ord`` keeps the order for the later-wins rule."""
    tagged = [f.withColumn("source_ord", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def keep_last(df: DataFrame, order: list[str], keys: tuple[str, ...] = ("code", "date")) -> DataFrame:
    """One whole row per key, the last in ``order``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    lead = order + [c for c in rest if c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*lead)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def valid_bar() -> Column:
    """Positive close and an ordered high / low; unknown prices fail."""
    return (F.col("close") > 0) & (F.col("high") >= F.col("low"))


def build_panel(sources: DataFrame) -> DataFrame:
    """Stacked sources to the panel: later source wins, bad bars leave."""
    return keep_last(sources, ["source_ord"]).filter(valid_bar()).withColumn(
        "amount", F.lit(None).cast("double"))


def manifest(sources: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: counts before and after, distinct codes and days, date range."""
    raw = sources.agg(F.count(F.lit(1)).alias("rows_before_dedup"),
                      F.countDistinct("code", "date").alias("_keys"))
    got = panel.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("code").alias("codes"),
        F.countDistinct("date").alias("trading_days"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    both = raw.withColumn("_one", F.lit(1)).join(F.broadcast(got.withColumn("_one", F.lit(1))), "_one")
    return both.select(
        "rows_before_dedup",
        (F.col("rows_before_dedup") - F.col("_keys")).alias("duplicate_rows_dropped"),
        "rows", "codes", "trading_days", "date_min", "date_max")


def write_panel(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_panel(spark: SparkSession, path: str, build=None) -> DataFrame:
    """Stored panel; built and stored first when missing and ``build`` is given."""
    probe = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = probe.getFileSystem(spark._jsc.hadoopConfiguration()).exists(probe)
    if not there:
        if build is None:
            raise FileNotFoundError(path)
        write_panel(build(), path)
    return spark.read.parquet(path)


def by_code_layout(panel: DataFrame, parts: int) -> DataFrame:
    """Whole histories together: hash on code, sorted inside each partition."""
    return panel.repartition(parts, "code").sortWithinPartitions("code", "date")


def write_bucketed(panel: DataFrame, name: str, parts: int) -> None:
    """Bucketed table on code, so joins and windows on code need no shuffle."""
    panel.write.mode("overwrite").bucketBy(parts, "code").sortBy("code", "date").saveAsTable(name)


def write_report(report: DataFrame, path: str) -> None:
    """Small report as one CSV with a header."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_result(df: DataFrame, path: str) -> None:
    """Result table as parquet."""
    df.write.mode("overwrite").parquet(path)


def write_matrix(matrix: DataFrame, path: str, horizon: int, target: float, stride: int) -> None:
    """Matrix under ``horizon= / target= / stride=`` folders, so readers prune by folder."""
    keyed = matrix.withColumns({
        "horizon": F.lit(horizon), "target": F.lit(target), "stride": F.lit(stride)})
    (keyed.write.mode("append").option("compression", "zstd")
     .partitionBy("horizon", "target", "stride").parquet(path))


def load_matrix(spark: SparkSession, path: str, horizon: int, target: float,
                stride: int | None = None) -> DataFrame:
    """Stored matrix of a horizon and target; the densest stride unless one is named."""
    found = spark.read.parquet(path).filter((F.col("horizon") == horizon) & (F.col("target") == target))
    if stride is None:
        stride = found.agg(F.min("stride")).first()[0]
        if stride is None:
            raise FileNotFoundError(f"no matrix for horizon={horizon}, target={target} in {path}")
    return found.filter(F.col("stride") == stride)


def densify(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every calendar session of a code's own span; a missing one is an all-NULL bar.

    Each code expands its span with a row per session, so the cost is the output itself.
    """
    sessions = calendar.select("date").distinct()
    # One array of sessions: bounded by the calendar, never by the rows of the panel.
    days = sessions.agg(F.sort_array(F.collect_list("date")).alias("_days"))
    spans = panel.groupBy("code").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    grid = spans.join(F.broadcast(days)).select(
        "code", F.explode(F.filter(
            "_days", lambda d: (d >= F.col("_from")) & (d <= F.col("_to")))).alias("date"))
    return grid.join(panel, ["code", "date"], "left")


def key_problems(panel: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Null keys, repeated keys and dates outside the calendar, with their counts."""
    parts = [
        panel.filter(F.col("code").isNull() | F.col("date").isNull())
        .agg(F.count(F.lit(1)).alias("n")).select(F.lit("null_key").alias("problem"), "n"),
        panel.groupBy("code", "date").count().filter("count > 1")
        .agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_key").alias("problem"), "n"),
    ]
    if calendar is not None:
        parts.append(
            panel.join(calendar.select("date").distinct(), "date", "left_anti")
            .agg(F.count(F.lit(1)).alias("n")).select(F.lit("off_calendar").alias("problem"), "n"))
    return reduce(DataFrame.unionByName, parts)


def observed_calendar(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar sessions between the first and the last bar: scheduled days ahead are no follow-up."""
    seen = panel.agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    days = calendar.select("date").distinct().join(F.broadcast(seen))
    return days.filter(F.col("date").between(F.col("_first"), F.col("_last"))).select("date")


def session_index(dates: DataFrame) -> DataFrame:
    """Distinct dates with their position. The window runs over the calendar, not the panel."""
    return dates.select("date").distinct().withColumn(
        "session_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)


def with_session_id(panel: DataFrame) -> DataFrame:
    """Panel with the dense index of its own distinct dates."""
    return panel.join(session_index(panel), "date")
