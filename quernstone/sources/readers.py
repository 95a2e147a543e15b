"""Readers and writers: delimited tables, JSON lines, incremental loads, catalogs and pushed filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tbl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """|-delimited text, with or without a delimiter at line ends."""
    return spark.read.csv(path, sep="|", schema=schema, mode="PERMISSIVE")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records, and the text of bad ones."""
    raw = spark.read.schema(f"{schema}, _corrupt STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    return raw.filter("_corrupt IS NULL").drop("_corrupt"), raw.filter("_corrupt IS NOT NULL").select("_corrupt")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def auto_load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV folder as a stream, with each row's file and the time of ingestion."""
    return spark.readStream.schema(schema).option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("_source_file"), F.current_timestamp().alias("_ingest_ts"))


def incremental(df: DataFrame, column: str, since) -> DataFrame:
    """Rows above the high-water mark; the filter reaches the scan."""
    return df if since is None else df.filter(F.col(column) > F.lit(since))


def high_water(df: DataFrame, column: str):
    return df.agg(F.max(column)).first()[0]


def write_features(df: DataFrame, path: str, group: str, day: str) -> None:
    """feature_group=.../date=... folders; only the days in the frame are replaced."""
    out = df.withColumn("feature_group", F.lit(group)).withColumn("date", F.to_date(day))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_group", "date").parquet(path)


def read_features(spark: SparkSession, path: str, group: str, start: str, end: str, entities: tuple[str, list] | None = None, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path).filter((F.col("feature_group") == group) & F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if entities:
        df = df.filter(F.col(entities[0]).isin(entities[1]))
    return df.select(*columns) if columns else df


def dsl_source(spark: SparkSession, format: str, location: str, options: dict | None = None, schema: str | None = None) -> DataFrame:
    reader = spark.read.format(format).options(**(options or {}))
    return (reader.schema(schema) if schema else reader).load(location)


def dsl_sink(df: DataFrame, format: str, location: str, options: dict | None = None, mode: str = "overwrite") -> None:
    df.write.format(format).mode(mode).options(**(options or {})).save(location)


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 8, **options) -> DataFrame:
    """A JDBC table, read in ranges of a numeric column where one is given; filters are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("pushDownPredicate", "true").options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()


class Catalog:
    """Named sources, declared once and read lazily: name -> (format, location, schema)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.entries = spark, {}

    def add(self, name: str, format: str, location: str, schema: str | None = None, **options) -> Catalog:
        self.entries[name] = (format, location, schema, options)
        return self

    def add_frame(self, name: str, df: DataFrame) -> Catalog:
        self.entries[name] = df
        return self

    def read(self, name: str) -> DataFrame:
        e = self.entries[name]
        return e if isinstance(e, DataFrame) else dsl_source(self.spark, e[0], e[1], e[3], e[2])

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the sources, whatever system each lives in."""
        from quernstone.plans.sqlpair import guarded

        for name in self.entries:
            self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(guarded(text))


def time_range(df: DataFrame, metric: str, tags: dict[str, str], start, end, ts: str = "ts") -> DataFrame:
    """Points of a metric that carry all these tags, from start to before end."""
    cond: Column = (F.col("metric") == metric) & (F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))
    for k, v in tags.items():
        cond = cond & (F.try_element_at("tags", F.lit(k)) == v)
    return df.filter(cond).orderBy(ts)


def new_files(spark: SparkSession, path: str, seen: DataFrame, after=None) -> DataFrame:
    """Files of a folder that the manifest (path, length) does not have: path, length, modified, late."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    out = files.join(seen.select("path", "length"), ["path", "length"], "left_anti")
    return out.withColumn("late", F.col("modified") < F.lit(after) if after is not None else F.lit(False))


def pushdown(df: DataFrame) -> dict[str, list[str]]:
    """Which filters of a plan its scans take (pushed, partition) and which stay above them (residual), as the physical plan states them."""
    import re

    text = df._jdf.queryExecution().sparkPlan().toString()
    found: dict[str, list[str]] = {}
    for name, label in (("pushed", "PushedFilters"), ("partition", "PartitionFilters")):
        found[name] = [x for part in re.findall(label + r": \[(.*?)\](?:,|$)", text, re.M) for x in re.split(r", (?=[A-Za-z]+\()", part) if x]
    found["residual"] = re.findall(r"^[ +:*()0-9-]*Filter (.*)$", text, re.M)
    return found
