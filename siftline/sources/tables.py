"""Tables on disk: scans by split, channels, vectors, answers, logs, and the catalog of artifacts."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import math as M

SPLITS = ("val", "test", "rtrain", "bench")
CHANNEL = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("score", T.FloatType()), T.StructField("rank", T.IntegerType())])
ANSWER = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("answer", T.StringType())])
META = T.StructType([T.StructField(n, T.BooleanType() if n == "fit_only" else T.StringType()) for n in ("owner", "name", "kind", "description", "fit_only", "created")])


class ContractError(ValueError):
    """A table breaks the contract of its kind."""


class Store:
    """A folder of named tables that Spark can reach: corpus, queries, histories, channels and other artifacts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def corpus(self, columns: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/items")
        return df.select(*columns) if columns else df

    def queries(self, split: str) -> DataFrame:
        return self._of_split("queries", split)

    def qrels(self, split: str) -> DataFrame:
        if split == "bench":
            raise ValueError("the bench split has no labels")
        return self._of_split("qrels", split)

    def meta(self, split: str) -> DataFrame:
        return self._of_split("meta", split)

    def train_rows(self, for_split: str, columns: list[str] | None = None) -> DataFrame:
        """The rows that a model for this split may learn from: all for bench, the history without it for others."""
        self._check(for_split)
        name = "train" if for_split == "bench" else "hist"
        df = self.spark.read.parquet(f"{self.root}/{name}")
        return df.select(*dict.fromkeys([*(columns or df.columns), *(["train_row_id"] if name == "hist" else [])]))

    @staticmethod
    def _check(split: str) -> None:
        if split not in SPLITS:
            raise ValueError(f"unknown split {split!r}; it is one of {', '.join(SPLITS)}")

    def _of_split(self, table: str, split: str) -> DataFrame:
        self._check(split)
        return self.spark.read.parquet(f"{self.root}/{table}").where(F.col("split") == split).drop("split")  # a partition column: other splits aren't read

    def save_split(self, table: str, split: str, df: DataFrame) -> None:
        """Writes a split's rows of a table; what the split had before is replaced, other splits stay."""
        self._check(split)
        writer = df.withColumn("split", F.lit(split)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("split").option("compression", "zstd").parquet(f"{self.root}/{table}")

    # Artifacts

    def _path(self, owner: str, name: str) -> str:
        if any(p in ("", ".", "..") or "/" in p for p in (owner, name)):
            raise ContractError(f"bad artifact name {owner}/{name}")
        return f"{self.root}/artifacts/{owner}/{name}"

    def save_channel(self, owner: str, name: str, split: str, df: DataFrame, most: int = 2000) -> None:
        """Writes a channel, sorted by query and rank, and puts it in place once what was written keeps the contract."""
        self._check(split)
        place = f"{self._path(owner, name)}/{split}"
        aside = f"{self._path(owner, name)}/_{split}-{uuid.uuid4().hex}"
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in CHANNEL])
        df.repartition("query_id").sortWithinPartitions("query_id", "rank").write.option("compression", "zstd").parquet(aside)
        try:
            self._check_channel(owner, name, split, self.spark.read.schema(CHANNEL).parquet(aside), most)
            self._delete(place)
            if not self._fs(aside).rename(self._hadoop(aside), self._hadoop(place)):
                raise OSError(f"{aside} can't be moved to {place}")
        except BaseException:
            self._delete(aside)
            raise

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._hadoop(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        self._fs(path).delete(self._hadoop(path), True)

    def _check_channel(self, owner: str, name: str, split: str, df: DataFrame, most: int) -> None:
        bad = (
            df.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("d"), F.min("rank").alias("first"))
            .agg(F.sum((F.col("n") > most).cast("int")).alias("too_long"), F.sum((F.col("n") != F.col("d")).cast("int")).alias("repeated"), F.sum((F.col("first") != 1).cast("int")).alias("not_from_one"))
        ).first()
        strange = df.join(self.queries(split).select("query_id"), "query_id", "left_anti").limit(1).count(), df.join(self.corpus(["item_id"]), "item_id", "left_anti").limit(1).count()
        if any(bad) or any(strange):
            raise ContractError(f"channel {owner}/{name}: {bad.asDict()}, unknown queries {strange[0]}, unknown items {strange[1]}")

    def channel(self, owner: str, name: str, split: str) -> DataFrame:
        return self.spark.read.schema(CHANNEL).parquet(f"{self._path(owner, name)}/{split}")

    def save_vectors(self, owner: str, name: str, split: str, df: DataFrame, n_rows: int, tolerance: float = 1e-2) -> None:
        """Writes id, vector after checking the number of rows and that all have length 1."""
        bad = df.agg(F.count("*").alias("n"), F.max(F.abs(M.norm(F.col("vector")) - 1)).alias("off")).first()
        if bad.n != n_rows or (bad.off or 0) > tolerance:
            raise ContractError(f"vectors {owner}/{name}: {bad.n} rows of {n_rows}, lengths off by up to {bad.off}")
        df.select("id", F.col("vector").cast("array<float>")).write.mode("overwrite").parquet(f"{self._path(owner, name)}/{split}")

    def vectors(self, owner: str, name: str, split: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._path(owner, name)}/{split}")

    def save_meta(self, owner: str, name: str, kind: str, description: str, fit_only: bool) -> None:
        row = {"owner": owner, "name": name, "kind": kind, "description": description, "fit_only": fit_only, "created": ""}
        one = self.spark.createDataFrame([tuple(row[f.name] for f in META)], META).withColumn("created", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
        one.coalesce(1).write.mode("overwrite").json(f"{self._path(owner, name)}/meta.json")

    def catalog(self) -> DataFrame:
        """The descriptions of all artifacts."""
        return self.spark.read.schema(META).json(f"{self.root}/artifacts/*/*/meta.json")

    def complete_channels(self, first: str = "baseline") -> list[tuple[str, str]]:
        """Owner and name of the channels that exist for every split, the owner ``first`` before the others."""
        names = [(r.owner, r.name) for r in self.catalog().where("kind = 'channel'").select("owner", "name").distinct().collect()]  # a few artifacts

        def there(owner: str, name: str, split: str) -> bool:
            path = f"{self._path(owner, name)}/{split}"
            return self._fs(path).exists(self._hadoop(path))

        return sorted((x for x in names if all(there(*x, s) for s in SPLITS)), key=lambda x: (x[0] != first, x))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers from CSV; ids stay strings, a missing answer is empty."""
    return spark.read.schema(ANSWER).option("header", True).csv(path).fillna("", ["answer"])


def write_answers(answers: DataFrame, path: str) -> None:
    answers.select("query_id", "answer").coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def append_log(spark: SparkSession, path: str, record: dict) -> None:
    """Adds one line to a results log. Every call writes a file of its own, so writers need no lock."""
    row = {"id": uuid.uuid4().hex, "ts": dt.datetime.now().isoformat(timespec="milliseconds"), **record}
    spark.createDataFrame([(json.dumps(row, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A log of JSON lines; blank lines are skipped."""
    if schema is None:
        return spark.read.json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def versions(spark: SparkSession, paths: list[str]) -> str:
    """16 hexadecimal digits that change when a file below one of the paths comes, goes or is rewritten. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return content_hash(files.select("path", "length", F.unix_micros("modificationTime").alias("modified")))


def content_hash(df: DataFrame) -> str:
    """The first 16 hexadecimal digits of a hash that doesn't depend on the order of rows."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    total = df.select(F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count("*").alias("n")).first()
    return df.sparkSession.range(1).select(F.substring(F.sha2(F.lit(f"{total.s}/{total.n}"), 256), 1, 16)).first()[0]


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
