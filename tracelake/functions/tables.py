"""Tables in buckets with atomic commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.storage import remove, written

#: Commits of a table whose buckets stay for readers that have resolved them: the live one and the one before.
COMMITS_KEPT = 2


class BucketTable:
    """A table in buckets, each with a version; a commit names the live version of every bucket, and is the only thing readers go by.

    A commit is written under another name and then renamed, last of all, so a reader, and a batch that follows a failure, sees
    all of a batch or nothing of it. Files are reached through the file system that the table's address names.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.make = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.make(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self.store.listStatus(at)] if self.store.exists(at) else []

    def commits(self) -> list[int]:
        return sorted(int(n) for n in self.names("_commits") if n.isdigit())

    def live(self, number: int | None = None) -> dict[int, int]:
        """Bucket to version as of a commit, the last one if none is named; empty before the first."""
        number = number if number is not None else max(self.commits(), default=None)
        if number is None:
            return {}
        lines = self.spark.read.text(f"{self.path}/_commits/{number}").collect()  # a line a bucket
        return {int(b): int(v) for b, v in (r[0].split(" ") for r in lines)}

    def commit(self, number: int, live: dict[int, int]) -> None:
        folder = self.make(f"{self.path}/_commits")
        self.store.mkdirs(folder)
        draft = self.make(f"{self.path}/_commits/_{number}-{uuid.uuid4().hex}")
        out = self.store.create(draft, True)
        out.write(bytearray("".join(f"{b} {v}\n" for b, v in sorted(live.items())).encode()))
        out.close()
        if not self.store.rename(draft, self.make(f"{self.path}/_commits/{number}")) and number not in self.commits():
            raise OSError(f"commit {number} of {self.path} couldn't be renamed")

    def read(self, schema=None, live: dict[int, int] | None = None) -> DataFrame | None:
        """The rows of the live versions, None if there are none."""
        live = self.live() if live is None else live
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.option("basePath", self.path).parquet(*(f"{self.path}/v={v}/bucket={b}" for b, v in sorted(live.items()))) if live else None

    def clean(self) -> None:
        """Deletes what no kept commit names, and commits that aren't kept."""
        kept = self.commits()[-COMMITS_KEPT:]
        used = {(v, b) for n in kept for b, v in self.live(n).items()}
        for n in self.commits()[:-COMMITS_KEPT]:
            self.store.delete(self.make(f"{self.path}/_commits/{n}"), False)
        for folder in self.names(""):
            if folder.startswith("v=") and int(folder[2:]) <= kept[-1]:
                for bucket in self.names(folder):
                    if bucket.startswith("bucket=") and (int(folder[2:]), int(bucket[7:])) not in used:
                        self.store.delete(self.make(f"{self.path}/{folder}/{bucket}"), True)

    def replace(self, rows: DataFrame, number: int, key: str, order: str | None = None, buckets: int = 16) -> None:
        """Commit ``number``: the rows of each key that ``rows`` have take the place of that key's rows; with an ``order``, one row a key, the latest, stays.

        The buckets that those keys lie in are written anew, with the other keys they hold, as ``v=<number>``, then the commit, then what no kept
        commit names is deleted. Repeated after a failure before the commit all is written again; after it, there is only the cleaning.
        """
        if number not in self.commits():
            given = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            new, live = written(given, "bucket-rows"), self.live()
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            schema = T.StructType([*given.schema, T.StructField("v", T.LongType())])
            held, every = self.read(schema, {b: live[b] for b in touched if b in live}), new.withColumn("v", F.lit(number).cast("long"))
            if held is not None and order is None:
                held = held.join(new.select(key).distinct(), key, "left_anti")
            every = every if held is None else held.unionByName(every)
            if order is not None:
                every = every.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(order, "v")).alias("r")).select("r.*")
            every.drop("v").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={number}")
            self.commit(number, live | dict.fromkeys(touched, number))
            remove(new)
        self.clean()

    def table(self) -> DataFrame:
        """The rows as of the last commit. What is read stays for one more commit."""
        rows = self.read()
        if rows is None:
            raise ValueError(f"{self.path} has no commit yet")
        return rows.drop("bucket", "v")
