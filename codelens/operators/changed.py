"""Problem 6: processing only records that are new or changed since the last successful run.

The watermark is the greatest run whose last attempt succeeded. A run fixes its upper limit before it reads anything, so
rows that arrive meanwhile belong to the next run; it reads the rows above the watermark and the state kept at it; its output
becomes visible in the same atomic rename that moves the watermark, so a failed run leaves nothing behind and a repeated one
repeats nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_success(runs: DataFrame, run: str = "run_id", attempt: str = "attempt", status: str = "status", ok: str = "success") -> int | None:
    """The greatest run whose last attempt has the status `ok`; None if there is none. One row comes to the driver."""
    last = runs.groupBy(run).agg(F.max_by(status, attempt).alias("s"))
    return last.where(F.col("s") == ok).agg(F.max(run).alias("m")).first()["m"]


def changed(df: DataFrame, keys: list[str], digest: str, at: str, since: int | None, run: str = "run_id", upto: int | None = None) -> DataFrame:
    """The keys whose current digest is new or differs from the one recorded up to run `since` (None: nothing recorded).

    Rows with a null digest count as not there; rows of runs beyond `upto` are left for the next run. The digest at the
    greatest time counts; of equal times, that of the greatest run, then the greatest digest. Keys may be null (nulls are
    one key). Repeated rows change nothing. A single aggregation with map-side combine, so hot keys cost no more than
    others.
    """
    order: Column = F.struct(F.col(at), F.col(run), F.col(digest))
    rows = df.select(*keys, run, at, digest).where(F.col(digest).isNotNull())
    if upto is not None:
        rows = rows.where(F.col(run) <= upto)
    old = F.when(F.col(run) <= F.lit(since), order) if since is not None else F.lit(None).cast(f"struct<{at}:timestamp,{run}:int,{digest}:string>")
    state = rows.groupBy(*keys).agg(F.max(order).alias("__now"), F.max(old).alias("__old"))
    now, was = F.col("__now").getField(digest), F.col("__old").getField(digest)
    return state.where(was.isNull() | (now != was)).select(*keys, now.alias(digest))


def state_of(df: DataFrame, keys: list[str], digest: str, at: str, upto: int | None, run: str = "run_id") -> DataFrame:
    """keys and `__last`, the (time, run, digest) of each key's last row of runs up to `upto`, without null digests: what a run keeps,
    so that the next one reads the rows of later runs only."""
    rows = df.where(F.col(digest).isNotNull())
    rows = rows.where(F.col(run) <= upto) if upto is not None else rows.limit(0)
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col(at), F.col(run), F.col(digest))).alias("__last"))


def increment(df: DataFrame, state: DataFrame, keys: list[str], digest: str, at: str, since: int | None, upto: int, run: str = "run_id") -> DataFrame:
    """keys and (`__was`, `__last`) of every key of the state or of the rows of runs in (since, upto]: its last (time, run, digest) at
    run `since` and at run `upto`. Only rows of the increment are read from `df` (the limits reach the scan); they are combined per
    key before they meet the state."""
    rows = df.where(F.col(digest).isNotNull() & (F.col(run) <= upto))
    rows = rows.where(F.col(run) > since) if since is not None else rows
    new = rows.groupBy(*keys).agg(F.max(F.struct(F.col(at), F.col(run), F.col(digest))).alias("__new"))
    both = state.select(*keys, F.col("__last").alias("__was"), F.lit(None).cast(new.schema["__new"].dataType).alias("__new"))
    both = both.unionByName(new.select(*keys, F.lit(None).cast(new.schema["__new"].dataType).alias("__was"), "__new"))
    both = both.groupBy(*keys).agg(F.max("__was").alias("__was"), F.max("__new").alias("__new"))
    return both.select(*keys, "__was", F.greatest("__was", "__new").alias("__last"))


def differing(moved: DataFrame, digest: str) -> DataFrame:
    """Of `increment`, the keys without a recorded digest or with one that differs from the current one."""
    now, was = F.col("__last").getField(digest), F.col("__was").getField(digest)
    return moved.where(was.isNull() | (now != was)).drop("__was", "__last")


class Progress:
    """The watermark of a pipeline, kept beside its outputs in a folder that all executors share (any Hadoop file system).

    `commits/NNNNNNNN` names the limit and the outputs of each successful run. A run fixes its limit before it reads, writes its
    outputs (changes and the state that the next run starts from) under a name of its own, and then renames a draft to the next
    commit without overwriting. The rename is the one step that makes outputs and watermark visible: a run that fails before leaves
    nothing that is ever read, and of two runs that race one gets the number and the other deletes what it wrote. File systems
    must rename atomically (HDFS, local, NFS); object stores need a committer that does.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(folder).toUri(), conf) if "://" in folder else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self._fs.mkdirs(self._path(f"{folder}/commits"))

    def commits(self) -> list[dict]:
        """All commits in order."""
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/commits")) if not f.getPath().getName().startswith("."))
        return [json.loads(self._read(f"{self.folder}/commits/{n}")) for n in names]

    def _read(self, file: str) -> str:
        data = self._fs.open(self._path(file))
        try:
            return bytes(data.readAllBytes()).decode()
        finally:
            data.close()

    def watermark(self) -> int | None:
        done = self.commits()
        return done[-1]["upto"] if done else None

    def read(self, name: str) -> DataFrame | None:
        """An output of the last successful run."""
        done = self.commits()
        return self.spark.read.parquet(f"{done[-1]['data']}/{name}") if done else None

    def run(self, upto: int | None, make: Callable[[int | None, int | None], dict[str, DataFrame]]) -> str | None:
        """Write the outputs of make(watermark, upto) and move the watermark to `upto`; None if it is there already."""
        done = self.commits()
        since = done[-1]["upto"] if done else None
        if done and (upto is None or since is not None and upto <= since):
            return None
        out = f"{self.folder}/data/{uuid.uuid4().hex}"
        draft = f"{self.folder}/commits/.{uuid.uuid4().hex}"
        try:
            for name, df in make(since, upto).items():
                df.write.parquet(f"{out}/{name}")
            f = self._fs.create(self._path(draft), False)
            f.write(json.dumps({"since": since, "upto": upto, "data": out}).encode())
            f.close()
            self._files.rename(self._path(draft), self._path(f"{self.folder}/commits/{len(done):08d}"), self._keep)
        except BaseException:
            self._fs.delete(self._path(draft), False)
            self._fs.delete(self._path(out), True)
            raise
        return out
