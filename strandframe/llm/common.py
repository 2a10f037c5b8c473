"""What the corpus operators share: bounded Arrow batches, checkpoints, joins that no hot key can overload."""

from __future__ import annotations

import gc
import pickle
import sys
import tempfile
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# functions that run on executors travel with the task, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: ASCII blanks; every operator splits words on these and on nothing else.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of one Arrow batch: texts may be long, and a batch is held in memory twice.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

#: A key that holds more than one row in HOT_SHARE is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Rows up to which a measured table is broadcast.
BROADCAST_ROWS = 50_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make sure that checkpoints have a folder.

    The folder is the cluster's `spark.checkpoint.dir`; where that is unset, a local session gets a temporary one, and
    on a cluster it is an error, as executors don't see the driver's own folders. The bounds stay set in the session,
    since plans that need them run later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandframe-"))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    import uuid

    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """`cut` for the state of a loop. A checkpoint keeps the optimizer's guess of its size, and that of a join is the product
    of its sides, so over the rounds the guess gets thousands of digits and planning takes minutes. Here it is left behind."""
    done = cut(df)
    plain = done._jdf.sparkSession().internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(plain, df.sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and checkpoints of steps whose results were written and that nothing names
    any more. By itself it waits for the driver's garbage collector, which a small driver heap may not call for long."""
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession, value) -> Callable:
    """A function that returns `value` on executors; it is broadcast once, with the code it needs. Its size is the caller's to bound."""
    box, memo = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def load():
        if not memo:
            memo.append(pickle.loads(box.value))
        return memo[0]

    return load


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of `rows` with `table`, which has one row for each `key`, whatever share of the rows a key has.

    `table` has to be materialised; its column `weight` says how many of the `total` rows have the key.
    A table of at most `broadcast_rows` rows (counted here) is broadcast. Beyond that only the hot keys
    are: those with more than 1/HOT_SHARE of all rows, which can't be more than HOT_SHARE of them. The
    others, none of which can overload a task, go through a shuffle. A null key matches nothing.
    """
    extra = [c for c in table.columns if c not in (key, weight)]
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(table.drop(weight)), key, "left")
    hot = F.col(weight) * HOT_SHARE > F.lit(total)
    first = rows.join(F.broadcast(table.where(hot).drop(weight).withColumn("__hot", F.lit(True))), key, "left")
    rest = first.where("__hot is null").drop("__hot", *extra).join(table.where(~hot).drop(weight), key, "left")
    return first.where("__hot").drop("__hot").unionByName(rest)


#: Ids up to which a measured list of dropped rows is broadcast: 8 bytes each, about 24 MB as a hash table.
BROADCAST_IDS = 1_000_000


def within(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows of `docs` whose `key` is in `ids`. The ids are written and counted first: up to BROADCAST_IDS they are broadcast
    and no text is shuffled; beyond that both sides are dealt out by the key, which no id can overload."""
    ids = cut(ids)
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of `docs` whose `key` isn't in `gone`, in the same way."""
    return within(docs, gone, key, "left_anti")
