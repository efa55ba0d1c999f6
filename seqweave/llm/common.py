"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token: a run of characters other than ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest number of rows of a few numbers each that an operator broadcasts; beyond it, it joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes in a row group of an intermediate table.
ROW_GROUP = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where none is named, a local session (tests, single machine) gets a temporary one; on a cluster that is an error, as
    a folder of one machine is lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """df, computed once, written as a table to the shared folder and read again.

    That cuts the lineage, survives lost executors, and gives the rows fresh size estimates: checkpointed frames keep
    the estimates of the joins they come from, which multiply in every round of a loop.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    # Writers and readers hold a row group in memory. The mark of success, which only the reader below would look for, costs the driver
    # two of the five processes that a table on a local disk takes of it.
    df.write.option("parquet.block.size", ROW_GROUP).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_ = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the tables of frames made by reliable() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "path_", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else unchanged; df must be cheap to count.

    Where rows hold arrays, `rows` is the number of their elements.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns of df, nulls told from other values; columns that cannot be hashed (maps) are left out."""
    told = sorted(c for c, t in df.dtypes if not any(x in t for x in ("map<", "variant")))
    return F.xxhash64(F.lit(seed), *[F.struct(F.col(c).isNull(), c) for c in told])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null: none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def id_remainder(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, mod n; a null key gives -1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1))


def let(value: Column, f) -> Column:
    """f(value) with value computed once; the optimizer would else copy it into lambdas and run it for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
