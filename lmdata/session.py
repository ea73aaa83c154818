"""Session defaults and tables staged in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lmdata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; what the cluster has set stays."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


#: Bytes of an Arrow batch; a batch of long texts would else reach Spark's 64 MB, held in several copies by a task and its Python worker.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shipped(spark: SparkSession) -> SparkSession:
    """The session, after its Python workers can import this package even where it is not installed: sent once, as a zip file.

    Batches for them are held to BATCH_BYTES, unless the application's configuration names a size.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if not context.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if not getattr(context, "_lmdata_shipped", False) and root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="lmdata-")) / "lmdata.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        context.addPyFile(str(target))
        context._lmdata_shipped = True
    return spark


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster shares; in a temporary one only in local mode, where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = getattr(scratch, "own", None) or "file://" + tempfile.mkdtemp(prefix="lmdata-")
        scratch.own = folder
    return f"{folder.rstrip('/')}/lmdata-{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to and read from the folder that the cluster shares: cuts the lineage and outlives executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a filter at most: 16 MB.
MOST_BITS = 1 << 27


def filter_blocks(values: DataFrame, n: int | None = None) -> tuple[int, DataFrame]:
    """(bits, rows (block, m)) of a frame of one whole-number column with about ``n`` rows: a value's bit is the one its low bits say.

    There are 16 bits for each row, up to MOST_BITS, in at most 4096 blocks of 4 kB.  What the filter passes has to be looked up exactly,
    so that a full one costs time alone.
    """
    n = values.count() if n is None else n
    bits = min(MOST_BITS, 1 << max(15, (16 * n).bit_length()))
    at = F.col(values.columns[0]).bitwiseAND(F.lit(bits - 1))
    marks = values.select(F.shiftright(at, 15).alias("block"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("at"))
    return bits, marks.groupBy("block").agg(F.bitmap_construct_agg("at").alias("m"))


def bit_filter(values: DataFrame, n: int) -> tuple[int, bytes]:
    """(bits, table) of ``filter_blocks``, put together."""
    bits, blocks = filter_blocks(values, n)
    table = bytearray(bits // 8)
    for r in blocks.collect():  # at most 4096 rows of 4 kB
        table[r["block"] << 12 : (r["block"] << 12) + 4096] = r["m"]
    return bits, bytes(table)
