"""Helpers shared by the document operators: shared-folder tables, Arrow batches, input checks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: very long texts must not pile up in a Python worker.
BATCH_ROWS = 512
#: Text that a worker holds as Python objects at once.
CHUNK_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the session's checkpoint folder. Only a local session,
    whose executors are the driver, gets a folder of its own where neither is set; a cluster without one is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}/ripplemark-shared"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut a plan's lineage.

    A lost executor loses nothing: the tables are in the shared folder. ``drop`` removes a
    table that no returned DataFrame reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drop all tables but these, which a returned DataFrame reads."""
        self.drop(*sorted(self.names - set(names)))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that a batch of very long texts fits in a worker. The setting is read when a plan runs, so
    it stays lowered for the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def chunks(batches: Iterable[pa.RecordBatch], text_col: str, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches of about ``most`` characters, with their texts (null: empty)."""
    for batch in batches:
        texts = [t if t is not None else "" for t in batch.column(text_col).to_pylist()]
        start = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= most or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; whatever else a table holds cannot clash with its own names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so that they need not share a folder with the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_ripplemark_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{root.name}-source.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._ripplemark_sent = True


def gathered(df: DataFrame) -> pd.DataFrame:
    """A bounded table on the driver, by Arrow whatever the session's settings: no Python object for each row and value."""
    return df.toArrow().to_pandas()


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def crc_remainder(id_col: str, modulus: int):
    """crc32 of an id as text, modulo; null ids count as remainder null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def filter_rows(df: DataFrame, decide: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows whose texts (null: empty) are kept, with all columns and no shuffle. decide is called in each task and
    gives the function that decides on a list of texts."""

    def run(batches):
        keeps = decide()
        for part, texts in chunks(batches, text_col):
            yield part.filter(pa.array(keeps(texts), pa.bool_()))

    return map_arrow(df, run, df.schema)


#: Ids that are broadcast; beyond it a shuffle joins them.
BROADCAST_IDS = 500_000
