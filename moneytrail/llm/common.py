"""What the operators share: the word pattern, the shared folder and bytes from Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words; a word is a run of anything else.
SPACE = "[ \\t-\\r]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, none for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local session may do without: there a
    temporary folder is as shared as any."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and a lost executor costs no more than a reread."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the folder of a :func:`written` table after its last reader; what was made from it has to be written too."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The values of a binary column, null as empty."""
    return [x or b"" for x in column.to_pylist()]


def fresh(columns: list[str], name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that is none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(docs: DataFrame, names: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(docs)`` where columns that are called like one of ``names``, which the operator adds, have another name
    meanwhile. Returns the columns of ``docs``; the operator's own are dropped."""
    taken = {n.lower() for n in names}
    other = {}
    for c in docs.columns:
        if c.lower() in taken:
            other[c] = fresh([*docs.columns, *names, *other.values()], c)
    out = run(docs.withColumnsRenamed(other))
    return out.select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns])
