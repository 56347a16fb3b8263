"""The cluster's shared folder, tables kept there, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast; beyond them the same join is left to a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of this machine's only where that is unset and all run here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="cinderlake-")
        path = _own[application]
    return path.rstrip("/")


class Stored:
    """A table written to the shared folder; ``drop()`` removes its files once nothing reads them."""

    def __init__(self, df: DataFrame, what: str) -> None:
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/cinderlake-{what}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lineage is cut and lost executors cost nothing."""
    return Stored(df, what).df


def value_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: what its strings and arrays hold, and eight for each other value."""
    parts = [F.lit(8)]
    for field in df.schema:
        c, kind = df["`" + field.name.replace("`", "``") + "`"], field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            parts.append(F.coalesce(F.octet_length(F.array_join(c, "        ")), F.lit(0)))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(c if not isinstance(kind, T.StructType) else F.array(c))), F.lit(0)))
        else:
            parts.append(F.lit(8))
    return sum(parts[1:], parts[0]).cast("long")


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint when ``df`` is found to have at most ``most`` rows and ``most_bytes`` bytes; else ``df`` itself, for a shuffled join.

    Counting stops after ``most + 1`` rows.
    """
    n, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(value_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= most_bytes else df
