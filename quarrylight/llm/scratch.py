"""Tables written to the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder.  It is only set here when the session has none and all
tasks run in the driver's process, as in tests; on a cluster without it an error is raised, since a
folder of one machine would hold a part of each table only.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session, without a slash at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Rows that go to Python at once.  Texts are wide: Spark's default of 10,000 would be tens of MB in the JVM and in each worker.
#: Spark also ends a batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch), so very long texts come a few at a time.
ARROW_ROWS = 2000
_ARROW, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batches for Python to ARROW_ROWS, unless someone has chosen a number."""
    if spark.conf.get(_ARROW, _DEFAULT) == _DEFAULT:
        spark.conf.set(_ARROW, str(ARROW_ROWS))


class Scratch:
    """A folder of one operator run; each table in it is written once and can be dropped.

    What an operator returns reads from its folder, so only its caller knows when the folder can go:
    as soon as the result is written, by ``drop_since``.
    """

    _own = threading.local()

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/quarrylight/{label}-{uuid.uuid4().hex}"
        Scratch.made().append(self)

    @classmethod
    def made(cls) -> list[Scratch]:
        """The folders that this thread has made."""
        if not hasattr(cls._own, "made"):
            cls._own.made = []
        return cls._own.made

    @classmethod
    def drop_since(cls, n: int) -> None:
        """Removes the folders that this thread made after its first ``n``."""
        made = cls.made()
        for s in made[n:]:
            s.drop("")
        del made[n:]

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it back: lineage ends here and survives lost executors."""
        path = f"{self.path}/{name}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose id is not in the only column of ``gone``; a null id is an id like any other."""
    # rows travel as one column, so their names can't clash with those used here
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"))
    return rows.join(gone.toDF("gone"), F.col("id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
