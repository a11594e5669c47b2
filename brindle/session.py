"""Session helpers: the shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "brindle", cores: int = 8, shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return reach(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver's working folder or PYTHONPATH doesn't."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, a temporary one where driver and executors are one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_OPEN: list[list[str]] = []  # paths of the tables stashed in each open scope


def stash(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def unstash(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage, so the heap that a stage grew goes back before the next one's Python workers want memory.

    There is a task for each core, so each executor gets one where all are idle; one that gets none keeps its heap.
    """
    sc = spark.sparkContext
    alone = sc._jsc.sc().getExecutorMemoryStatus().size() == 1  # the driver itself, in local mode
    tasks = 1 if alone else sc.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


class scope:
    """Tables stashed inside are deleted at the end, but for those that are kept. What leaves the scope reads kept ones only."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> scope:
        _OPEN.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """df stashed, to outlive this scope."""
        out = stash(df)
        self.kept.add(_OPEN[-1][-1])
        return out

    def __exit__(self, *error) -> None:
        made = _OPEN.pop()
        for path in made:
            if path not in self.kept:
                delete_path(self.spark, path)
        if _OPEN:
            _OPEN[-1] += [p for p in made if p in self.kept]
