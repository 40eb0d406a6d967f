"""Session settings, lineage cuts and size-checked broadcasts."""

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000

#: Tables that ``cut`` wrote in this process and ``sweep`` has not removed.
_WRITTEN: list[str] = []


def build_session(cpus: int = 8, app: str = "cloudloom") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without it."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cloudloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The lineage ends there, so a lost executor costs a re-read, and the next
    plan knows the table's true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``sweep``: how many tables ``cut`` has written so far."""
    return len(_WRITTEN)


def sweep(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Remove the tables that ``cut`` wrote after the mark ``since``, but for the one that ``keep`` was read from.

    For callers that have written a whole result and need nothing it was made from.
    """
    held = set() if keep is None else {f.rsplit("/", 1)[0].split("cut-")[-1] for f in keep.inputFiles()}
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for path in _WRITTEN[since:]:
        if path.split("cut-")[-1] not in held:
            place = hadoop(path)
            place.getFileSystem(conf).delete(place, True)
            _WRITTEN.remove(path)


def discard(df: DataFrame) -> None:
    """Remove the table that ``cut`` returned as ``df``, for callers that have written all they wanted of it."""
    names = {f.rsplit("/", 1)[0].split("cut-")[-1] for f in df.inputFiles()}
    spark = df.sparkSession
    for path in [path for path in _WRITTEN if path.split("cut-")[-1] in names]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _WRITTEN.remove(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs: it acts when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when it is proven to hold at most ``max_rows`` rows.

    Larger inputs are joined by shuffles, as ``many`` says.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return many(df)


def many(df: DataFrame) -> DataFrame:
    """``df`` marked for a join by shuffles, whose skewed partitions AQE may split.

    Rows that a plan makes by ``explode`` do not count in Spark's estimate: left to it, tables of many pixels made from
    few frames would be broadcast.
    """
    return df.hint("merge")


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
