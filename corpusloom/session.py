"""What every operator needs of the session: tables, and a folder that all executors share."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and all executors are in this process (tests), one of this machine."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    by_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if by_context.isDefined():
        return by_context.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes with clean(), or on a local disk when Python ends."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> None:
    """Remove every intermediate table made so far; results that still read one must have been written."""
    while _MADE:
        remove(spark, _MADE.pop())


@atexit.register
def _clean_local() -> None:
    for p in _MADE:
        if p.startswith(("file:/", "/")):
            shutil.rmtree("/" + p.removeprefix("file:").lstrip("/"), ignore_errors=True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: what follows survives the loss of executors and has a short plan."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet, through Hadoop's file systems; of two writers one fails."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(conf).create(to, False)
    out.write(bytearray(text.encode()))
    out.close()


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def get_text(spark: SparkSession, path: str) -> str | None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    stream.close()
    return text


def make(spark: SparkSession, path: str) -> None:
    """A folder, and those above it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a file or folder a new name, at which nothing may be."""
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    if not a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b):
        raise OSError(f"{path} could not be moved to {to}")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName("corpusloom")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"),
    }
    spark = b.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
