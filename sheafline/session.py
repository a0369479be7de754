"""Session helpers: code shipping, the shared folder, staged tables.

Nothing here reads data. ``staged`` is the one way in which operators cut
lineage: it writes a table into the folder that driver and executors share.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sheafline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_sheafline_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="sheafline-")
    archive = os.path.join(folder, "sheafline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(path.relative_to(_PACKAGE.parent)))
    context.addPyFile(archive)
    context._sheafline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode and where it is unset."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_sheafline_shared", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sheafline-shared-")
        context._sheafline_shared = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder; ``release`` deletes it."""
    path = f"{shared_dir(spark)}/sheafline-{label}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def _made(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_sheafline_made"):
        context._sheafline_made = []
    return context._sheafline_made


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The write is one job with Spark's commit protocol, so a lost executor costs
    only its running tasks; later reads do not depend on executors at all.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made_so_far(spark: SparkSession) -> int:
    """A mark for ``release``."""
    return len(_made(spark))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the paths made since the mark but for the last ``keep``.

    For callers that have read what they need: a DataFrame of an operator may read its staged tables until it is written.
    """
    made = _made(spark)
    gone = made[since : len(made) - keep]
    del made[since : len(made) - keep]
    for path in gone:
        remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system; none is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def place_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, given as a URI or a local path, and its path there."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that stand for files, dealt over several tasks a core: small rows would else be put together into few tasks, however many files they are."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def write_whole(folder: str, name: str, data: bytes) -> None:
    """Write a file below a folder: beside its place and moved there, so that readers see whole files and a repeated task does no harm."""
    filesystem, root = pafs.FileSystem.from_uri(folder)
    place = f"{root}/{name}"
    filesystem.create_dir(place.rsplit("/", 1)[0], recursive=True)
    put_whole(filesystem, place, data)


def put_whole(filesystem: pafs.FileSystem, place: str, data: bytes, part: str | None = None) -> None:
    """The same where the file system is known and the folder is there; ``part`` is written first and moved."""
    part = part or f"{place}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(part) as file:
        file.write(data)
    try:
        filesystem.move(part, place)
    except OSError:  # some file systems don't move onto a file that is there
        filesystem.delete_file(place)
        filesystem.move(part, place)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
