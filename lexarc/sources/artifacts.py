"""Reading and keeping artifacts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ArtifactMissing(RuntimeError):
    """A run hasn't written this artifact yet."""


def load(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """An artifact with a declared schema. JSON may span lines, as indented exports do."""
    reader = spark.read.option("multiLine", "true") if fmt == "json" else spark.read
    try:
        return (reader.schema(schema) if schema else reader).format(fmt).load(path)
    except AnalysisException as e:
        raise ArtifactMissing(f"{path} is missing: run the pipeline first") from e


def load_or_none(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet") -> DataFrame | None:
    try:
        return load(spark, path, schema, fmt)
    except ArtifactMissing:
        return None


def stored_report(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A report that a run or a reviewer left, with available = true; one row with available = false if there is none."""
    found = load_or_none(spark, path, schema, "json")
    return spark.createDataFrame([(False,)], "available boolean") if found is None else found.withColumn("available", F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see; a temporary folder where it is unset and the master is local."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="lexarc-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def keep(df: DataFrame, folder: str | None = None, name: str = "stage", by: list[str] | None = None) -> DataFrame:
    """Writes a stage's result as Parquet, in folders by the values of some columns, and reads it again, so that later stages start from it."""
    path, schema = f"{folder or new_folder(df.sparkSession)}/{name}", df.schema
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, folder: str) -> None:
    fs, at = _path(spark, folder)
    fs.delete(at, True)


def version(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(bytes, files, time of the last change) of a table, by which a changed input is told from the one that a run has read."""
    fs, at = _path(spark, path)
    held = fs.getContentSummary(at)
    newest = max((x.getModificationTime() for x in fs.listStatus(at)), default=0)
    return held.getLength(), held.getFileCount(), newest


# The artifacts that a run leaves in its output folder.
RUN_ARTIFACTS = ["canonical_transcript", "chunks", "topic_index", "topic_index_markdown", "completeness_report", "run_summary"]


# Of these, the ones that are written as JSON lines.
JSON_ARTIFACTS = {"completeness_report", "run_summary"}


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def publish(spark: SparkSession, staged: str, out: str, names: list[str]) -> None:
    """Puts artifacts that are written as a whole in place of earlier ones; nothing is removed before all new ones are there."""
    absent = [n for n in names if not exists(spark, f"{staged}/{n}")]
    if absent:
        raise ArtifactMissing(f"{staged} lacks {', '.join(absent)}")
    for name in names:
        remove(spark, f"{out}/{name}")
        fs, to = _path(spark, f"{out}/{name}")
        fs.mkdirs(to.getParent())
        if not fs.rename(_path(spark, f"{staged}/{name}")[1], to):
            raise OSError(f"{out}/{name} can't be put in place")
    remove(spark, staged)


def snapshot(spark: SparkSession, output_dir: str, run_name: str) -> str:
    """Copies a run's artifacts to runs/<name> in its output folder; an earlier run of that name goes once the copy is whole."""
    out = output_dir.rstrip("/")
    to, staged = f"{out}/runs/{run_name}", f"{out}/runs/.{run_name}-{uuid.uuid4().hex}"
    try:
        for name in RUN_ARTIFACTS:
            kind = "text" if name in JSON_ARTIFACTS else "parquet"
            at = f"{out}/{name}/run_name={run_name}" if name == "topic_index" else f"{out}/{name}"
            spark.read.format(kind).load(at).write.format(kind).save(f"{staged}/{run_name}/{name}")
        publish(spark, staged, f"{out}/runs", [run_name])
    except Exception:
        remove(spark, staged)
        raise
    return to


def missing(spark: SparkSession, output_dir: str, names: list[str] = RUN_ARTIFACTS) -> list[str]:
    """The artifacts that a run's output folder lacks, in order."""
    found = []
    for name in names:
        fs, at = _path(spark, f"{output_dir.rstrip('/')}/{name}")
        if not fs.exists(at):
            found.append(name)
    return found


def inventory(spark: SparkSession, output_dir: str, names: list[str] = RUN_ARTIFACTS) -> DataFrame:
    """(artifact, present, files, bytes) of a run's output folder."""
    rows = []
    for name in names:
        fs, at = _path(spark, f"{output_dir.rstrip('/')}/{name}")
        held = fs.getContentSummary(at) if fs.exists(at) else None
        rows.append((name, held is not None, held.getFileCount() if held else 0, held.getLength() if held else 0))
    return spark.createDataFrame(rows, "artifact string, present boolean, files long, bytes long")
