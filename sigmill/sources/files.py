"""Landing files: JSON payloads, CSV as text, source trees; and the sinks that results go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders of a source tree that are no part of it.
SKIPPED = (".git", "venv", ".venv", "env", "dist", "build", "__pycache__", ".tox", ".mypy_cache", ".ruff_cache", "node_modules")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(page, record) of pages of an interface (one JSON object a file): the records of ``data`` as JSON text; none where it is no list."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.get_json_object("value", "$.data").alias("data"))
    return pages.select("page", F.explode(F.from_json("data", "array<string>")).alias("record"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of files that are one JSON list each."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("record"))


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text; quotes are doubled and values may span lines."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def sources(spark: SparkSession, root: str, ending: str = ".py") -> DataFrame:
    """(path, text) of the files below a folder with one ending, without the folders of SKIPPED."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").load(root)
    inner = F.regexp_replace("path", r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.select(inner.alias("path"), F.decode("content", "UTF-8").alias("text")).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


def merged(frames: dict[str, DataFrame], order: str, most: dict[str, int], width: int = 500) -> DataFrame:
    """The rows (title) of several sources in one frame, each source's first rows by ``order`` up to its number, texts cut to ``width``: a report's inputs."""
    out = None
    for kind, df in frames.items():
        one = df.orderBy(order).limit(most[kind]).select(F.lit(kind).alias("kind"), F.substring("title", 1, width).alias("title"))
        out = one if out is None else out.unionByName(one)
    return out


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One folder of CSV with a header and the columns in this order."""
    df.select(*columns).write.csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str, about: dict[str, str]) -> None:
    """``rows``: the rows, one JSON object a line; ``about``: one row that describes them, with their number."""
    df.write.json(f"{path}/rows")
    df.agg(F.count(F.lit(1)).alias("rows")).select(*[F.lit(v).alias(k) for k, v in about.items()], "rows").coalesce(1).write.json(f"{path}/about")


def append(df: DataFrame, path: str, cut: dict[str, int] | None = None) -> None:
    """Rows added to a Parquet table; texts of ``cut`` end at a number of letters."""
    df.withColumns({c: F.substring(c, 1, n) for c, n in (cut or {}).items()}).write.mode("append").parquet(path)
