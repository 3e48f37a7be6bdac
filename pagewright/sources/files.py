"""Files of any kind as rows: content kinds, lists, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How files of a kind begin, and their extension.
SIGNATURES = (
    (b"%PDF-", ".pdf"), (b"%PDF", ".pdf"), (b"\xff\xd8\xff", ".jpg"), (b"\x89PNG\r\n\x1a\n", ".png"), (b"GIF87a", ".gif"), (b"GIF89a", ".gif"), (b"PK\x03\x04", ".zip"), (b"{\\rtf", ".rtf"), (b"\xd0\xcf\x11\xe0", ".doc"),
    (b"II*\x00", ".tif"), (b"MM\x00*", ".tif"), (b"BM", ".bmp"), (b"RIFF", ".webp"), (b"\x00\x00\x00\x18ftypheic", ".heic"), (b"\x00\x00\x00\x18ftypheix", ".heic"), (b"\x00\x00\x00\x20ftypheic", ".heic"),
)


def extension_of(content: Column) -> Column:
    """The extension a file's first bytes tell, '' if none does."""
    out = F.lit("")
    for sig, ext in reversed(SIGNATURES):
        out = F.when(F.substring(content, 1, len(sig)) == F.lit(sig), ext).otherwise(out)
    return out


def sniffed(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``extension`` of the files of a folder; empty files have no row."""
    return spark.read.format("binaryFile").load(folder).select("path", extension_of(F.col("content")).alias("extension"))


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``stem``, ``text``, ``text_mtime`` of the text files of a folder; the stem is the file's name without its ending."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    stem = F.url_decode(F.regexp_extract("path", r"([^/]+)\.txt$", 1))
    return raw.select(stem.alias("stem"), F.decode("content", "UTF-8").alias("text"), (F.unix_micros("modificationTime") / 1e6).alias("text_mtime"))


def link_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Rows of a CSV list whose header isn't the first line: the first line that holds ``column`` names the columns."""
    lines = spark.read.text(path, wholetext=False).withColumn("n", F.monotonically_increasing_id())
    head = lines.where(F.col("value").contains(column)).orderBy("n").first()
    if head is None:
        return spark.createDataFrame([], f"`{column}` string")
    names = [c.strip().strip('"') for c in head["value"].split(",")]
    parsed = lines.where(F.col("n") > head["n"]).select(F.from_csv("value", ", ".join(f"`{c or i}` string" for i, c in enumerate(names))).alias("r")).select("r.*")
    return parsed.where(F.col(f"`{column}`").isNotNull())


def log_tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last ``n`` lines of a log with their number from the end (1 is the last)."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    last = lines.orderBy(F.desc("_at")).limit(n)
    from pyspark.sql import Window

    return last.withColumn("back", F.row_number().over(Window.orderBy(F.desc("_at")))).select("back", F.col("value").alias("line"))
