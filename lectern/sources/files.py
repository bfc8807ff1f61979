"""Uploaded files: whole binary contents, and the reasons why some aren't read."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the first bytes of a PDF.
PDF = b"%PDF-"
MAX_BYTES = 200 * 1024 * 1024


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> tuple[DataFrame, DataFrame]:
    """(path, content) of the files that can be read, and (path, error) of the others: FILE_EMPTY, FILE_TOO_LARGE (over 200 MB), UNSUPPORTED_FILE_TYPE.

    Lengths are judged before contents are read. Files of other names are passed over by the listing. Scans leave empty files out, so
    those are what the listing, which the driver holds for any scan, has beyond the scan's paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    listed = spark.createDataFrame([(unquote(x),) for x in files.inputFiles()], "path string")
    key = lambda path: F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")  # noqa: E731  file:///x and file:/x are one path
    scanned = files.select(key(F.col("path")).alias("__key"))
    empty = listed.join(scanned, key(F.col("path")) == F.col("__key"), "left_anti").select("path", F.lit("FILE_EMPTY").alias("error"))
    large = files.where(F.col("length") > MAX_BYTES).select("path", F.lit("FILE_TOO_LARGE").alias("error"))
    sized = files.where(F.col("length") <= MAX_BYTES)
    typed = F.substring("content", 1, len(PDF)) == F.lit(PDF)
    other = sized.where(~typed).select("path", F.lit("UNSUPPORTED_FILE_TYPE").alias("error"))
    return sized.where(typed).select("path", "content"), empty.unionByName(large).unionByName(other)
