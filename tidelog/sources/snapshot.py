"""A store rendered as a folder of files, one for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import decode_segment


def scan_snapshot(spark: SparkSession, folder: str, top: str, strict: bool = True) -> DataFrame:
    """``sublevel``, ``key`` and ``value`` (the file's text) of every file under ``folder``/``top``.

    Below ``_meta`` a file's name is the key, below others it is in one more folder;
    names are written as by ``encode_segment``. With ``strict`` a path of another depth raises
    when it is read; else it is left out. A folder that is absent raises, as
    an empty snapshot would delete everything. Spark lists no files whose names begin with ``_`` or
    ``.`` (node ids and fixed names do not), so such keys cannot be scanned.
    """
    root = f"{folder.rstrip('/')}/{top}/"
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    # the path in the metadata is a URI: percent signs of the names are escaped once more
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rest = F.split(F.substring(path, F.instr(path, root) + len(root), F.length(path)), "/", -1)
    own = files.select(F.col("value"), rest.alias("_rest"))
    fits = F.size("_rest") == (1 if top == "_meta" else 2)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("not a path of a key: "), F.array_join("_rest", "/")))
        own = own.where(F.when(fits, True).otherwise(wrong.cast("boolean")))
    else:
        own = own.where(fits)
    sublevel = F.array_join(F.concat(F.array(F.lit(top)), F.slice("_rest", 1, F.size("_rest") - 1)), "/")
    return own.select(sublevel.alias("sublevel"), decode_segment(F.element_at("_rest", -1)).alias("key"), "value")
