"""A saved relation: a folder with Parquet data and one-row manifests.

A manifest names the format, its version, the number of stored rows, the schema and the
folder with the data, so a reader can refuse a folder before it reads any data. Saving over
a relation writes new data and then a new manifest; the last manifest counts, so that a
writer that fails leaves what was there, and readers never see data without its manifest.
What it replaced stays for those who are reading it, until ``clean_relation`` is called.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..engine import Engine
from ..errors import InvalidFormat, TooLarge, UnsupportedVersion
from ..functions import check_types

FORMAT, VERSION = "deltaloom-relation", 2


def save_relation(engine: Engine, df: DataFrame, path: str) -> int:
    """Write the rows into a folder of their own, then a manifest that names it."""
    check_types(df.schema)
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{(data := f'data-{uuid.uuid4().hex}')}")
    rows = seen.get["n"]
    manifest = json.dumps({"format": FORMAT, "version": VERSION, "rows": rows, "schema": df.schema.jsonValue(), "data": data, "saved": time.time_ns()})
    engine.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("append").text(f"{path}/manifest")
    return rows


def clean_relation(engine: Engine, path: str) -> None:
    """Delete data that a saved relation no longer names; nobody may be reading or saving it."""
    _, head = _manifest(engine, path)
    at = engine.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(engine.spark.sparkContext._jsc.hadoopConfiguration())
    for entry in store.listStatus(at):
        name = entry.getPath().getName()
        if name.startswith("data-") and name != head.get("data"):
            store.delete(entry.getPath(), True)


def _manifest(engine: Engine, path: str) -> tuple[bool, dict]:
    """Whether the last manifest has this format, and what it says."""
    try:
        lines = engine.spark.read.text(f"{path}/manifest").collect()
        head = max((json.loads(r.value) for r in lines), key=lambda h: h.get("saved", 0))
        return head["format"] == FORMAT, head
    except (AnalysisException, AttributeError, ValueError, KeyError, TypeError) as e:
        raise InvalidFormat(path) from e


def load_relation(engine: Engine, path: str, limit: int | None = None, schema: StructType | None = None) -> DataFrame:
    """The rows of a saved relation, not yet de-duplicated.

    Checks, in this order: the expected schema's types, the format, the version, then the
    stored row count against ``limit``. No rows pass any limit.
    """
    if schema is not None:
        check_types(schema)
    good, head = _manifest(engine, path)
    if not good:
        raise InvalidFormat(path)
    if head.get("version") != VERSION:
        raise UnsupportedVersion(str(head.get("version")))
    try:
        rows, stored, data = int(head["rows"]), StructType.fromJson(head["schema"]), str(head["data"])
    except (KeyError, TypeError, ValueError) as e:
        raise InvalidFormat(path) from e
    check_types(stored)
    if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in stored]:
        raise InvalidFormat(f"{path}: stored as {stored.simpleString()}")
    if not rows:
        return engine.spark.createDataFrame([], stored)
    if limit is not None and rows > limit:
        raise TooLarge(f"{rows} rows, {limit} allowed")
    return engine.spark.read.schema(stored).parquet(f"{path}/{data}")
