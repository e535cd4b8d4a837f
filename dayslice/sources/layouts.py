"""What a table on disk knows about itself: its schema, how it is laid out, and which stream batches it holds.

The layout is one small JSON file beside the data, replaced by a rename. A schema in it is widened before the first wider
file is written, so a reader never meets a file that knows more than the layout; old files give NULL for newer columns.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LayoutError, SchemaDriftError
from .readers import path_exists

LAYOUT = "_layout.json"
#: Types that a Parquet reader can read as the type on the right, in order of width.
_CHAINS = (("tinyint", "smallint", "int", "bigint"), ("float", "double"))


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def read_layout(spark: SparkSession, path: str) -> dict[str, Any]:
    """The layout stored with a table."""
    if not path_exists(spark, f"{path}/{LAYOUT}"):
        raise LayoutError(f"{path} has no {LAYOUT}: create it with create_buckets or write_evolving")
    target, files = _file_system(spark, f"{path}/{LAYOUT}")
    stream = files.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_layout(spark: SparkSession, path: str, layout: dict[str, Any]) -> None:
    """Replace the layout: written under another name first, then renamed over the old one."""
    draft, files = _file_system(spark, f"{path}/{LAYOUT}.{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(layout).encode()))
    stream.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LAYOUT}")
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark._sc._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(draft, target, over)


def wider(old: T.DataType, new: T.DataType) -> T.DataType | None:
    """The one of two types that holds the values of both, if a reader can turn files of the other into it."""
    if old == new:
        return old
    names = (old.simpleString(), new.simpleString())
    for chain in _CHAINS:
        if all(n in chain for n in names):
            return max((old, new), key=lambda t: chain.index(t.simpleString()))
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        low, high = sorted((old, new), key=lambda t: (t.scale, t.precision))
        return high if high.precision - high.scale >= low.precision - low.scale else None
    if isinstance(old, T.NullType) or isinstance(new, T.NullType):
        return new if isinstance(old, T.NullType) else old
    return None


def evolve(old: T.StructType, new: T.StructType) -> T.StructType:
    """The old schema with the new columns behind it; shared columns take the wider type, all may be NULL.

    Types of which neither holds the other (a number that became text, a decimal with fewer digits before its point) are refused.
    """
    fields = []
    for field in old:
        kind = wider(field.dataType, new[field.name].dataType) if field.name in new.names else field.dataType
        if kind is None:
            raise SchemaDriftError(f"{field.name} is {field.dataType.simpleString()}, and {new[field.name].dataType.simpleString()} neither holds it nor fits it")
        fields.append(T.StructField(field.name, kind))
    return T.StructType([*fields, *(T.StructField(f.name, f.dataType) for f in new if f.name not in old.names)])


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with exactly the columns of a schema, missing ones as NULL."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def schema_of(layout: dict[str, Any]) -> T.StructType | None:
    """The schema in a layout; None in one that was written before schemas were kept."""
    return T.StructType.fromJson(layout["schema"]) if "schema" in layout else None
