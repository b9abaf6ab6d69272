"""Typed tables as node tables.

A node table has one row for every value of every record::

    record_id, path, depth, type, value, num

``path`` is a wildcard path (``$[*].a.b[*]``), ``type`` one of TYPES, ``value`` the canonical text of a
scalar (null for containers) and ``num`` its number. The walk over the schema happens once, when the plan
is made: each record becomes one array expression that is exploded in place, so nothing is shuffled or
read twice, and unused columns are pruned from the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: JSON types in their fixed order; ties between types go to the later one.
TYPES = ("null", "boolean", "integer", "float", "string", "array", "object")
SCALARS = TYPES[:5]
NODE = "struct<path:string,depth:int,type:string,value:string,num:double>"

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _node(path: Column, depth: int, kind: Column, value: Column, num: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(depth).alias("depth"), kind.alias("type"), value.cast("string").alias("value"), num.cast("double").alias("num")).cast(NODE)


def json_type_of(data_type: T.DataType) -> str:
    """The JSON type that values of a Spark type have."""
    if isinstance(data_type, _WHOLE):
        return "integer"
    if isinstance(data_type, _REAL):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, (T.StructType, T.MapType)):
        return "object"
    return "null" if isinstance(data_type, T.NullType) else "string"


def text_of(value: Column, data_type: T.DataType) -> Column:
    """Canonical text of a scalar; times in ISO form."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if isinstance(data_type, T.BinaryType):
        return F.base64(value)
    return value.cast("string")


def _walk(value: Column, data_type: T.DataType, path: Column, depth: int) -> Column:
    name = json_type_of(data_type)
    kind = F.when(value.isNull(), F.lit("null")).otherwise(F.lit(name))
    nothing = F.lit(None).cast("string")
    if name in ("array", "object"):
        own = F.array(_node(path, depth, kind, F.when(value.isNull(), F.lit("null")), nothing))
        empty = F.array().cast(f"array<{NODE}>")
        if isinstance(data_type, T.StructType):
            below = [_walk(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), depth + 1) for f in data_type.fields]
            inner = F.concat(*below) if below else empty
        elif isinstance(data_type, T.ArrayType):
            inner = F.flatten(F.transform(value, lambda x: _walk(x, data_type.elementType, F.concat(path, F.lit("[*]")), depth + 1)))
        else:
            inner = F.flatten(F.transform(F.map_entries(value), lambda e: _walk(e["value"], data_type.valueType, F.concat(path, F.lit("."), e["key"].cast("string")), depth + 1)))
        return F.when(value.isNull(), own).otherwise(F.concat(own, inner))
    num = value if name in ("integer", "float") else nothing
    return F.array(_node(path, depth, kind, F.coalesce(text_of(value, data_type), F.lit("null")), num))


def table_nodes(table: DataFrame, columns: list[str] | None = None, record_id: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Nodes of a table's rows, as the records of one array document.

    ``record_id`` names a record (null by default); ``keep`` lists columns that are carried along.
    The array itself is not a row of the result; :func:`with_root` adds it to a list of paths.
    """
    fields = [f for f in table.schema.fields if columns is None or f.name in columns]
    root = _node(F.lit("$[*]"), 1, F.lit("object"), F.lit(None), F.lit(None))
    below = [_walk(F.col(f"`{f.name}`"), f.dataType, F.lit(f"$[*].{f.name}"), 2) for f in fields]
    record = record_id if record_id is not None else F.lit(None).cast("long")
    every = table.select(record.alias("record_id"), *[F.col(f"`{c}`") for c in keep or []], F.explode(F.concat(F.array(root), *below)).alias("n"))
    return every.select("record_id", *[F.col(f"`{c}`") for c in keep or []], "n.*")


def scalars(nodes: DataFrame) -> DataFrame:
    """The nodes that hold a scalar; nulls count, as the value ``null``."""
    return nodes.where(F.col("type").isin(*SCALARS) & F.col("value").isNotNull())
