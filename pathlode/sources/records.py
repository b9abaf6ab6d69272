"""Records of JSON texts, and fields of records.

Texts are parsed once into variants and stay in the JVM. A selector is ``$.a.b[2]`` or ``a.b``; a step that
is not there gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.operators.temporal import parse_time

#: Selectors tried for a logical field, in order.
AUTHOR = ("$.author", "$.author_name")
MESSAGE = ("$.message", "$.subject", "$.title")
#: Parts of the names of time fields.
TIME_HINTS = ("date", "time", "timestamp", "created", "updated", "created_at", "updated_at", "datetime")
#: Numbers in this range are seconds since 1970 (years 2000 to 2100).
SECONDS_RANGE = (946684800, 4102444800)
#: Records looked at when a field is resolved.
SAMPLE = 64


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _objects(v: Column) -> Column:
    return F.filter(_list(v), lambda x: _object(x).isNotNull())


def extract_records(texts: DataFrame, document: str, body: str) -> DataFrame:
    """document, pos, record (a variant) of JSON texts, without a shuffle.

    The records of an array are its objects. Those of an object are the objects of its first child, by name,
    that is an array with an object in it; without such a child it is one record itself. Scalars, null and
    what is not JSON have none.
    """
    v = F.col("v")
    children = F.transform(F.array_sort(F.map_keys(_object(v))), lambda k: _objects(F.element_at(_object(v), k)))
    nested = F.get(F.filter(children, lambda c: F.size(c) > 0), F.lit(0))
    found = F.when(_list(v).isNotNull(), _objects(v)).when(_object(v).isNotNull(), F.coalesce(nested, F.array(v)))
    parsed = texts.select(F.col(document).alias("d"), F.try_parse_json(F.col(body)).alias("v"))
    return parsed.select("d", F.posexplode(found).alias("pos", "record")).withColumnRenamed("d", document)


def _steps(selector: str, indexes: bool) -> str | None:
    """The selector as a path of the variant functions; null for an index that is no number."""
    plain = selector.removeprefix("$.") if selector.startswith("$.") else selector.removeprefix("$")
    out = "$"
    for step in filter(None, plain.split(".")):
        name, bracket, index = step.partition("[") if indexes else (step, "", "")
        if name:
            out += f'["{name}"]' if "'" in name else f"['{name}']"
        if bracket:
            if not index[:-1].isdecimal():
                return None
            out += f"[{int(index[:-1])}]"
    return out


def select_field(record: Column, selector: str) -> Column:
    """The value at ``$.a.b[2]`` as a variant, containers too."""
    path = _steps(selector, True)
    return F.lit(None).cast("variant") if path is None else F.try_variant_get(record, path, "variant")


def field_text(record: Column, selector: str, containers: bool = True) -> Column:
    """The text at a dotted selector: scalars as they are, containers as JSON text, or null for them without ``containers``."""
    value = F.try_variant_get(record, _steps(selector, False), "variant")
    text = F.try_variant_get(value, "$", "string")
    return text if containers else F.when(_list(value).isNull() & _object(value).isNull(), text)


def resolve_field(records: DataFrame, record: str, candidates: tuple[str, ...], sample: int | None = SAMPLE) -> str:
    """The first candidate that every one of the first ``sample`` records (None: all) has as a scalar, else the first of all.

    One row of counts comes to the driver.
    """
    head = records if sample is None else records.limit(sample)
    counts = head.agg(F.count("*"), *[F.count(field_text(F.col(record), c, containers=False)) for c in candidates]).first()
    full = [c for c, n in zip(candidates, counts[1:], strict=True) if n == counts[0] > 0]
    return (full or candidates)[0]


def to_epoch(value: Column) -> Column:
    """Seconds since 1970 of a variant: ISO dates and date-times in strings, numbers of the years 2000 to 2100."""
    kind, text = F.schema_of_variant(value), F.trim(F.try_variant_get(value, "$", "string"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(T.*)?$"), F.unix_seconds(parse_time(text)))
    number = F.try_variant_get(value, "$", "double").try_cast("long")
    return F.when(kind == "STRING", iso).when((kind != "BOOLEAN") & number.between(*SECONDS_RANGE), number)


def time_field(records: DataFrame, record: str) -> str | None:
    """``$.name`` of the first field, by name, of the first record whose name speaks of time and whose value is one."""
    fields = _object(F.col(record))
    keys = F.array_sort(F.map_keys(fields))
    named = F.filter(keys, lambda k: F.lower(k).rlike("|".join(TIME_HINTS)) & to_epoch(F.element_at(fields, k)).isNotNull())
    found = records.limit(1).select(F.get(named, F.lit(0)).alias("k")).first()
    return None if found is None or found.k is None else f"$.{found.k}"
