"""Older run plans, which keep settings and metrics as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """VARIANT of a JSON text; null where it is none."""
    return F.try_parse_json(text)


def entry(value: Column, name: str, kind: str) -> Column:
    """An entry of a JSON object, by itself or as the ``value`` of an object of its own; null if it is missing or of no use as ``kind``."""
    plain = F.try_variant_get(value, f"$.{name}", kind)
    return F.coalesce(plain, F.try_variant_get(value, f"$.{name}.value", kind))


def _read(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the VARIANT of their text and ``reason``, why it is rejected."""
    value = F.col("__value")
    given = rows.withColumn("__value", parsed(F.col(text)))
    object_ = F.schema_of_variant(value).startswith("OBJECT")
    return given.withColumn("reason", F.when(F.col(text).isNull(), None).when(value.isNull(), "no JSON").when(~object_, "no object"))


def _entries(names: list[str], kind: str, inside: str) -> Column:
    value = F.col("__value")
    nested = F.try_variant_get(value, f"$.{inside}", "variant")
    pairs = [F.struct(F.lit(n).alias("key"), F.coalesce(entry(value, n, kind), entry(nested, n, kind)).alias("value")) for n in names]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def judged(rows: DataFrame, text: str, names: list[str], kind: str = "double", out: str = "metrics", inside: str = "metrics") -> DataFrame:
    """All rows of :func:`decoded`, good and rejected, in one pass over the texts: ``reason`` is null for the good ones."""
    return _read(rows, text).withColumn(out, _entries(names, kind, inside)).drop("__value")


def decoded(rows: DataFrame, text: str, names: list[str], kind: str = "double", out: str = "metrics", inside: str = "metrics") -> tuple[DataFrame, DataFrame]:
    """(rows with the named entries as a map, rejected rows with ``reason``); each of the two reads the texts, see :func:`judged`.

    The entries stand in the object itself or in one called ``inside``. Entries that are missing or cannot be read are left out of the map.
    Text that is no JSON object goes to the rejects as it was; a null text has an empty map.
    """
    given = _read(rows, text)
    good = given.where("reason is null").withColumn(out, _entries(names, kind, inside)).drop("__value", "reason")
    return good, given.where("reason is not null").drop("__value")
