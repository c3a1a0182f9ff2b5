"""Rows that share an id but not a text, and bit maps that keep most rows out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.functions.skew import BROADCAST_ROWS, broadcast_if
from skuloom.session import fresh_path, materialize

#: 16 MB as a bit map, whatever the number of ids.
FILTER_BITS, FILTER_ROW = 1 << 27, 1 << 15
#: Ids from here on are made up.
MADE_UP = 1 << 62


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str, DataFrame | None]:
    """``docs`` with a bigint column that is its id, but for rows whose id also stands by another text: those get one of their own.

    Made-up ids are hashes of id and text beyond all others. Returned with the column's name and, where there are any, the
    (made, id) of the made-up ones. Rows without id stay without.
    """
    name = free_name(docs, "__own")
    id_, h = F.col(key).cast("bigint"), F.xxhash64(text, F.col(text).isNull())
    held = docs.select(id_.alias("id"), h.alias("h")).where("id is not null").groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    mixed = materialize(held.where("a <> b").select("id"), fresh_path(docs.sparkSession, "mixed_ids"))
    n = mixed.count()
    if not n:
        return docs.withColumn(name, id_), name, None
    mark = free_name(docs, "__mixed")
    marked = docs.join(broadcast_if(n <= BROADCAST_ROWS)(mixed.withColumnRenamed("id", mark)), id_ == F.col(mark), "left")
    made = F.xxhash64(id_, F.col(text), F.col(text).isNull()).bitwiseAND(F.lit(MADE_UP - 1)) + F.lit(MADE_UP)
    out = marked.withColumn(name, F.when(F.col(mark).isNotNull(), made).otherwise(id_))
    return out.drop(mark), name, out.where(F.col(mark).isNotNull()).select(F.col(name).alias("made"), F.col(mark).alias("id")).distinct()


def flagged(rows: DataFrame, key: str, ids: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a boolean column: false if the row's key is surely not among ``ids`` (a column ``id`` of the same type)."""

    def spot(of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(bits))

    def row(h: Column) -> Column:
        return F.floor(h / F.lit(FILTER_ROW)).cast("int")

    bit = F.pmod(spot("id"), F.lit(FILTER_ROW))
    at, map_ = free_name(rows, "__at"), free_name(rows, "__map")
    maps = ids.select(row(spot("id")).alias(at), bit.alias("__bit")).groupBy(at).agg(F.bitmap_construct_agg("__bit").alias(map_))
    maps = materialize(maps, fresh_path(rows.sparkSession, "filter"))
    place = F.pmod(spot(key), F.lit(FILTER_ROW))
    byte = F.conv(F.hex(F.substring(map_, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    near = rows.withColumn(name, row(spot(key))).join(F.broadcast(maps), F.col(name) == F.col(at), "left")
    found = F.col(map_).isNotNull() & (F.getbit(byte, (place % 8).cast("int")) == 1)
    return near.withColumn(name, F.coalesce(found, F.lit(False))).drop(at, map_)


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (column ``id``) of the wanted ids; the bit map lets few others through to the join, which decides."""
    near = flagged(rows, "id", ids, "__near")
    # The join goes by a column made from the flag: else the optimizer would move it below the bit map and shuffle all rows.
    near = near.withColumn("__near", F.when(F.col("__near"), F.col("id"))).where("__near is not null")
    return near.join(ids.withColumnRenamed("id", "__near"), "__near", "left_semi").drop("__near")


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose bigint key is none of the ids; rows that the bit map keeps away from the join stay where they are."""
    near, gone = free_name(rows, "__near"), free_name(rows, "__gone")
    # 64 bits an id as long as the map stays within its bound: few ids need no map of 16 MB on every executor.
    bits = min(FILTER_BITS, max(FILTER_ROW, 1 << (64 * ids.count()).bit_length()))
    marked = flagged(rows, key, ids, near, bits)
    marked = marked.withColumn(near, F.when(F.col(near), F.col(key)))
    few = marked.where(F.col(near).isNotNull()).join(ids.withColumnRenamed("id", gone), F.col(near) == F.col(gone), "left_anti")
    return marked.where(F.col(near).isNull()).unionAll(few).drop(near)
