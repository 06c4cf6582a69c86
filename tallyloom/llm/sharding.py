"""Sharding by fixed virtual slots.

Rows are hashed by id into a fixed number of virtual slots. Only the bytes of
each slot are gathered, and slots are dealt to shards: the largest first, always
to the shard with the least bytes. A slot that outweighs ``PARTS``-th of a
shard's share, as one that a very common id fills, is cut into parts that are dealt
out one by one, so sizes stay even whatever the ids. The map of slots to
shards is a small table; it is stored with its version, loaded again, and edited
by making the next version: ``grow`` adds a shard and moves slots to it only,
``rebalance`` moves what overfull shards have too much. Rows never change their
slot or part. A row's place in its shard is its place in its part plus what the
parts before it hold, so no task ever sorts a whole shard or a hot id.

All of it is DataFrame operations; the map has one row for each part of a slot, at
most ``slots + PARTS * shards`` at every size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.llm.common import shared_folder, written

SLOTS = 4096
SHARDS = 16
#: Parts of a shard's share that a slot may weigh before it is cut.
PARTS = 64


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a row; a null key has one too."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """``(vslot, part, bytes, rows)`` of rows with ``vslot``, ``part`` and ``size``."""
    return rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def split_slots(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` with the ``part`` of their slot: slots over a ``PARTS``-th of a shard's share are cut by a hash of the row's number ``nth``."""
    sizes = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    share = sizes.agg((F.sum("bytes") / (shards * PARTS)).alias("share"))  # one row
    parts = sizes.join(F.broadcast(share)).select("vslot", F.greatest(F.ceil(F.col("bytes") / F.col("share")), F.lit(1)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("nth"), F.col("parts")).cast("int")
    return rows.join(F.broadcast(parts), "vslot").withColumn("part", part).drop("parts")


def _deal(listed: Column, loads: Column) -> Column:
    """Fold parts of slots, in the order given, onto the shard with the least bytes so far: array of (vslot, part, shard)."""
    def step(state: Column, slot: Column) -> Column:
        shard = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == shard, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["placed"], F.array(F.struct(slot["vslot"].alias("vslot"), slot["part"].alias("part"), shard.alias("shard")))).alias("placed"),
        )

    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,part:int,shard:int>>").alias("placed"))
    return F.aggregate(listed, start, step)["placed"]


def _largest_first() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "vslot", "part", "bytes")))
    return F.transform(ordered, lambda s: F.struct(s["vslot"].alias("vslot"), s["part"].alias("part"), s["bytes"].alias("bytes")))


def new_map(sizes: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: ``(version, vslot, part, shard)`` for every slot, empty ones included."""
    spark = sizes.sparkSession
    all_slots = spark.range(slots).select(F.col("id").cast("int").alias("vslot")).join(F.broadcast(sizes), "vslot", "left")
    filled = all_slots.select("vslot", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    placed = filled.agg(_largest_first().alias("s")).select(F.explode(_deal(F.col("s"), F.array_repeat(F.lit(0).cast("long"), shards))).alias("p"))
    return placed.select(F.lit(1).alias("version"), "p.vslot", "p.part", "p.shard")


def _weighed(slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    return slot_map.join(F.broadcast(sizes.select("vslot", "part", "bytes")), ["vslot", "part"], "left").fillna(0, ["bytes"])


def _excess(full: DataFrame, shards: int) -> DataFrame:
    """``given``: whether a part is among the smallest ones of its shard that together stay within its excess over the mean."""
    held = W.partitionBy("shard")
    mean = F.sum("bytes").over(W.partitionBy("version")) / shards
    first = F.sum("bytes").over(held.orderBy("bytes", "vslot", "part").rowsBetween(W.unboundedPreceding, 0))
    return full.withColumns({"excess": F.sum("bytes").over(held) - mean, "first": first}).select(
        "version", "vslot", "part", "shard", "bytes", ((F.col("first") <= F.col("excess")) & (F.col("bytes") > 0)).alias("given")
    )


def grow(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version for one more shard than ``shards``: slots move to the new shard only, and only until it has its share.

    Each old shard gives up its smallest slots while what it has given stays
    within its excess over the new mean.
    """
    marked = _excess(_weighed(slot_map, sizes), shards + 1)
    return marked.select((F.col("version") + 1).alias("version"), "vslot", "part", F.when(F.col("given"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version after sizes have changed: only overfull shards give slots, to those with the least bytes.

    Slots and parts that the map does not know yet, as rows have come since, are dealt out with them.
    """
    marked = _excess(_weighed(slot_map, sizes), shards)
    version = slot_map.agg((F.max("version") + 1).alias("version"))  # one row
    stay = marked.filter(~F.col("given")).select("vslot", "part", "shard", "bytes")
    new = sizes.join(F.broadcast(slot_map.select("vslot", "part")), ["vslot", "part"], "left_anti")
    move = marked.filter("given").select("vslot", "part", "bytes").unionByName(new.select("vslot", "part", "bytes"))
    loads = stay.groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("m"))  # one row
    start = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)).cast("long"))
    dealt = move.agg(_largest_first().alias("s")).join(F.broadcast(loads)).select(F.explode(_deal(F.col("s"), start)).alias("p")).select("p.*")
    return stay.select("vslot", "part", "shard").union(dealt).join(F.broadcast(version)).select("version", "vslot", "part", "shard")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Keep a version of the map under ``path``; a version that is there already is not replaced."""
    number = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={number}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest if none is named."""
    stored = spark.read.schema("vslot int, part int, shard int, version int").parquet(path)
    wanted = stored.agg(F.max("version")).first()[0] if version is None else version
    return stored.filter(F.col("version") == wanted).select("version", "vslot", "part", "shard")


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """``(id, size, text_crc32, vslot, part)`` of every row, written: numbers of rows are given once."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        slot_of(F.col(id_col), slots).alias("vslot"), F.monotonically_increasing_id().alias("nth"),
    )
    return written(split_slots(written(rows, "slotted"), shards).drop("nth"), "parted")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """``(id, size, text_crc32, shard, slot, vslot, part, map_version, next_shard)`` for every row.

    ``size``: UTF-8 bytes of the text plus 1; a null text has none. ``shard`` is by
    version 1 of the map, ``next_shard`` by version 2 for one more shard; both are
    stored under ``map_path``, a new folder of the shared one if none is named. ``slot``
    numbers the rows of a shard from 0 without gaps. Null ids share one slot, and
    repeated rows share theirs until it is cut. A table without rows gives none;
    a long text counts with all its bytes, and one that outweighs a shard's share
    makes its shard larger than others. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    map_path = map_path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = slotted(docs, id_col, text_col, slots, shards)
    sizes = written(slot_sizes(rows), "slot-sizes")
    store_map(new_map(sizes, slots, shards), map_path)
    first = load_map(spark, map_path, 1)
    store_map(grow(first, sizes, shards), map_path)
    second = load_map(spark, map_path, 2)
    key = ["vslot", "part"]
    base = first.join(F.broadcast(sizes), key).withColumn(
        "base", F.sum("rows").over(W.partitionBy("shard").orderBy(*key).rowsBetween(W.unboundedPreceding, -1))
    )
    places = base.join(F.broadcast(second.select(*key, F.col("shard").alias("next_shard"))), key).select(
        *key, "shard", "next_shard", F.col("version").alias("map_version"), F.coalesce("base", F.lit(0)).alias("base")
    )
    within = F.row_number().over(W.partitionBy(*key).orderBy("id", "size", "text_crc32")) - 1
    return rows.withColumn("within", within).join(F.broadcast(places), key).select(
        "id", "size", "text_crc32", "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"), *key, "map_version", "next_shard"
    )
