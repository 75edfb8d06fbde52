"""Sharding by fixed virtual slots.

A record's key is hashed into one of SLOTS slots for good. A small versioned map says which shard has each slot;
rebalancing edits the map, never the hash. Bytes and rows are aggregated per slot and stored beside the map, so an
edit can weigh slots by what they hold (``rebalanced``); under the law ``key`` only the number of shards may decide, so
there slots weigh the same (``add_shard``). All of it is DataFrame work; the map has SLOTS rows at any size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import release, tables_made, written

SLOTS = 4096
#: Rows of a slot are numbered by so many parts, one after the other.
PARTS = 8
#: Bytes that a record takes beside its text.
OVERHEAD = 8


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """By the first 32 bits of the MD5 of the key's text; a null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map: (version, vslot, shard), slots dealt round."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def slot_sizes(records: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) of records that carry ``vslot`` and ``size``."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def add_shard(slot_map: DataFrame, new_shard: int, weights: DataFrame | None = None) -> DataFrame:
    """The map's next version: every shard gives its last slots to the new one until it holds an equal share.

    Slots weigh the same, or by ``weights(vslot, bytes)``; the new shard takes slots, no other does."""
    weighed = slot_map.withColumn("w", F.lit(1)) if weights is None else slot_map.join(weights.select("vslot", F.col("bytes").alias("w")), "vslot", "left").fillna(0, ["w"])
    own = Window.partitionBy("shard")
    upto = F.sum("w").over(own.orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0))
    share = F.sum("w").over(own) * new_shard / (new_shard + 1)
    return weighed.select((F.col("version") + 1).alias("version"), "vslot", F.when(upto > share, F.lit(new_shard)).otherwise(F.col("shard")).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The map's next version, by the bytes that slots hold: shards above their even share by more than ``tolerance``
    give up their last slots beyond it, which go to the shards with the most room, the largest slot first."""
    weighed = slot_map.join(sizes.select("vslot", "bytes"), "vslot", "left").fillna(0, ["bytes"])
    own = Window.partitionBy("shard")
    upto = F.sum("bytes").over(own.orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0))
    rows = weighed.withColumn("upto", upto).collect()  # SLOTS rows
    shards = sorted({r.shard for r in rows})
    even = sum(r.bytes for r in rows) / max(1, len(shards))
    held = dict.fromkeys(shards, 0)
    moved, placed = [], {}
    for r in rows:
        if r.upto > even * (1 + tolerance) and r.bytes:
            moved.append(r)
        else:
            placed[r.vslot] = r.shard
            held[r.shard] += r.bytes
    for r in sorted(moved, key=lambda r: (-r.bytes, r.vslot)):
        shard = min(shards, key=lambda s: (held[s], s))
        placed[r.vslot] = shard
        held[shard] += r.bytes
    version = rows[0].version + 1 if rows else 1
    return slot_map.sparkSession.createDataFrame([(version, v, s) for v, s in sorted(placed.items())], "version int, vslot int, shard int")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Stores a version of the map beside the others."""
    slot_map.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int, version int").parquet(path).where(F.col("version") == version).select("version", "vslot", "shard")


def save_sizes(sizes: DataFrame, path: str) -> DataFrame:
    """Stores what each slot holds, and reads it back."""
    sizes.coalesce(1).write.mode("overwrite").parquet(path)
    return sizes.sparkSession.read.schema(sizes.schema).parquet(path)


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot) of each row; a null text has no bytes."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(id_col, (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), virtual_slot(F.col(id_col), slots).alias("vslot"))


def shard_rows(df: DataFrame, maps: tuple[DataFrame, DataFrame], id_col: str = "doc_id", text_col: str = "text", sizes_path: str | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, law ("key"), shard, slot, grown_shard, vslot, slot_bytes.

    ``maps`` are the present map and the one with one more shard. ``slot`` numbers the rows of a shard from 0
    without gaps, in the order of virtual slot, checksum part, id (null first), checksum and size. ``slot_bytes`` is
    what the virtual slot holds, stored under ``sizes_path`` where one is given. Null ids are one key; null texts are
    empty; long texts count whole; extra columns are left behind; an empty table gives an empty one.

    Rows that are equal in all of this are one row with a count until they have their numbers. The order is dealt
    out by ranges, so no slot, part or id is left to one task. Only ids and sizes are shuffled, never texts."""
    standing = tables_made()
    rows = measured(df, id_col, text_col).withColumn("part", F.pmod("text_crc32", F.lit(PARTS)).cast("int"))
    equal = written(rows.groupBy("vslot", "part", id_col, "text_crc32", "size").agg(F.count("*").alias("n")), "sharded")
    sizes = equal.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    sizes = written(sizes, "slot-sizes") if sizes_path is None else save_sizes(sizes, sizes_path)
    now, grown = maps[0].select("vslot", "shard"), maps[1].select("vslot", F.col("shard").alias("grown_shard"))
    slots = now.join(grown, "vslot").join(sizes.select("vslot", F.col("bytes").alias("slot_bytes")), "vslot")  # at most SLOTS rows
    placed = equal.join(F.broadcast(slots), "vslot")
    order = ["vslot", "part", F.asc_nulls_first(id_col), "text_crc32", "size"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(placed.repartitionByRange(parts, "shard", *order).withColumn("range", F.spark_partition_id()), "sharded-ranges")
    release(df.sparkSession, standing, ranged)
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = ranged.groupBy("shard", "range").agg(F.sum("n").alias("cell")).withColumn("begin", F.coalesce(F.sum("cell").over(before), F.lit(0))).drop("cell")  # ranges and shards
    within = Window.partitionBy("shard", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("begin") + F.coalesce(F.col("place"), F.lit(0))
    numbered = ranged.withColumn("place", F.sum("n").over(within)).join(F.broadcast(cells), ["shard", "range"])
    each = numbered.withColumn("slot", F.explode(F.sequence(begin, begin + F.col("n") - 1)))
    return each.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard", "vslot", "slot_bytes")


#: The same in SQL: CRC-32 from its table, which a recursive query makes, over the bytes of the text.
SQL = f"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), sums AS (
  SELECT doc_id, n + {OVERHEAD} AS size,
    xor(list_reduce(list_transform(range(n), lambda i: (strpos('123456789ABCDEF', h[2 * i + 1]) * 16 + strpos('123456789ABCDEF', h[2 * i + 2]))::BIGINT),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS})::INTEGER AS vslot
  FROM bytes, crc_table
), map AS (
  SELECT range::INTEGER AS vslot, (range % 24)::INTEGER AS shard FROM range({SLOTS})
), grown AS (
  SELECT vslot, CASE WHEN count(*) OVER (PARTITION BY shard ORDER BY vslot) > count(*) OVER (PARTITION BY shard) * 24 / 25.0 THEN 24 ELSE shard END::INTEGER AS grown_shard FROM map
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY vslot, text_crc32 % {PARTS}, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot,
  grown_shard, vslot, sum(size) OVER (PARTITION BY vslot)::BIGINT AS slot_bytes
FROM sums JOIN map USING (vslot) JOIN grown USING (vslot)
"""
