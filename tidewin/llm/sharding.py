"""Sharding by fixed virtual slots, with a stored, versioned slot-to-shard map.

A record's virtual slot is a hash of its key and text modulo a fixed number of slots (thousands, whatever the
number of shards). Bytes are summed by slot, and only the slots, never the rows, are dealt to shards: version 1 of
the map deals them from the heaviest down, each to the lightest shard so far. Maps are kept in a folder, one table
for each version, and later versions are edits: where loads or the number of shards have changed, slots stay where
they are but for those that a shard holds above its share, which go to the lightest shards (`edited`), or, to grow by
a shard under any loads, slots move to the new shard alone (`grow`). `place` puts rows by a stored map. A map has one row for each slot, so its size is bounded by the number of slots at
any data size, and it is the only side that is broadcast.

Defined cases: a null text has no bytes (size 1) and the CRC of the empty string; a null key takes part in the hash
as null, so rows without a key, or with one and the same, are spread by their texts; rows that are equal in key
and text share a slot, and get positions in any order, so shards are equal only to about the bytes of the fullest slot,
however many equal rows that holds; a text of any length is one row of its slot; an empty table gives an empty result and a map that deals
empty slots in turn; columns other than the key and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import shared_dir, with_ids

SLOTS = 8192
SHARDS = 8


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """52 bits of the MD5 of key and text, modulo the slots: a hash that other systems compute alike."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), text).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and virtual slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return with_ids(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id"), text, slots).alias("virtual_slot"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones too: exactly `slots` rows."""
    loads = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(loads), "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


#: A shard's state is (bytes, slots, shard), so array_min names the lightest one.
_NOTHING = "transform(sequence(0, {last}), k -> named_struct('bytes', 0L, 'slots', 0, 'shard', k))"


def _dealt(slots: DataFrame, state: DataFrame) -> DataFrame:
    """virtual_slot, shard, bytes and rows: the slots from the heaviest down, each to the lightest shard (ties: fewer slots,
    lower shard). `state` is one row of what the shards hold before, `slots` at most a map's rows."""
    ordered = slots.agg(F.reverse(F.sort_array(F.collect_list(F.struct("bytes", F.expr("-virtual_slot").alias("minus"), "rows")))).alias("s"))
    dealt = ordered.crossJoin(F.broadcast(state)).selectExpr(
        """aggregate(s, named_struct('state', state, 'to', cast(array() as array<int>)),
            (acc, x) -> named_struct(
                'state', transform(acc.state, (v, k) -> if(k = array_min(acc.state).shard, named_struct('bytes', v.bytes + x.bytes, 'slots', v.slots + 1, 'shard', k), v)),
                'to', array_append(acc.to, array_min(acc.state).shard))).to as to""",
        "s",
    )
    pairs = dealt.select(F.explode(F.arrays_zip("s", "to")).alias("z"))
    return pairs.select((-F.col("z.s.minus")).cast("int").alias("virtual_slot"), F.col("z.to").alias("shard"), F.col("z.s.bytes").alias("bytes"), F.col("z.s.rows").alias("rows"))


def first_map(loads: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """A map from nothing."""
    nothing = loads.sparkSession.range(1).selectExpr(f"{_NOTHING.format(last=shards - 1)} as state")
    return _dealt(loads, nothing).withColumn("version", F.lit(version))


def _before(*by: str) -> Column:
    """The bytes of the slots that stand before this one in the order of a hash, in the same group."""
    order = Window.partitionBy(*by).orderBy(F.md5(F.col("virtual_slot").cast("string")), "virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("bytes").over(order), F.lit(0))


def edited(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version for these loads and this number of shards: of a shard that holds more than its share, slots in the
    order of a hash go while it still holds its share without them, and a shard that is no more gives all. What goes is
    dealt as in a first map, on top of what stays."""
    version = slot_map.select((F.col("version") + 1).alias("version")).limit(1)
    rows = loads.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)  # over the map's rows
    above = F.sum("bytes").over(Window.partitionBy("shard")) - share
    goes = (F.col("shard") >= shards) | (F.col("bytes") > 0) & (_before("shard") + F.col("bytes") <= above)
    rows = rows.withColumn("goes", goes)
    held = rows.where("not goes").groupBy(F.col("shard").cast("long").alias("id")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).cast("int").alias("slots"))
    every = rows.sparkSession.range(shards).join(F.broadcast(held), "id", "left").na.fill(0, ["bytes", "slots"])
    state = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bytes", "slots"))), lambda x: F.struct(x["bytes"].alias("bytes"), x["slots"].alias("slots"), x["id"].cast("int").alias("shard"))).alias("state"))
    out = rows.where("not goes").select("virtual_slot", "shard", "bytes", "rows").unionByName(_dealt(rows.where("goes"), state))
    return out.crossJoin(F.broadcast(version)).select("virtual_slot", "shard", "bytes", "rows", "version")


def rebalance(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version for one shard more (`shards` is the new number): from each old shard, slots in order
    of a hash go to the new shard until it has its share; no slot moves between old shards."""
    moved = _before("shard") + F.col("bytes") <= F.sum("bytes").over(Window.partitionBy("shard")) / F.lit(shards)
    return slot_map.select("virtual_slot", F.when(moved, F.lit(shards - 1)).otherwise(F.col("shard")).alias("shard"), "bytes", "rows", (F.col("version") + 1).alias("version"))


def store_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Keep a map as the folder's next version, and read it back; a version that is there already is an error."""
    version = slot_map.first().version
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/map-{version:06d}")
    return load_map(slot_map.sparkSession, folder, version)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """A stored version of the map, or the newest; None if there is none."""
    try:
        stored = spark.read.parquet(f"{folder}/map-*" if version is None else f"{folder}/map-{version:06d}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if version is None:
        return load_map(spark, folder, stored.agg(F.max("version")).first()[0])
    return stored


def grow(spark: SparkSession, folder: str) -> DataFrame:
    """Store and return the next version of the folder's map, for one shard more: single slots move to the new shard, by
    the bytes that the map holds for them."""
    old = load_map(spark, folder)
    if old is None:
        raise ValueError("there is no map to grow")
    return store_map(rebalance(old, old.agg(F.max("shard")).first()[0] + 2), folder)


def place(rows: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """`rows` (see sized) with the shard that a map of any version gives their virtual slot, slot (the position in the
    shard, gapless from 0) and map_version. Positions follow these rows' own counts, summed by slot over the bounded
    map: no shard is gathered or sorted."""
    counts = slot_loads(rows, slots).select("virtual_slot", "rows")
    mapped = slot_map.select("virtual_slot", "shard", "version").join(F.broadcast(counts), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = mapped.select("virtual_slot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long").alias("base"))
    at = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("nth", F.row_number().over(at) - 1)
    return placed.join(F.broadcast(base), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", F.col("shard").cast("int"), (F.col("base") + F.col("nth")).cast("long").alias("slot"), F.col("version").alias("map_version"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot and map_version, under the `bytes` law. The folder's newest
    map serves if it deals these very loads to as many shards; else it is edited for them and stored as its next version.
    Without a folder the map is stored in a new one below the shared folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}"
    rows = sized(docs, id_col, text_col, slots)
    stored = load_map(spark, folder)
    loads = slot_loads(rows, slots)
    if stored is not None:
        kept = stored.agg(F.max("version").alias("version"), F.max("shard").alias("shard")).first()
        other = loads.join(F.broadcast(stored), ["virtual_slot", "bytes", "rows"], "left_anti")
        if kept.shard != shards - 1 or not other.isEmpty():
            stored = store_map(edited(stored, loads, shards), folder)
    else:
        stored = store_map(first_map(loads, shards), folder)
    return place(rows, stored, slots)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards under the `bytes` law, by the map that is kept for the table's path."""
    folder = f"{shared_dir(spark)}/slot-maps/documents-{zlib.crc32(sf_dir.encode()):08x}"
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder=folder)
    return out.drop("map_version").withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def shard_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' shards by a stored map of eight shards, and by its next version, which a ninth has been added to."""
    folder = f"{shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}"
    rows = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = store_map(first_map(slot_loads(rows)), folder)
    grown = grow(spark, folder)
    maps = first.select("virtual_slot", F.col("shard").cast("int").alias("shard")).join(grown.select("virtual_slot", F.col("shard").cast("int").alias("grown_shard")), "virtual_slot")
    return rows.join(F.broadcast(maps), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "grown_shard")
