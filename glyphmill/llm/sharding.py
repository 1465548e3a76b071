"""Sharding by fixed virtual slots.

Records are hashed into SLOTS virtual slots, the bytes of each slot are summed, and a versioned map, stored
beside the data, gives every slot its shard. The law held is `bytes`: slots go to shards by size, largest
first, each to the lightest shard, so shards come out nearly equal. `rebalance` edits a stored map for new
sizes or one more shard and moves as few bytes as it can; records never change slots.

The hash is that of the text, so equal texts share a slot and a shard. Where the copies of one text weigh
over 1/HOT of an even shard they would tilt it; such texts (at most HOT * shards of them) are salted by
their doc_id over all slots.

A map is kept in a folder of its own, one version beside the other. `sharded` with such a folder edits the latest version for
the sizes at hand and stores the next one, so that little moves; without one it begins a new folder at version 1.

A record's place in its shard is the offset of its part plus its rank there. A slot is cut into as many parts, by a
hash of doc_id and text, as it has even slots' worth of rows, so neither a shard nor a slot of many small copies
is ever ordered as a whole; there are at most 2 * SLOTS parts.

Cases. Null text: its own text, size 1. Null doc_id: salted as one value. Repeated rows: each has its own
place. Empty tables give no rows and an all-zero map. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import shared_dir, written

SLOTS = 4096
HOT = 32


def assign(sizes: dict[int, int], shards: int) -> list[int]:
    """A shard for each slot: by size downwards, each to the lightest shard so far."""
    out = [0] * SLOTS
    load = [(0, s) for s in range(shards)]
    for slot in sorted(range(SLOTS), key=lambda k: (-sizes.get(k, 0), k)):
        weight, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (weight + sizes.get(slot, 0), shard))
    return out


def rebalance(slot_map: dict, sizes: dict[int, int], shards: int) -> dict:
    """The next version of a map: slots leave overfull (or dropped) shards for the lightest, the rest stay."""
    old = slot_map["shard_of_slot"]
    load = [0] * shards
    for slot, shard in enumerate(old):
        if shard < shards:
            load[shard] += sizes.get(slot, 0)
    even = sum(sizes.values()) / shards
    new = list(old)
    for slot in sorted(range(SLOTS), key=lambda k: (-sizes.get(k, 0), k)):
        at, size = old[slot], sizes.get(slot, 0)
        light = min(range(shards), key=lambda s: (load[s], s))
        if at >= shards or (load[at] - size >= even and load[light] + size <= even):
            if at < shards:
                load[at] -= size
            load[light] += size
            new[slot] = light
    return {"version": slot_map["version"] + 1, "shards": shards, "shard_of_slot": new}


def store_map(spark: SparkSession, slot_map: dict, folder: str | None = None) -> str:
    """Write a map as one JSON row in its folder, a new one in the shared folder if none is named; versions stand side by side."""
    folder = folder or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(slot_map),)], "value string").coalesce(1).write.text(f"{folder}/version={slot_map['version']}")
    return folder


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> dict | None:
    """A version of the map in the folder, the latest if none is named; None where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    # A version counts once its write has been committed.
    found = [str(f.getPath()) for f in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(place, "version=*")) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if files.exists(place) else []
    versions = {int(path.rsplit("=", 1)[1]): path for path in found}
    if not versions:
        return None
    return json.loads(spark.read.text(versions[max(versions) if version is None else version]).first()[0])


def next_map(old: dict | None, sizes: dict[int, int], shards: int) -> dict:
    """The map for these sizes: a first one, or the edited old one."""
    return rebalance(old, sizes, shards) if old else {"version": 1, "shards": shards, "shard_of_slot": assign(sizes, shards)}


def _slot(hot: list[int]) -> Column:
    even = F.pmod("text_hash", F.lit(SLOTS))
    return (F.when(F.col("text_hash").isin(hot), F.pmod(F.xxhash64("text_hash", "doc_id"), F.lit(SLOTS))).otherwise(even) if hot else even).cast("int")


def sharded(documents: DataFrame, shards: int = 8, whole_rows: bool = False, folder: str | None = None) -> tuple[DataFrame, str]:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) for every document, and the map's folder; whole_rows: with the row as struct `row`.

    folder: where earlier versions of the map are; the next one is stored there.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    sizes = [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash")]
    rows = written(documents.select(*sizes), "sizes")
    bytes_of = lambda df: {r.k: r.b for r in df.groupBy("k").agg(F.sum("size").alias("b")).collect()}  # noqa: E731  a row per slot
    first = bytes_of(rows.select(_slot([]).alias("k"), "size"))
    most = max(1, sum(first.values()) // (HOT * shards))
    full = [k for k, b in first.items() if b > most]
    hot = []
    if full:  # fewer than HOT * shards texts can weigh more than `most`
        copies = rows.where(_slot([]).isin(full)).groupBy("text_hash").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > most) & (F.col("n") > 1))
        hot = [r.text_hash for r in copies.select("text_hash").collect()]
    stats = rows.groupBy(_slot(hot).alias("k")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    slot_map = next_map(load_map(spark, folder) if folder else None, {r.k: r.b for r in stats}, shards)
    folder = store_map(spark, slot_map, folder)
    even = max(1, sum(r.n for r in stats) // SLOTS)
    parts = {r.k: -(-r.n // even) for r in stats if r.n > even}  # at most SLOTS entries, 2 * SLOTS parts
    wide = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for entry in parts.items() for x in entry)), F.col("virtual_slot")), F.lit(1)) if parts else F.lit(1)
    part = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("part")), wide).cast("int")
    counts = rows.withColumn("virtual_slot", _slot(hot)).groupBy("virtual_slot", part.alias("part")).agg(F.count("*").alias("n")).collect()
    begin, offsets = [0] * shards, []
    for k, p, n in sorted((r.virtual_slot, r.part, r.n) for r in counts):
        shard = slot_map["shard_of_slot"][k]
        offsets.append((k, p, shard, begin[shard]))
        begin[shard] += n
    places = spark.createDataFrame(offsets, "s int, p int, shard int, begin long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_hash", "size"))
    if whole_rows:
        rows = documents.select(F.struct("*").alias("row"), *sizes)
    out = rows.withColumn("virtual_slot", _slot(hot)).withColumn("part", part).withColumn("rank", rank)
    out = out.join(F.broadcast(places), (F.col("virtual_slot") == F.col("s")) & (F.col("part") == F.col("p")))
    return out.select(*(["row"] if whole_rows else []), "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("begin") + F.col("rank") - 1).cast("long").alias("slot")), folder


def sharded_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """The documents with size, text_crc32, law, virtual_slot, shard and slot; these replace input columns of the same names."""
    added = ["size", "text_crc32", "law", "virtual_slot", "shard", "slot"]
    rows, _ = sharded(documents, shards, whole_rows=True)
    kept = [F.col("row").getField(c).alias(c) for c in documents.columns if c.lower() not in added]
    return rows.withColumn("law", F.lit("bytes")).select(*kept, *added)


def op3(spark, sf_dir: str) -> DataFrame:
    rows, _ = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
