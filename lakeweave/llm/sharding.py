"""Byte-balanced shards from sampled splitters.

The key of a record is a 64-bit hash of its text. A size-weighted hash sample
of keys gives quantile boundaries of ``ranges_per_shard`` * shards ranges;
records are range-partitioned by binary search in them. Ranges that come out
overfull are subdivided: their heavy keys (a text with very many copies)
become units of their own, and any unit is cut into slices by a hash of the
document so that numbering never meets an unbounded group in one task. A heavy
key's slices also hash a number of the row, staged with it, so that even rows
equal in every column part.

Shards are filled by exact unit loads: heavy units go to the lightest shard
first, the other ranges then fill the shards' remaining capacity in key order,
so that a shard is one key interval plus some heavy keys. Equal texts share a
shard; only a text whose copies exceed a whole shard's share is spread.

Defined results: a null text has size 1 (no bytes plus one) and a null CRC; an
empty table gives an empty result; repeated rows get slots of their own; a
null doc_id is an ordinary value; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, pick

SHARDS = 8
RANGES_PER_SHARD = 128
#: Sampled keys for each range.
SAMPLED = 48
SEED = 2


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A frame of a few driver-made rows, without any Python on the executors."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def _range_of(key: Column, boundaries: list[int]) -> Column:
    """Boundaries at or below the key, by binary search in a constant array."""
    if not boundaries:
        return F.lit(0)
    steps = [1 << i for i in range(len(boundaries).bit_length() - 1, -1, -1)]
    table = F.array(*[F.lit(b).cast("long") for b in boundaries])
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda low, step: F.when((low + step <= len(boundaries)) & (F.try_element_at(table, F.least(low + step, F.lit(len(boundaries)))) <= key), low + step).otherwise(low),
    )


def _assign(items: list[dict], shards: int) -> None:
    """Give each item its shard: slices of spread keys fill shard after shard, heavy keys go to the
    lightest shard, and the other ranges in range order into what capacity is left."""
    load, share, s = [0.0] * shards, sum(x["bytes"] for x in items) / shards, 0
    for x in sorted((x for x in items if x["spread"]), key=lambda x: (x["range"], x["key"], x["slices"])):
        if load[s] + x["bytes"] / 2 > share:
            s = min(range(shards), key=lambda s: (load[s], s))
        x["shard"] = s
        load[s] += x["bytes"]
    for x in sorted((x for x in items if x["heavy"] and not x["spread"]), key=lambda x: (-x["bytes"], x["range"], x["key"])):
        x["shard"] = min(range(shards), key=lambda s: (load[s], s))
        load[x["shard"]] += x["bytes"]
    light = sum(x["bytes"] for x in items if not x["heavy"])
    # The level to which light ranges fill the shards; a shard above it takes none.
    order, level, below = sorted(load), 0.0, 0.0
    for i, x in enumerate(order, 1):
        below += x
        level = (light + below) / i
        if i == shards or level <= order[i]:
            break
    ends, filled = [], 0.0
    for x in load:
        filled += max(0.0, level - x)
        ends.append(filled)
    at, done = 0, 0.0
    for x in sorted((x for x in items if not x["heavy"]), key=lambda x: x["range"]):
        while at < shards - 1 and done + x["bytes"] / 2 > ends[at]:
            at += 1
        x["shard"] = at
        done += x["bytes"]


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot: each row's shard by near equal bytes and its gapless place there."""
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = cut(d.select(d["doc_id"].cast("long"), size.alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("key"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("mark"), F.monotonically_increasing_id().alias("row")))
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = shards * ranges_per_shard
    schema = "doc_id long, size long, text_crc32 long, key long, shard int, slot long"
    if not count:
        return spark.createDataFrame([], schema)
    # Size-weighted sample: a record is drawn with probability proportional to its size.
    per_draw = max(1.0, total / (wanted * SAMPLED))
    uniform = F.pmod("mark", F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.filter(uniform < F.col("size") / per_draw)
    weight = F.greatest(F.lit(1), F.round(F.col("size") / per_draw)).cast("long")
    # Sampled keys, about wanted * SAMPLED of them at any input size, are ranked by weight in one task;
    # each of `wanted` quantiles keeps its first key.
    per_key = drawn.groupBy("key").agg(F.sum(weight).alias("weight"))
    running = F.sum("weight").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    quantile = F.floor((running - 1) * wanted / F.sum("weight").over(Window.partitionBy(F.lit(0))))
    cuts = per_key.select("key", quantile.alias("quantile")).groupBy("quantile").agg(F.min("key").alias("key"))
    boundaries = sorted(r[0] for r in cuts.select("key").collect())[1:]  # at most `wanted`
    placed = rows.withColumn("range", _range_of(F.col("key"), boundaries))
    loads = placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()  # at most `wanted`
    full_bytes, full_rows = 4 * total / wanted, 4 * count / wanted
    overfull = {r["range"] for r in loads if r["bytes"] > full_bytes or r["rows"] > full_rows}
    heavy: list = []
    if overfull:  # a heavy key has over 1/wanted of the bytes or rows, so there are at most 2 * wanted
        inside = placed.filter(F.col("range").isin(sorted(overfull))).groupBy("range", "key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
        heavy = inside.filter((F.col("bytes") > full_bytes / 4) | (F.col("rows") > full_rows / 4)).collect()
    units = {r["range"]: {"range": r["range"], "key": None, "heavy": False, "rows": r["rows"], "bytes": r["bytes"]} for r in loads}
    for h in heavy:
        units[h["range"]]["rows"] -= h["rows"]
        units[h["range"]]["bytes"] -= h["bytes"]
    units = list(units.values()) + [{"range": h["range"], "key": h["key"], "heavy": True, "rows": h["rows"], "bytes": h["bytes"]} for h in heavy]
    units = [u for u in units if u["rows"]]
    for i, u in enumerate(units):
        # Slices bound what one task numbers; a key beyond a shard's share is spread by whole slices.
        u["unit"] = i
        u["slices"] = max(1, -(-u["rows"] * wanted // count), -(-u["bytes"] * wanted // total) if u["bytes"] * shards > total else 1)
    plan = _small(spark, [{"p_range": u["range"], "p_key": u["key"], "unit": u["unit"], "slices": u["slices"]} for u in units], "p_range int, p_key long, unit int, slices int")
    light_plan = plan.filter("p_key IS NULL").select("p_range", F.col("unit").alias("l_unit"), F.col("slices").alias("l_slices"))
    heavy_plan = plan.filter("p_key IS NOT NULL").select("p_key", F.col("unit").alias("h_unit"), F.col("slices").alias("h_slices"))
    rows = placed.join(F.broadcast(light_plan), placed["range"] == light_plan["p_range"], "left")
    rows = rows.join(F.broadcast(heavy_plan), rows["key"] == heavy_plan["p_key"], "left")
    rows = rows.withColumn("unit", F.coalesce("h_unit", "l_unit")).withColumn("slice", F.when(F.col("h_slices").isNotNull(), F.pmod(F.xxhash64("mark", "row"), F.col("h_slices"))).otherwise(F.pmod("mark", F.col("l_slices"))).cast("int"))
    rows = rows.select("doc_id", "size", "text_crc32", "key", "unit", "slice")
    slices = rows.groupBy("unit", "slice").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()  # some `wanted` slices
    items = {}
    for r in slices:
        u = units[r["unit"]]
        spread = u["bytes"] * shards > total
        item = items.setdefault((r["unit"], r["slice"] if spread else -1), {"range": u["range"], "key": u["key"] or 0, "heavy": u["heavy"] or spread, "spread": spread, "bytes": 0, "slices": []})
        item["bytes"] += r["bytes"]
        item["slices"].append((r["slice"], r["unit"], r["rows"]))
    for item in items.values():
        item["slices"].sort()
    _assign(list(items.values()), shards)
    before, offsets = [0] * shards, []
    for item in sorted(items.values(), key=lambda x: (x["range"], x["slices"])):
        for part, unit, n in item["slices"]:
            offsets.append({"o_unit": unit, "o_slice": part, "shard": item["shard"], "before": before[item["shard"]]})
            before[item["shard"]] += n
    offsets = _small(spark, offsets, "o_unit int, o_slice int, shard int, before long")
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("unit", "slice").orderBy("key", "doc_id", "size", "text_crc32")))
    numbered = numbered.join(F.broadcast(offsets), (F.col("unit") == F.col("o_unit")) & (F.col("slice") == F.col("o_slice")))
    return numbered.select("doc_id", "size", "text_crc32", "key", "shard", (F.col("before") + F.col("n") - 1).alias("slot"))
