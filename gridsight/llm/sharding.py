"""Placing documents on shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, an offset
and a step taken from a digest of its name. Shards take turns, each claiming the first
slot in its order that is still free. All shards get the same number of slots, give or
take one, and when a shard joins or leaves, few slots of the others change hands. The
table has `slots` rows whatever the corpus holds, so it is broadcast and a document
finds its shard in one look-up of its key's digest.

Defined results: a null key is placed as the empty text; repeated rows go to one shard;
an empty table gives no rows. A hot key is not split, as placement is by key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsight.llm.registry import query, read

SHARDS = 64
#: A prime, more than a hundred slots for each shard.
SLOTS = 8191


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(names: list[str], slots: int) -> list[int]:
    """The index of the owner of every slot. `slots` must be a prime above len(names)."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime")
    if not names or len(names) > slots:
        raise ValueError("between one shard and one for each slot")
    wanted = [_number(f"offset:{n}") % slots for n in names]
    steps = [_number(f"skip:{n}") % (slots - 1) + 1 for n in names]
    owner = [-1] * slots
    free = slots
    while free:
        for shard, step in enumerate(steps):
            if not free:
                break
            slot = wanted[shard]
            while owner[slot] >= 0:
                slot = (slot + step) % slots
            owner[slot] = shard
            wanted[shard] = (slot + step) % slots
            free -= 1
    return owner


def lookup_table(spark: SparkSession, names: list[str], slots: int) -> DataFrame:
    """(slot, shard): one row for each slot."""
    owners = F.split(F.lit(",".join(map(str, fill(names, slots)))), ",")
    return spark.range(1, numPartitions=1).select(F.posexplode(owners).alias("slot", "shard")).select(
        "slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) for every row of `docs`."""
    table = lookup_table(docs.sparkSession, names, slots)
    keyed = docs.select(F.col(key).alias("_key"), slot_of(F.col(key), slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(F.col("_key").alias(key), "slot", "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


ORACLE = f"""
WITH RECURSIVE prefs AS (
  SELECT i, ('0x' || substr(md5('offset:' || name), 1, 8))::BIGINT % {SLOTS} AS first_slot,
         ('0x' || substr(md5('skip:' || name), 1, 8))::BIGINT % {SLOTS - 1} + 1 AS step
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 4, '0') AS name FROM range({SHARDS}) t(i))),
wishes AS (
  SELECT list(first_slot ORDER BY i) AS firsts, list(step ORDER BY i) AS steps FROM prefs),
turns AS (
  SELECT 0 AS turn, list_transform(range({SLOTS}), lambda x: -1) AS owner,
         list_transform(range({SHARDS}), lambda x: 0::BIGINT) AS used
  UNION ALL
  SELECT turn + 1,
         list_concat(list_concat(owner[1:slot], [shard]), owner[slot + 2:]),
         list_concat(list_concat(used[1:shard], [nth + 1]), used[shard + 2:])
  FROM (
    SELECT turn, owner, used, shard, nth, (firsts[shard + 1] + nth * steps[shard + 1]) % {SLOTS} AS slot
    FROM (
      SELECT turn, owner, used, firsts, steps, turn % {SHARDS} AS shard,
        list_filter(range(used[turn % {SHARDS} + 1], {SLOTS}), lambda x:
          owner[(firsts[turn % {SHARDS} + 1] + x * steps[turn % {SHARDS} + 1]) % {SLOTS} + 1] = -1)[1] AS nth
      FROM turns, wishes WHERE turn < {SLOTS}))),
filled AS (SELECT owner FROM turns WHERE turn = {SLOTS}),
placed AS (
  SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS})::INTEGER AS slot
  FROM documents)
SELECT doc_id, slot, owner[slot + 1] AS shard FROM placed, filled
"""


@query("op5_shard_documents", ORACLE)
def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by its id."""
    return place(read(spark, sf_dir, "documents"), "doc_id", shard_names())
