"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an offset and a skip from hashes of its name. Shards take turns:
each claims the first slot of its permutation that is free, until the table is full, so shares differ by one slot at most; when a shard
leaves or joins, most slots keep their shard. The table (``SLOTS`` rows, whatever the documents) is broadcast, and a document's
shard is the one of its slot, the hash of its id modulo the size: constant time, no shuffle, no state.

Defined results: a null doc_id is placed as the text 'null'; rows that repeat a doc_id go to the same shard; texts do not matter; an empty table gives no
rows; other columns are kept, but for a ``slot`` or ``shard_id`` of the input, which the result's replace; no shards, or fewer slots than shards, or a size that is not prime, is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import table

SHARDS, SLOTS = 64, 4_099


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup(shards: list[str], size: int = SLOTS) -> list[int]:
    """Index of the shard of each slot."""
    if not shards or len(set(shards)) < len(shards) or size < len(shards) or any(size % k == 0 for k in range(2, int(size ** 0.5) + 1)):
        raise ValueError("shards must have names of their own, and the size be a prime of at least their number")
    offset, skip = [_hash(s, "offset") % size for s in shards], [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    turn, slots, left = [0] * len(shards), [-1] * size, size
    while left:
        for k in range(len(shards)):
            if not left:
                break
            while slots[at := (offset[k] + turn[k] * skip[k]) % size] >= 0:
                turn[k] += 1
            slots[at] = k
            turn[k] += 1
            left -= 1
    return slots


def names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def place(docs: DataFrame, shards: list[str], size: int = SLOTS) -> DataFrame:
    """docs with slot and shard_id, in place of columns of these names."""
    slots = docs.sparkSession.createDataFrame(list(enumerate(lookup(shards, size))), "slot long, shard_id int")
    key = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 8)
    return docs.drop("slot", "shard_id").withColumn("slot", F.conv(key, 16, 10).cast("long") % size).join(F.broadcast(slots), "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), names(SHARDS)).select("doc_id", "slot", "shard_id")


ORACLE = f"""
with recursive shard as (
  select i, cast(cast('0x' || substr(md5('offset:' || name), 1, 16) as ubigint) % {SLOTS} as bigint) as off,
         cast(cast('0x' || substr(md5('skip:' || name), 1, 16) as ubigint) % {SLOTS - 1} as bigint) + 1 as skip
  from (select i, 'shard-' || lpad(cast(i as varchar), 5, '0') as name from range({SHARDS}) t(i))),
fill as (
  select 0 as step, list_transform(range({SLOTS}), lambda x: cast(-1 as int)) as slots
  union all
  select step + 1, list_concat(list_concat(list_slice(slots, 1, pos), [cast(step % {SHARDS} as int)]), list_slice(slots, pos + 2, {SLOTS}))
  from (select step, slots, (off + skip * list_filter(range({SLOTS}), lambda j: slots[(off + j * skip) % {SLOTS} + 1] = -1)[1]) % {SLOTS} as pos
        from fill join shard on i = step % {SHARDS} where step < {SLOTS})),
s as (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 8) as bigint) % {SLOTS} as slot from documents)
select doc_id, slot, slots[slot + 1] as shard_id from s, (select slots from fill where step = {SLOTS})"""
