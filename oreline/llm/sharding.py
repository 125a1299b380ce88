"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Records hash into thousands of slots that never change. Bytes are summed per slot, and only the map
from slots to shards is edited, by moving as few slots as even shards need.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreline.llm.common import cut, scratch

SLOTS = 4096
#: Repeated keys up to which they are broadcast.
SMALL = 1_000_000


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of which shard each slot belongs to."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(0, shards, tuple(k % shards for k in range(slots)))

    def rebalanced(self, sizes: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version: slots leave shards above the mean, largest first, for the lightest shards
        below it; then up to a hundred moves or swaps of single slots bring the heaviest and lightest nearer."""
        shards = shards or self.shards
        size = [sizes.get(k, 0) for k in range(len(self.owner))]
        mean = sum(size) / shards
        held: list[set[int]] = [set() for _ in range(shards)]
        loose = []
        for k, s in enumerate(self.owner):
            (held[s].add(k) if s < shards else loose.append(k))
        load = [sum(size[k] for k in x) for x in held]
        for s in range(shards):
            for k in sorted(held[s], key=lambda k: (-size[k], k)):
                if load[s] - size[k] >= mean and size[k]:
                    held[s].remove(k)
                    loose.append(k)
                    load[s] -= size[k]
        for k in sorted(loose, key=lambda k: (-size[k], k)):
            s = min(range(shards), key=lambda s: (load[s], s))
            held[s].add(k)
            load[s] += size[k]
        for _ in range(100):
            high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            best = min((x for x in _exchanges(held[high], held[low], size, gap)), default=None)
            if best is None:
                break
            _, out, back = best
            for a, b, ks in ((high, low, out), (low, high, back)):
                for k in ks:
                    held[a].remove(k)
                    held[b].add(k)
                    load[a] -= size[k]
                    load[b] += size[k]
        owner = [0] * len(self.owner)
        for s, ks in enumerate(held):
            for k in ks:
                owner[k] = s
        return SlotMap(self.version + 1, shards, tuple(owner))

    def save(self, spark: SparkSession, folder: str) -> None:
        """Store this version beside the earlier ones; a stored version is never overwritten."""
        text = json.dumps({"version": self.version, "shards": self.shards, "owner": self.owner})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/version-{self.version:06d}")

    @classmethod
    def latest(cls, spark: SparkSession, folder: str) -> SlotMap | None:
        """The stored map of the highest version, if any."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
        found = [int(x.split("-")[1]) for x in names if x.startswith("version-")]
        return cls.load(spark, folder, max(found)) if found else None

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int) -> SlotMap:
        x = json.loads(spark.read.text(f"{folder}/version-{version:06d}").first()[0])
        return cls(x["version"], x["shards"], tuple(x["owner"]))

    def column(self, slot: Column) -> Column:
        """The shard of a slot; the map is a literal of fixed length."""
        return F.element_at(F.array(*[F.lit(s) for s in self.owner]), slot + 1)


def _exchanges(high: set[int], low: set[int], size: list[int], gap: int):
    """Ways to narrow a gap between two shards: one slot over, or one over for a smaller one back."""
    back = sorted((size[k], k) for k in low)
    for k in high:
        if 0 < size[k] < gap:
            yield abs(gap - 2 * size[k]), (k,), ()
        at = bisect.bisect_left(back, (size[k] - gap / 2, -1))
        for s, j in back[max(0, at - 1) : at + 1]:
            if 0 < size[k] - s < gap:
                yield abs(gap - 2 * (size[k] - s)), (k,), (j,)


def slot_of(id_: Column, text: Column, slots: int = SLOTS, salt: Column | None = None) -> Column:
    """The virtual slot of a record: a hash of its id and text, and of a number where several rows share both."""
    return F.pmod(F.xxhash64(id_, text, *([] if salt is None else [salt])), F.lit(slots)).cast("int")


def shards(docs: DataFrame, n: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False, folder: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (place in its
    shard, gapless from 0), grown_shard (null: the law is ``bytes``), virtual_slot, map_version.

    The latest map in ``folder`` (at first one that deals slots out evenly) is edited until the shards'
    bytes are near equal, and stored there as the next version; without a folder the maps go with the
    session. Null texts have size 1 and checksum 0; copies of a text are spread by id, rows that repeat
    id and text by their place in the input. keep_rows: also a column ``row`` with all of the input's
    columns. Empty tables give no rows. Each slot is ordered in one task: more rows want more ``slots``.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_key"), slot_of(F.col(id_col), text, slots).alias("virtual_slot"), *kept,
    )
    if not keep_rows:
        rows = cut(rows, "sizes")
    repeated = cut(rows.groupBy("doc_id", "text_key").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "repeated")
    if n_repeated := repeated.count():
        again = F.broadcast(repeated) if n_repeated <= SMALL else repeated
        rows = rows.join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
        salted = F.when(F.col("_key").isNotNull(), slot_of(F.col("doc_id"), F.col("text_key"), slots, F.monotonically_increasing_id())).otherwise(F.col("virtual_slot"))
        rows = cut(rows.withColumn("virtual_slot", salted).drop("_id", "_key"), "spread")  # such numbers hold once written
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # at most one row a slot
    folder = folder or scratch(spark, "slot-map")
    before = SlotMap.latest(spark, folder)
    if before is None or len(before.owner) != slots:
        before = SlotMap.first(n, slots)
        before.save(spark, folder)
    before.rebalanced({r.virtual_slot: r.bytes for r in sums}, n).save(spark, folder)
    owners = SlotMap.latest(spark, folder)
    ahead, starts = [0] * n, []
    for r in sorted(sums, key=lambda r: r.virtual_slot):
        starts.append((r.virtual_slot, ahead[owners.owner[r.virtual_slot]]))
        ahead[owners.owner[r.virtual_slot]] += r["rows"]
    place = F.broadcast(spark.createDataFrame(starts, "virtual_slot int, ahead long"))  # at most one row a slot
    own = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("own", own).join(place, "virtual_slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), owners.column(F.col("virtual_slot")).alias("shard"), (F.col("ahead") + F.col("own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        F.lit(owners.version).alias("map_version"), *["row"] * keep_rows,
    )
