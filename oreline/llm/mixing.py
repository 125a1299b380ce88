"""Mixing sources to target weights along a time-varying curriculum.

A source's words meet a demand that grows as the integral of its weight schedule. Documents of a
source stand in a fixed pseudo-random order; the cumulative words before a document, inverted
through the demand, give its training position, and rows are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.common import cut, n_words, numbered, restored

#: No source is repeated more often than this.
PASSES = 3
#: Weights of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Relative weight along training time at 0, 1/2 and 1, by the source's place in WEIGHTS: linear
#: between these; only the shape counts, the total is the source's target.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def ranked(df: DataFrame, col: str, name: str) -> DataFrame:
    """``df`` with the 0-based rank of distinct ``col`` in code point order, null last, in column ``name``.

    Ranges are ranked apart and shifted by how many rows the ranges before have.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = F.col(col).asc_nulls_last()
    parts = cut(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").count()
    at, before = 0, []
    for part, count in sorted(sizes.collect()):  # a row a range: as many as shuffle partitions
        before.append((part, at))
        at += count
    before = df.sparkSession.createDataFrame(before, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """``sources`` (source, source_size) with ``kind`` (place of its weight) and ``target`` words.

    Weights share out all words; a source above ``passes`` times its size stops there and the excess
    goes to the others by weight, until none is above. The share of a unit of weight follows from a
    few sums in each of these turns; a source that stopped never starts again.
    """
    rank = ranked(sources, "source", "rank").withColumn("kind", F.col("rank") % len(weights)).drop("rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("kind") + 1).cast("int"))
    rank = cut(rank.withColumn("weight", weight), "sources")
    total = rank.agg(F.sum("source_size")).first()[0] or 0
    share, before = 0.0, None
    while share != before:
        before = share
        full = F.col("source_size") * passes <= F.col("weight") * share
        used, left = rank.agg(F.sum(F.when(full, F.col("source_size") * passes)), F.sum(F.when(~full, F.col("weight")))).first()
        share = (total - (used or 0)) / left if left else share
    return rank.withColumn("target", F.least(F.col("source_size") * float(passes), F.col("weight") * share))


def _invert(q: Column, kind: Column, schedules: tuple[tuple[float, float, float], ...]) -> Column:
    """Training time in 0..1 at which a share ``q`` of a source's demand has passed: the root of the
    integral of the piecewise linear schedule."""
    out = F.lit(None).cast("double")
    for k, (a, b, c) in enumerate(schedules):
        first, all_ = (a + b) / 4, (a + 2 * b + c) / 4
        d = q * all_

        def solve(rest: Column, x: float, y: float) -> Column:  # x*t + (y - x)*t*t = rest for t in 0..1/2
            return 2 * rest / (x + F.sqrt(F.greatest(F.lit(x * x) + 4 * (y - x) * rest, F.lit(0.0))))

        out = F.when(kind == k, F.when(d <= first, solve(d, a, b)).otherwise(0.5 + solve(d - first, b, c))).otherwise(out)
    return out


def _passed(t: Column, schedule: tuple[float, float, float]) -> Column:
    """The share of a source's demand that has passed at training time ``t``: what ``_invert`` inverts."""
    a, b, c = schedule
    first, all_, u = (a + b) / 4, (a + 2 * b + c) / 4, t - 0.5
    return F.when(t <= 0.5, (a * t + (b - a) * t * t) / all_).otherwise((first + b * u + (c - b) * u * u) / all_)


def position(begin: Column, demand: dict[int, int], schedules: tuple[tuple[float, float, float], ...]) -> Column:
    """The training position, in words of the mix, at which word ``begin`` of a source's demand (columns target,
    kind) is due. demand: words of all sources of a kind."""
    t = _invert(begin / F.col("target"), F.col("kind"), schedules)
    return sum((float(demand.get(k, 0)) * _passed(t, x) for k, x in enumerate(schedules)), F.lit(0.0))


def _key(id_: Column, text: Column) -> Column:
    """A hash of id and text, in hex: the fixed pseudo-random order within a source."""
    return F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def _slot(place: Column) -> Column:
    return F.conv(F.substring(place, 1, 3), 16, 10).cast("int")


def _slots(rows: DataFrame, weights: tuple[int, ...], passes: int) -> DataFrame:
    """Of each source and slot of ``rows`` (source, slot, size): slot_size, the words ``ahead`` of it, and its source's
    source_size, target and kind. Sources times 4096 rows at most."""
    slots = cut(rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size")), "slots")
    source = targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, passes)
    ahead = F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slots = slots.withColumn("ahead", ahead - F.col("slot_size"))
    slots = slots.join(source.select(F.col("source").alias("_s"), "source_size", "target", "kind"), F.col("source").eqNullSafe(F.col("_s")))
    return cut(slots.select(F.col("source").alias("_s"), F.col("slot").alias("_t"), "slot_size", "ahead", "source_size", "target", "kind"), "places")


def _demand(slots: DataFrame) -> dict[int, int]:
    """Words that all sources of a kind give, in whole words a source."""
    one = slots.groupBy("_s").agg(F.first("kind").alias("kind"), F.floor(F.first("target")).alias("goal"))
    return {int(k): int(n) for k, n in one.groupBy("kind").agg(F.sum("goal")).collect()}


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: tuple[tuple[float, float, float], ...] = SCHEDULES) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, kind, before (words of its source ahead of it
    in the fixed order), ``taken`` words and its first ``position``, range-sorted by position.

    Size is the number of words, 0 for null. The order within a source is that of a hash of id and
    text, so reruns agree; rows equal in both are interchangeable. The hash's first three hex digits
    cut a source into 4096 slots that are summed and ordered apart. The source is read from its start
    again and again until the target is met; the document that meets it gives only the words still
    missing. Documents that give none come last, without position. Empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _key(F.col(id_col), F.col(text_col)).alias("place"))
    rows = cut(rows.withColumn("slot", _slot(F.col("place"))), "sizes")
    slots = _slots(rows, weights, passes)
    demand = _demand(slots)
    own = F.sum("size").over(Window.partitionBy("source", "slot").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("own", own - F.col("size")).join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_t")))
    rows = rows.withColumn("before", F.col("ahead") + F.col("own"))
    goal = F.floor("target")
    passed = F.floor(goal / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.least(F.greatest(goal - passed * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("taken", (passed * F.col("size") + rest).cast("long"))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position(F.col("before"), demand, schedules)))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "kind", "before", "taken", "position")
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: Rows of the slot table up to which it is broadcast (about 64 bytes each).
SMALL = 500_000


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, schedules: tuple[tuple[float, float, float], ...] = SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The training mix: whole rows of ``docs``, each as often as its source's target asks for, in the
    order of training positions.

    Rows move once, to be range-sorted: where a document stands in its slot (a 4096th of its source) is
    read from its hash instead of from those before it. It is taken in a pass if it begins before the
    target there, so a source meets its target up to a document or a slot. Documents without words
    give nothing, null texts neither; repeated rows stand together; an empty table gives no rows.
    """
    docs, names = numbered(docs)
    id_, text, source = F.col(names[id_col]), F.col(names[text_col]), F.col(names[source_col])
    sized = docs.select(source.alias("source"), n_words(text).alias("size"), _slot(_key(id_, text)).alias("slot"))
    slots = _slots(sized, weights, passes)
    demand = _demand(slots)
    slots = F.broadcast(slots) if slots.count() <= SMALL else slots
    share = F.conv(F.substring("place", 4, 7), 16, 10).cast("long") / F.lit(float(1 << 28))
    rows = docs.where(n_words(text) > 0).withColumn("place", _key(id_, text)).withColumn("slot", _slot(F.col("place")))
    rows = rows.join(slots, source.eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_t")))
    rows = rows.withColumn("before", F.col("ahead") + F.floor(share * F.col("slot_size")))
    starts = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda e: e * F.col("source_size") + F.col("before"))
    goes = F.filter(starts, lambda b: b < F.floor("target"))
    rows = rows.select(*names.values(), "target", "kind", F.explode(goes).alias("begin"))
    rows = rows.withColumn("position", position(F.col("begin"), demand, schedules)).orderBy("position", names[id_col])
    return restored(rows, names)


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS kind FROM sources),
stops AS (
  SELECT *, [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS weight, 3 * source_size / [5.0, 2.0, 1.0][kind + 1]::DOUBLE AS stop FROM weighed),
turns AS (
  SELECT k, used, left_weight, lead(stop) OVER (ORDER BY k) AS next_stop FROM (
    SELECT 0 AS k, 0::HUGEINT AS used, (SELECT sum(weight) FROM stops) AS left_weight, NULL::DOUBLE AS stop
    UNION ALL
    SELECT row_number() OVER w, (sum(3 * source_size) OVER w), (SELECT sum(weight) FROM stops) - sum(weight) OVER w, stop
    FROM stops WINDOW w AS (ORDER BY stop, source ROWS UNBOUNDED PRECEDING))),
share AS (
  SELECT coalesce(min_by(share, k), 0) AS share FROM (
    SELECT k, next_stop, ((SELECT sum(source_size) FROM sources) - used)::DOUBLE / left_weight AS share FROM turns WHERE left_weight > 0)
  WHERE coalesce(next_stop, 'inf'::DOUBLE) > share),
goals AS (
  SELECT source, source_size, kind, least(source_size * 3.0::DOUBLE, weight * share) AS target FROM stops, share),
placed AS (
  SELECT doc_id, r.source, size, source_size, kind, target, floor(target)::BIGINT AS goal,
         (sum(size) OVER (PARTITION BY r.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source),
demand AS (
  SELECT coalesce(sum(floor(target)::BIGINT) FILTER (WHERE kind = 0), 0)::DOUBLE AS d0, coalesce(sum(floor(target)::BIGINT) FILTER (WHERE kind = 1), 0)::DOUBLE AS d1,
         coalesce(sum(floor(target)::BIGINT) FILTER (WHERE kind = 2), 0)::DOUBLE AS d2 FROM goals),
given AS (
  SELECT *, (goal // greatest(source_size, 1) * size + least(greatest(goal - goal // greatest(source_size, 1) * source_size - before, 0), size))::BIGINT AS taken,
         [1.5, 1.0, 0.5][kind + 1]::DOUBLE AS a, 1.0::DOUBLE AS b, [0.5, 1.0, 1.5][kind + 1]::DOUBLE AS c,
         before::DOUBLE / target * ((a + 2 * b + c) / 4) AS d, (a + b) / 4 AS half
  FROM placed),
timed AS (
  SELECT *, CASE WHEN d <= half THEN 2 * d / (a + sqrt(greatest(a * a + 4 * (b - a) * d, 0)))
            ELSE 0.5 + 2 * (d - half) / (b + sqrt(greatest(b * b + 4 * (c - b) * (d - half), 0))) END AS t
  FROM given)
SELECT doc_id, source, size, source_size, target, taken, CASE WHEN taken > 0 THEN
       CASE WHEN t <= 0.5 THEN d0 * (1.5::DOUBLE * t + (-0.5)::DOUBLE * t * t) + d1 * (1.0::DOUBLE * t + 0.0::DOUBLE * t * t) + d2 * (0.5::DOUBLE * t + 0.5::DOUBLE * t * t)
       ELSE d0 * (0.625::DOUBLE + 1.0::DOUBLE * (t - 0.5) + (-0.5)::DOUBLE * (t - 0.5) * (t - 0.5)) + d1 * (0.5::DOUBLE + 1.0::DOUBLE * (t - 0.5) + 0.0::DOUBLE * (t - 0.5) * (t - 0.5))
          + d2 * (0.375::DOUBLE + 1.0::DOUBLE * (t - 0.5) + 0.5::DOUBLE * (t - 0.5) * (t - 0.5)) END END AS position
FROM timed, demand
"""
