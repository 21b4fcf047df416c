"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: sources in code-point order weigh 1, 2, 3, 1, 2, 3, ...; they share the corpus' size by weight, but no source is
taken more than ``EPOCHS`` times: what a source can't take is shared again by weight among the others.

The schedule is a row of slots, each worth one block of ``BLOCK`` tokens. Slot i's point, i times the golden ratio modulo
one, is mapped through the sources' cumulative shares, so that every stretch of the schedule holds all sources in
proportion. A source's documents are shuffled by a hash and cut into blocks of equal tokens; its r-th slot takes its r-th
block, beginning again after the last. Slots beyond a source's target are left out, the few that the points owe it come
at the end, and the last one takes only as many tokens as the target still lacks.

Nothing is gathered by source: running sums go over hash buckets of a source, and joins are by (source, bucket) or
(source, block), of which even a source with most of all rows has many. Rows that repeat a key and text are counted
before anything else and placed as runs of at most ``RUN`` copies, so that they spread like other rows; what a run is
taken is shared out among its copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.frames import anonymous, if_few
from tessera.plans.lineage import cut

WEIGHTS = (1, 2, 3)
EPOCHS = 3
BLOCK = 4096
#: Documents of a bucket, about, and bits that a bucket's name has at most.
BUCKET_DOCS, BUCKET_BITS = 512, 20
#: i * STEP mod 2**31 walks the points i * (golden ratio) mod 1 in whole numbers.
POINTS, STEP = 1 << 31, 1327217885
CELLS = 1 << 12
RUN = 64
SLOT_CHUNK = 1 << 14

_WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str = "text") -> Column:
    """Number of words of a text; 0 if null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Narrow rows, one for each run of copies: key, source as a non-null name and a flag, hash of the text, size of one
    copy, copies (``_n``), size of all, shuffle hash."""
    name, none = F.coalesce(F.col(source), F.lit("")), F.col(source).isNull()
    picked = docs.select(F.col(key).alias("_key"), name.alias("_s"), none.alias("_z"), tokens(text).alias("_one"), F.xxhash64(F.col(key), F.col(text)).alias("_text"))
    copies = picked.groupBy("_key", "_s", "_z", "_text", "_one").agg(F.count("*").alias("_all"))
    runs = copies.withColumn("_run", F.explode(F.sequence(F.lit(0), F.expr(f"(_all - 1) div {RUN}"))))
    runs = runs.withColumn("_n", F.least(F.lit(RUN), F.col("_all") - F.col("_run") * RUN)).withColumn("_size", F.col("_n") * F.col("_one"))
    return runs.select("_key", "_s", "_z", "_text", "_one", "_n", "_size", F.xxhash64("_key", "_text", "_run", F.lit("mix")).alias("_h"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``_s, _z, _total, _target`` (double), ``_words`` (the target in whole tokens) of every source.

    Targets are min(epochs * size, level * weight): the level follows from running sums in the order in which sources
    reach their cap. This table has one row per source.
    """
    sums = sized.groupBy("_s", "_z").agg(F.sum("_size").alias("_total"))
    rank = F.row_number().over(Window.orderBy("_z", "_s")) - 1
    weighed = sums.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    capped = weighed.withColumn("_cap", F.col("_total") * F.lit(float(epochs)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_z", "_s")
    all_of, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    left = F.sum("_total").over(all_of) - F.coalesce(F.sum("_cap").over(before), zero)
    weight_left = F.sum("_w").over(all_of) - F.coalesce(F.sum("_w").over(before), zero)
    # the level if this source and all later ones are not capped; the first source it doesn't cap settles it
    levels = capped.withColumn("_level", left / weight_left)
    settled = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.struct((F.col("_cap") / F.col("_w")).alias("c"), F.col("_level").alias("l")))).over(all_of)
    target = F.least(F.col("_cap"), F.coalesce(settled["l"] * F.col("_w"), F.col("_cap")))
    return levels.withColumn("_target", target).select("_s", "_z", "_total", "_target", F.round("_target").cast("long").alias("_words"))


def plan(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``targets`` with the blocks each source has and the slots it needs for its target."""
    blocks = F.ceil(F.col("_total") / block)
    full = F.when(F.col("_total") > 0, F.expr("_words div _total")).otherwise(F.lit(0)).cast("long")
    rest = F.col("_words") - full * F.col("_total")
    return sources.withColumn("_blocks", blocks).withColumn("_rounds", full).withColumn("_rest", rest).withColumn("_slots", F.col("_rounds") * F.col("_blocks") + F.ceil(F.col("_rest") / block))


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots: ``_at`` (place in the schedule), ``_s, _z``, ``_rank`` (of the slot in its source), ``_block``,
    ``_epoch`` and ``_take`` (tokens).

    Points meet shares by cells: a source's interval of the line is listed under each of ``CELLS`` cells that it touches.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("_slots")).first()[0] or 0
    running = Window.orderBy("_z", "_s").rowsBetween(Window.unboundedPreceding, 0)
    shares = plan.filter("_slots > 0").withColumn("_to", F.sum("_slots").over(running)).withColumn("_from", F.col("_to") - F.col("_slots"))
    edge = lambda c: (F.col(c).cast("double") / F.lit(float(max(total, 1))) * POINTS).cast("long")
    shares = cut(shares.withColumn("_lo", edge("_from")).withColumn("_hi", edge("_to")))
    width = POINTS // CELLS
    cells = shares.withColumn("_cell", F.explode(F.sequence(F.expr(f"_lo div {width}"), F.expr(f"greatest(_lo, _hi - 1) div {width}"))))
    point = (F.pmod(F.col("id"), F.lit(POINTS)) + 1) * STEP % POINTS
    slots = spark.range(total).select(F.col("id").alias("_at"), point.alias("_point")).withColumn("_cell", F.expr(f"_point div {width}"))
    drawn = slots.join(cells, "_cell").filter("_point >= _lo AND _point < _hi")
    drawn = cut(drawn.select("_at", "_s", "_z", F.expr(f"_at div {SLOT_CHUNK}").alias("_chunk")))
    chunks = drawn.groupBy("_s", "_z", "_chunk").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_s", "_z").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.withColumn("_before", earlier)
    rank = F.row_number().over(Window.partitionBy("_s", "_z", "_chunk").orderBy("_at")) - 1
    ranked = drawn.join(chunks.drop("_n"), ["_s", "_z", "_chunk"]).withColumn("_rank", F.col("_before") + rank).select("_at", "_s", "_z", "_rank")
    got = chunks.groupBy("_s", "_z").agg(F.sum("_n").alias("_got"))
    owed = plan.join(got, ["_s", "_z"], "left").filter("_slots > coalesce(_got, 0)")
    late = owed.select(F.lit(total).alias("_at"), "_s", "_z", F.explode(F.sequence(F.coalesce("_got", F.lit(0)).cast("long"), F.col("_slots") - 1)).alias("_rank"))
    size = F.least(F.lit(block), F.col("_total") - F.col("_block") * block)
    epochs = ranked.unionByName(late).join(F.broadcast(plan) if small(plan) else plan, ["_s", "_z"]).filter("_rank < _slots")
    epochs = epochs.withColumn("_block", F.expr("_rank % _blocks")).withColumn("_epoch", F.expr("_rank div _blocks"))
    take = F.when(F.col("_epoch") < F.col("_rounds"), size).otherwise(F.least(size, F.col("_rest") - F.col("_block") * block))
    return epochs.select("_at", "_s", "_z", "_rank", "_block", "_epoch", take.alias("_take"), size.alias("_len"))


def small(sources: DataFrame, most: int = 10_000) -> bool:
    """Whether a table with a row per source has few enough of them to go to every task."""
    return sources.limit(most + 1).count() <= most


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """What the mix takes of every document: ``_key, _s, _z, _text`` (hash), ``_size, _total`` (its source's size),
    ``_target, _taken``.

    Null texts have no words and are taken 0 times; null sources are one source, the last. The order of documents within
    a source is that of a hash of key and text, so reruns agree however rows are dealt. Rows that repeat key, text and
    source are taken alike, to a word.
    """
    sized = cut(_sized(docs, key, text, source))
    sources = cut(targets(sized, weights, epochs))
    planned = cut(plan(sources, block))
    n = sized.count()
    bits = min(BUCKET_BITS, max(0, math.ceil(math.log2(max(1, n / BUCKET_DOCS)))))
    bucket = F.shiftrightunsigned(F.shiftrightunsigned("_h", 1), 63 - bits)
    named = sized.withColumn("_bucket", bucket)
    sums = named.groupBy("_s", "_z", "_bucket").agg(F.sum("_size").alias("_n"))
    ahead = Window.partitionBy("_s", "_z").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    starts = starts.join(F.broadcast(sources) if small(sources) else sources, ["_s", "_z"])
    inside = Window.partitionBy("_s", "_z", "_bucket").orderBy("_h", "_key", "_one").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.join(starts, ["_s", "_z", "_bucket"]).withColumn("_first", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = cut(placed.select("_key", "_s", "_z", "_text", "_one", "_n", "_size", "_total", "_target", "_first"))
    uses = schedule(planned, block).groupBy("_s", "_z", "_block").agg(F.sum((F.col("_take") == F.col("_len")).cast("long")).alias("_whole"), F.sum(F.when(F.col("_take") < F.col("_len"), F.col("_take"))).alias("_part"))
    full = placed.filter("_size > 0")
    pieces = full.withColumn("_block", F.explode(F.expr(f"sequence(_first div {block}, (_first + _size - 1) div {block})")))
    pieces = pieces.withColumn("_lo", F.greatest(F.col("_first"), F.col("_block") * block)).withColumn("_hi", F.least(F.col("_first") + F.col("_size"), (F.col("_block") + 1) * block))
    part = F.greatest(F.lit(0), F.least(F.col("_hi"), F.col("_block") * block + F.coalesce("_part", F.lit(0))) - F.col("_lo"))
    worth = F.coalesce(F.col("_whole"), F.lit(0)) * (F.col("_hi") - F.col("_lo")) + part
    joined = pieces.join(uses, ["_s", "_z", "_block"], "left").withColumn("_taken", worth)
    columns = ["_key", "_s", "_z", "_text", "_one", "_n", "_total", "_target"]
    some = joined.groupBy("_first", *columns).agg(F.sum("_taken").alias("_taken")).select(*columns, "_taken")
    runs = some.unionByName(placed.filter("_size = 0").select(*columns, F.lit(0).cast("long").alias("_taken")))
    each = runs.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("_taken", F.expr("_taken div _n + CASE WHEN _copy <= _taken % _n THEN 1 ELSE 0 END"))
    return each.select("_key", "_s", "_z", "_text", F.col("_one").alias("_size"), "_total", "_target", "_taken")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` as the mix has them, all columns as they were: each row as often as its text is taken, to the nearest
    whole number; texts without words once. Rows that repeat key, text and source go in the same number each."""
    found = taken(docs, key, text, source, **how)
    plain, of, back = anonymous(docs)
    key, text, source = of[key], of[text], of[source]
    mean = found.groupBy(*_same).agg(F.avg("_taken").alias("_mean"))
    whole = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.floor(F.col("_mean") / F.col("_size") + 0.5))
    times = if_few(cut(mean.select("_key", "_s", "_z", "_text", whole.cast("int").alias("_times")).filter("_times > 0")))
    name, none = F.coalesce(F.col(source), F.lit("")), F.col(source).isNull()
    keyed = plain.withColumns({"_key": F.col(key), "_s": name, "_z": none, "_text": F.xxhash64(F.col(key), F.col(text))})
    same = [keyed[c] == times[c] for c in ("_s", "_z", "_text")] + [keyed["_key"].eqNullSafe(times["_key"])]
    met = keyed.join(times, same)
    return back(met.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))))


_same = ("_key", "_s", "_z", "_text", "_size")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: size, source size, target and words taken of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = taken(docs)
    return out.select(F.col("_key").alias("doc_id"), F.when(~F.col("_z"), F.col("_s")).alias("source"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))
