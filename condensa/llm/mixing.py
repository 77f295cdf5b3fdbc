"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

The words of a source, in a seeded order of its documents and twice over, are
cut into blocks of equal numbers of words. Blocks are allocated to sources by
highest quotients target / (2 k + 1), for growing numbers of seats, one step of
growth per output shard; the method never takes a seat back as the number grows,
so the differences are each shard's integer quota of each source. A seeded
permutation of a source's blocks then deals them: the first of the permuted order are the
first shard's quota, the next the second's, until the source's seats are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix over words there are, and the most a source or document may be repeated.
TOTAL, REPEAT = 1.5, 2
#: The largest block, in words; smaller ones where a source's target would be coarse.
BLOCK = 256
#: Primes above any number of blocks of a source, so that multiplying by them permutes the blocks.
_PRIMES = (2**61 - 1, 2**60 - 93)


def targets(sizes: DataFrame) -> DataFrame:
    """Adds weight, target and place to sizes(source, source_size), one row a source.

    A target is weight times the level at which the targets, stopped at REPEAT
    times their source's size, add up to TOTAL times all sizes; this is where
    sharing out excess by weight again and again ends. The rows are the sources,
    a number that doesn't grow with the documents.
    """
    place = "row_number() over (order by source nulls last) - 1"
    rows = sizes.withColumn("place", F.expr(place)).withColumn("weight", F.expr(f"element_at(array{WEIGHTS}, cast(place % {len(WEIGHTS)} as int) + 1)"))
    rows = rows.withColumn("full", F.expr(f"source_size * {REPEAT} / weight"))
    rows = rows.selectExpr(
        "*",
        f"coalesce(sum(source_size * {REPEAT}) over (order by full, place rows between unbounded preceding and 1 preceding), 0) below",
        "sum(weight) over (order by full desc, place desc rows between unbounded preceding and current row) above",
        f"sum(source_size) over () * {TOTAL}D total",
    )
    # full * above + below grows along the order: the first source at which it reaches the total sets the level
    rows = rows.withColumn("level", F.expr("min_by((total - below) / above, case when below + full * above >= total then struct(full, place) end) over ()"))
    return rows.selectExpr("source", "source_size", "place", "weight", f"case when total = 0 then 0D else least(weight * coalesce(level, 1e300D), source_size * {REPEAT}D) end target")


def quotas(targets: DataFrame, shards: int, block: Column) -> DataFrame:
    """source, shard, quota: the seats each shard takes of each source.

    All sources' targets together are divided into blocks; after shard h, the
    number of seats given out is (h + 1) / shards of them.
    """
    rows = targets.withColumn("block", block).withColumn("all", F.expr("sum(target) over ()")).withColumn("sources", F.expr("count(case when target > 0 then 1 end) over ()"))
    rows = rows.where("target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    rows = rows.withColumn("seats", F.expr(f"cast(round(all / block * (shard + 1) / {shards}) as bigint)"))
    # seats that every divisor near all / seats gives, and those that none can give
    # the hundredth is for rounding of doubles at many seats
    sure = "case when seats > sources / 2D then greatest(0L, cast(floor(target * (seats - sources / 2D) / all + 0.49D) as bigint)) else 0L end"
    most = "cast(floor(target * (seats + sources / 2D) / all + 0.51D) as bigint) + 1"
    rows = rows.selectExpr("*", f"{sure} sure", f"{most} most").withColumn("free", F.expr("seats - sum(sure) over (partition by shard)"))
    open_seats = rows.select("*", F.expr("explode(filter(sequence(sure, most), k -> k > sure))").alias("k")).withColumn("quotient", F.expr("target / (2 * k - 1)"))
    ranked = open_seats.withColumn("rank", F.expr("row_number() over (partition by shard order by quotient desc, place)"))
    given = ranked.groupBy("source", "place", "shard", "sure").agg(F.count_if(F.col("rank") <= F.col("free")).alias("won"))
    return given.selectExpr("source", "place", "shard", "sure + won as until").selectExpr("source", "place", "shard", "until", "until - coalesce(lag(until) over (partition by place order by shard), 0) as quota")


def planned(targets: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, source_size, target, block, seats, blocks (REPEAT passes of the source), untils (the
    seats given out after each shard), step and shift (of the permutation), one row a source."""
    # blocks shrink for small sources' sake, to a two-hundredth of the smallest target
    block = F.expr(f"greatest(1L, least({BLOCK}L, cast(min(case when target > 0 then target end) over () / 200 as bigint)))")
    taken = quotas(targets, shards, block).groupBy("place").agg(F.max("until").alias("seats"), F.sort_array(F.collect_list(F.struct("shard", "until"))).alias("untils"))
    rows = targets.withColumn("block", block).join(taken, "place", "left").selectExpr("source", "source_size", "target", "block", "coalesce(seats, 0) seats", f"cast(ceil(source_size * {REPEAT} / block) as bigint) blocks", "untils.until untils")
    # a product of powers of the primes, so coprime to the number of blocks; decimals, as products of two longs overflow
    factors = [_PRIMES[0]] * (1 + seed % 7) + [_PRIMES[1]] * (seed // 7 % 5)
    step = f"aggregate(array({', '.join(f'{x}L' for x in factors)}), 1L, (acc, x) -> {_product('acc', 'x')})"
    return rows.selectExpr("*", f"if(blocks > 0, {step}, 0L) step", f"if(blocks > 0, pmod(xxhash64({seed}, source), blocks), 0L) shift")


def _product(a: str, b: str) -> str:
    """a * b modulo blocks."""
    return f"cast(pmod(cast({a} as decimal(19, 0)) * cast({b} as decimal(19, 0)), cast(blocks as decimal(19, 0))) as bigint)"


def mix(docs: DataFrame, shards: int = 8, seed: int = 17, lanes: int = 1024) -> DataFrame:
    """doc_id, size, source_size, target, taken and pieces of each row of docs.

    size counts words (null: 0); taken counts the words the mix takes, repeats too,
    at most REPEAT times size; pieces says which shard takes how many words of the row
    in which block. A null source is one source, the last; sources
    without words have target 0 and give nothing. Repeated rows are taken each by
    itself; rows alike in all that is read are interchangeable. Null doc_ids take
    part; an empty table gives no rows; other columns are left out. Positions in a
    source come from sums over lanes of hashed ids, so a large source is numbered
    in many tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long"), n_words(F.col("text")).alias("size"), "source", F.crc32(F.col("text").cast("binary")).alias("crc"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "crc")).withColumn("lane", F.pmod(F.col("order"), F.lit(lanes)).cast("int"))
    rows = rows.repartition("source", "lane")
    sums = rows.groupBy("source", "lane").agg(F.sum("size").alias("lane_size"))
    by_source = targets(sums.groupBy("source").agg(F.sum("lane_size").alias("source_size")))
    plan = planned(by_source, shards, seed)
    start = sums.selectExpr("source", "lane", "coalesce(sum(lane_size) over (partition by source order by lane rows between unbounded preceding and 1 preceding), 0) lane_start")
    lanes_plan = start.join(F.broadcast(plan), start["source"].eqNullSafe(plan["source"])).select(start["source"], "lane", "lane_start", "source_size", "target", "block", "seats", "blocks", "untils", "step", "shift")
    placed = rows.withColumn("inside", F.expr("sum(size) over (partition by source, lane order by order, doc_id, size rows between unbounded preceding and current row) - size"))
    both = placed.alias("d").join(lanes_plan.alias("p"), F.expr("d.source <=> p.source and d.lane = p.lane")).selectExpr("d.doc_id", "d.size", "p.source_size", "p.target", "p.block", "p.seats", "p.blocks", "p.untils", "p.step", "p.shift", "p.lane_start + d.inside as begin")
    # the blocks a row lies in, their places in the permuted order, and of those below the seats the shard
    overlap = "greatest(0L, least((k + 1) * block, {a} + size) - greatest(k * block, {a}))"
    place = f"pmod({_product('k', 'step')} + shift, blocks)"
    blocks_in = "transform(sequence({a} div block, ({a} + size - 1) div block), k -> struct(k as block, " + place + " as place, " + overlap + " as words))"
    passes = ", ".join(blocks_in.format(a=f"(begin + {i} * source_size)") for i in range(REPEAT))
    taken = f"transform(filter(concat({passes}), x -> x.place < seats), x -> struct(size(filter(untils, u -> u <= x.place)) as shard, x.block, x.words))"
    out = both.selectExpr("doc_id", "size", "source_size", "target", f"case when size = 0 or seats = 0 then array() else {taken} end pieces")
    return out.selectExpr("doc_id", "size", "source_size", "target", "aggregate(pieces, 0L, (acc, x) -> acc + x.words) taken", "pieces")


def mixed(docs: DataFrame, shards: int = 8, seed: int = 17, lanes: int = 64) -> DataFrame:
    """The rows of docs, all their columns, each 0 to REPEAT times, so that a source gives the
    words of its seats. Rows without words stay once.

    Rows of a source are numbered from short to long, seeded among like sizes, and the
    share the seats have of its words is rounded cumulatively over these numbers: any
    run of rows has its share of repeats within one, so the words are off by about
    the longest document at most, and long documents have the same share as short
    ones. Rows are numbered each by itself, repeated and null doc_ids too. A cell is
    a lane by hash of a source's rows of about one size (a sixteenth of an octave),
    so a large source is numbered in many tasks. Null texts have no words; an empty table
    stays empty; other columns may have any names.
    """
    rows = docs.select(F.struct("*").alias("row"), "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]).alias("order"))
    octave, lane = F.expr("if(size = 0, -1, cast(floor(16 * log2(size)) as int))"), F.pmod(F.col("order"), F.lit(lanes)).cast("int")
    rows = rows.withColumn("cell", F.struct("source", octave.alias("octave"), lane.alias("lane"))).drop("source")  # as one key, null sources meet
    sums = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("cell_size"))
    plan = planned(targets(sums.groupBy("cell.source").agg(F.sum("cell_size").alias("source_size"))), shards, seed)
    plan = plan.selectExpr("source plan_source", f"if(source_size = 0, 0D, least(seats * block / source_size, {REPEAT}D)) share")
    start = sums.where("cell.octave >= 0").selectExpr("cell", "coalesce(sum(n) over (partition by cell.source order by cell.octave, cell.lane rows between unbounded preceding and 1 preceding), 0) start")
    starts = start.join(F.broadcast(plan), F.expr("cell.source <=> plan_source")).select("cell", "start", "share")
    placed = rows.where("size > 0").withColumn("inside", F.expr("row_number() over (partition by cell order by size, order)"))
    both = placed.join(starts, "cell").selectExpr("row", "share", "start + inside as number")
    times = both.selectExpr("row", "cast(floor(share * number + 0.5D) - floor(share * (number - 1) + 0.5D) as int) times").where("times > 0")
    return times.select("row", F.explode(F.expr("sequence(1, times)"))).select("row.*").unionByName(rows.where("size = 0").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
