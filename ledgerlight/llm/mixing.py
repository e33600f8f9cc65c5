"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations.

Each source is cut into BLOCKS blocks by a hash of its documents; where it has fewer documents, fewer are in use. Its
target, in words, is drawn as whole passes over its blocks in permuted order and a last pass that ends inside one
block, where documents are taken in permuted order, the last one in part, so that the target is met to the word. The
numbers of blocks drawn from each source are the colours of an urn; a binary tree over the
output shards halves the urn again and again, each split a multivariate-hypergeometric draw, so that each shard has
an exact quota of blocks of each source. Shards then take disjoint runs of each source's permuted blocks and order
their documents by hash.

A null source is a source of its own, the last. A null or empty text has size 0 and is never taken. Repeated rows
take part each for itself (rows equal in id and text share their order keys). Of a text only its number of words goes
further, so very long ones cost no more. Empty tables give no rows. mix() passes all columns through, under any names;
if mix_words or mix_shards are among them, its own get underscores behind. Sources shall be few enough for one row to
hold a number for each; documents may be any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .store import durable

#: No source is drawn more often than this.
MAX_EPOCHS = 3
#: Blocks that each source's documents are dealt to.
BLOCKS = 4096
#: Output shards are 2 ** DEPTH.
DEPTH = 4
SEED = "mix-1"
#: Deviations off the mode within which a hypergeometric number is drawn; all others together weigh less than 1e-14.
REACH = 8
WORD = "[^\\x20\\x09-\\x0D]+"


def _key(*parts: Column | str) -> Column:
    """A permuting key that any SQL engine can make: 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("-")) for p in parts])), 1, 13), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a permuting key; no text goes further than this."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        _key(F.col("doc_id").cast("string")).alias("_mix_key"),
    )


def targets(rows: DataFrame) -> DataFrame:
    """source, source_docs, source_size, target: weights 1, 2, 3, 1, ... by order of the source, targets capped at
    MAX_EPOCHS times the source's size. Resharing the excess by weight until none is above ends where all uncapped
    sources stand at one level of target / weight; that level is found by walking up the caps."""
    s = rows.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("size").alias("source_size"))
    by_name = W.Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    by_level = W.Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward, every = by_level.rowsBetween(W.Window.unboundedPreceding, -1), by_level.rowsBetween(0, W.Window.unboundedFollowing), W.Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "source_docs", "source_size", "target")


def blocked(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows with their block and their source's columns."""
    return rows.join(goal.withColumnRenamed("source", "_mix_source"), rows["source"].eqNullSafe(F.col("_mix_source"))).drop("_mix_source").withColumn("block", F.col("_mix_key") % BLOCKS)


def plan(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """A row for each block: how often it is drawn whole, and how many words of it the last pass still takes."""
    b = blocked(rows, goal).groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    b = b.withColumn("goal", F.round("target").cast("bigint")).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0))
    b = b.withColumn("turn", F.row_number().over(W.Window.partitionBy("source").orderBy(_key(F.col("source"), F.col("block").cast("string")), "block")))
    upto = W.Window.partitionBy("source").orderBy("turn").rowsBetween(W.Window.unboundedPreceding, 0)
    rest = F.col("goal") - F.col("epochs") * F.col("source_size")
    b = b.withColumn("sum", F.sum("block_size").over(upto)).withColumn("last", F.col("sum") <= rest)
    b = b.withColumn("whole", F.col("epochs") + F.col("last").cast("int"))
    b = b.withColumn("part", F.when(~F.col("last") & (F.col("sum") - F.col("block_size") < rest), rest - F.col("sum") + F.col("block_size")).otherwise(F.lit(0)))
    return b.withColumn("draws", F.col("whole") + (F.col("part") > 0).cast("int")).select("source", "block", "turn", "whole", "part", "draws")


def _let(values: dict[str, Column], fn) -> Column:
    """fn of a struct of values, each of which is computed once, however often fn names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), fn), F.lit(0))


def _drawn(balls: Column, n: Column, rest: Column, unit: Column) -> Column:
    """A hypergeometric draw by the inverse of its distribution: how many of balls are among n drawn from rest. The
    weights of neighbouring numbers have a simple ratio; more than REACH deviations off the mode they are nil."""
    one, zero = F.lit(1.0), F.lit(0.0)

    def bounds(p):
        n, balls, rest = p["n"], p["balls"], p["rest"]
        sd = F.sqrt(F.greatest(zero, n * balls / rest * (1 - balls / rest) * (rest - n) / F.greatest(rest - 1, one)))
        mode, reach = F.floor((n + 1) * (balls + 1) / (rest + 2)), F.ceil(sd * REACH) + REACH
        least, most = F.greatest(zero, n - (rest - balls), mode - reach), F.least(n, balls, mode + reach)
        values = {c: p[c] for c in ("n", "balls", "rest", "unit")} | {"least": least.cast("bigint"), "every": F.sequence(least.cast("bigint"), most.cast("bigint"))}
        return F.when(rest > 0, _let(values, weighed)).otherwise(F.lit(0).cast("bigint"))

    def weighed(p):
        following = lambda a, k: a["w"] * (p["balls"] - k) * (p["n"] - k) / ((k + 1) * (p["rest"] - p["balls"] - p["n"] + k + 1))
        total = F.aggregate(p["every"], F.struct(one.alias("w"), zero.alias("sum")), lambda a, k: F.struct(following(a, k).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])
        start = F.struct(one.alias("w"), zero.alias("sum"), p["least"].alias("x"), (total * p["unit"]).alias("goal"))
        step = lambda a, k: F.struct(following(a, k).alias("w"), (a["sum"] + a["w"]).alias("sum"), (a["x"] + (a["sum"] + a["w"] <= a["goal"]).cast("bigint")).alias("x"), a["goal"].alias("goal"))
        return F.least(F.array_max(p["every"]), F.aggregate(p["every"], start, step, lambda a: a["x"]))

    return _let({"n": n.cast("double"), "balls": balls.cast("double"), "rest": rest.cast("double"), "unit": unit}, bounds)


def _split(counts: Column, node: Column) -> Column:
    """How many of each colour go left: a multivariate-hypergeometric draw of half the urn, one colour after the
    other, each a hypergeometric draw from what is left."""
    add = lambda a, x: a + x
    total = F.aggregate(counts, F.lit(0).cast("bigint"), add)
    none = F.expr("array()").cast("array<bigint>")

    def colour(acc, c):
        n = acc["n"] - F.aggregate(acc["x"], F.lit(0).cast("bigint"), add)
        unit = _key(F.lit("urn"), node.cast("string"), F.size(acc["x"]).cast("string")) / F.lit(float(1 << 52))
        return F.struct(acc["n"].alias("n"), (acc["rest"] - c).alias("rest"), F.concat(acc["x"], F.array(_drawn(c, n, acc["rest"], unit))).alias("x"))

    start = F.struct(F.floor(total / 2).cast("bigint").alias("n"), total.alias("rest"), none.alias("x"))
    return F.aggregate(counts, start, colour)["x"]


def quotas(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """source, shard, lo, hi: the run of the source's drawn blocks, numbered from 0, that the shard takes."""
    colours = blocks.groupBy("source").agg(F.sum("draws").alias("draws"))
    nodes = colours.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("null"), "source", "draws"))).alias("s"))
    nodes = nodes.select("s", F.lit(0).cast("bigint").alias("shard"), F.transform("s", lambda x: x["draws"].cast("bigint")).alias("n"))
    for level in range(depth):
        left = nodes.withColumn("left", _split(F.col("n"), F.col("shard") + (1 << level)))
        child = lambda bit, n: F.struct((F.col("shard") * 2 + bit).alias("shard"), n.alias("n"))
        nodes = left.select("s", F.explode(F.array(child(0, F.col("left")), child(1, F.zip_with("n", "left", lambda a, b: a - b)))).alias("c")).select("s", "c.shard", "c.n")
    each = nodes.select("shard", F.posexplode(F.arrays_zip("s", "n")).alias("i", "c")).select("shard", F.col("c.s.source").alias("source"), F.col("c.n").alias("quota"))
    upto = W.Window.partitionBy("source").orderBy("shard").rowsBetween(W.Window.unboundedPreceding, 0)
    return each.withColumn("hi", F.sum("quota").over(upto)).withColumn("lo", F.col("hi") - F.col("quota")).filter("quota > 0").select("source", "shard", "lo", "hi")


def _ending(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """The documents of the block in which the last pass ends, with the words taken of them: whole documents in
    permuted order, and of the one at which the pass ends as many words as are still missing."""
    cut = blocks.filter("part > 0").select(F.col("source").alias("_mix_source"), F.col("block").alias("_mix_block"), "part")
    edge = placed.join(cut, placed["source"].eqNullSafe(F.col("_mix_source")) & (placed["block"] == F.col("_mix_block"))).filter("size > 0")
    order = W.Window.partitionBy("_mix_source", "_mix_block").orderBy("_mix_key", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, 0)
    left = F.col("part") - F.sum("size").over(order) + F.col("size")
    return edge.withColumn("words", F.least("size", left)).filter("words > 0").select("doc_id", "source", "size", "source_size", "target", "block", "_mix_key", "words")


def draws(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """A row for each document that a shard gets: doc_id, source, size, words (taken of it, mostly all), source_size,
    target, epoch, shard, and place, which orders each shard."""
    return _draws(durable(sized(docs), "sized"), depth)[0]


def _draws(rows: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The draws, and all rows with their source's columns. The tables of sources and blocks are written first, so
    that Spark knows their sizes and broadcasts them only if they are small."""
    goal = durable(targets(rows), "targets")
    placed = blocked(rows, goal)
    blocks = durable(plan(rows, goal), "blocks")
    size = F.count("*").over(W.Window.partitionBy("source"))
    every = F.when(F.col("draws") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("draws").cast("bigint") - 1)).otherwise(F.expr("array()").cast("array<bigint>"))
    drawn = blocks.withColumn("_size", size).withColumn("epoch", F.explode(every)).withColumn("number", F.col("epoch") * F.col("_size") + F.col("turn"))
    # the last pass skips blocks, so the numbers are closed up
    drawn = drawn.withColumn("number", F.row_number().over(W.Window.partitionBy("source").orderBy("number")) - 1)
    share = quotas(blocks, depth).withColumnRenamed("source", "_mix_source")
    drawn = drawn.join(share, drawn["source"].eqNullSafe(F.col("_mix_source")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    drawn = durable(drawn.select(F.col("source").alias("_mix_source"), F.col("block").alias("_mix_block"), "epoch", "shard", (F.col("epoch") < F.col("whole")).alias("all")), "drawn")
    on = F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("block") == F.col("_mix_block"))
    out = placed.drop("source_docs").filter("size > 0").withColumn("words", F.col("size")).join(drawn.filter("all"), on).unionByName(_ending(placed, blocks).join(drawn.filter("not all"), on))
    place = F.xxhash64(F.lit(SEED), "shard", "epoch", "doc_id")
    return out.select("doc_id", "source", "size", "words", "source_size", "target", "epoch", "shard", place.alias("place")), placed


def taken(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """A row for each document: doc_id, size, source, source_size, target, taken (the words that its draws take), and
    shards, a number whose bit k is set if shard k holds the document (depth up to 5). Rows that agree in doc_id, source
    and size have equal draws; each gets an equal share of them, and all have their shards."""
    got, every = _draws(durable(sized(docs), "sized"), depth)
    empty = F.lit(0).cast("bigint")
    both = got.select("doc_id", "source", "size", "source_size", "target", F.col("words").alias("took"), F.pow(F.lit(2), F.col("shard")).cast("bigint").alias("bit"), empty.alias("row")).unionByName(every.select("doc_id", "source", "size", "source_size", "target", empty.alias("took"), empty.alias("bit"), F.lit(1).cast("bigint").alias("row")))
    sums = both.groupBy("doc_id", "source", "size").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("took").alias("took"), F.bit_or("bit").alias("shards"), F.sum("row").alias("rows"))
    # rows that agree: the first rows get one draw more if the draws do not divide
    each = sums.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1))).withColumn("n", F.when(F.col("size") > 0, F.floor(F.col("took") / F.col("size"))).otherwise(0))
    share = F.floor(F.col("n") / F.col("rows")) + (F.col("i") < F.col("n") % F.col("rows")).cast("bigint")
    part = F.when(F.col("i") == F.col("n") % F.col("rows"), F.col("took") - F.col("n") * F.col("size")).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", (share * F.col("size") + part).cast("bigint").alias("taken"), "shards")


def mix(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs in the mix: a row for each document that is drawn, its own columns, then mix_words (words the mix takes)
    and mix_shards (the shards that got it, with repeats). The text is joined once, not for each draw."""
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    words, shards, size = free("mix_words"), free("mix_shards"), free("_mix_words")
    on_id, on_source, on_size = free("_mix_id"), free("_mix_source"), free("_mix_size")
    ids = docs.withColumn(size, F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint"))
    got = draws(docs, depth).groupBy("doc_id", "source", "size").agg(F.sum("words").alias(words), F.sort_array(F.collect_list("shard")).alias(shards))
    got = got.select(F.col("doc_id").alias(on_id), F.col("source").alias(on_source), F.col("size").alias(on_size), words, shards)
    on = F.col("doc_id").eqNullSafe(F.col(on_id)) & F.col("source").eqNullSafe(F.col(on_source)) & (F.col(size) == F.col(on_size))
    return ids.join(got, on).drop(on_id, on_source, on_size, size)
