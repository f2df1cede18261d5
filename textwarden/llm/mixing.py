"""Mixing sources to target weights, with DataFrame operations only.

The words of a source are laid end to end and cut into blocks of a fixed length.  Every
output shard draws how many of its slots each source gets, a multinomial draw made slot
by slot; running totals of the draws are scaled so that they end at the number of slots
the source's target asks for.  The slots of a source are numbered through all shards and
mapped, pass by pass, through a pseudorandom permutation of its block numbers; a block is
then found by its number.  A pass visits every block once, and no source gets more than
its passes, so no document is taken more often than ``MOST`` times.

A source with most of the rows is cut into chunks by id: sums, windows and joins are by
source and chunk, or by source and block.  The table of sources is sorted as a whole.
Exploded tables are larger than Spark estimates, so their joins are told to sort and merge.

Defined results: null text has no words; null is a source of its own, the last; rows
that share id and text are packed one by one, and in ``mix_documents`` all take what the
first of them takes; empty tables give empty tables.  Equal input gives equal output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textwarden.operators.staging import stage

#: A word of the contract.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of an output shard, rows of a chunk on average.
BLOCK_WORDS, SHARD_SLOTS, CHUNK_ROWS = 64, 4096, 4096
#: Slots that a task numbers.
TASK_SLOTS = 1 << 16
#: Weights of the sources in order, repeating; the mix's size against the input; passes.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Cells that the range of a draw is cut into, to find its source by an equality join.
CELLS = 1 << 14
#: Steps that bring a number back into the range of a permutation.  A number lies outside
#: with odds below one in the root of the range, and at most that many lie outside.
WALKS = 32


def _key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(doc_id, source, skey, hash, size)``, size in words."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), _key(F.col(source)).alias("skey"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), words.alias("size"),
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(skey, source_size, target)``: shares by weight, held at ``most`` times a source's size.

    What is above is shared again by weight.  With sources ordered by the level at which
    they are full, the first that is not full at the level its successors ask for gives
    the level of all that follow.
    """
    sums = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sums = sums.withColumn("weight", weight.cast("double")).withColumn("full", most * F.col("source_size") / F.col("weight"))
    order, every = Window.orderBy("full", "skey"), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(share)
    left = total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    sums = sums.withColumn("level", left / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "skey", "level"))).over(every)["level"]
    target = F.least(most * F.col("source_size").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return sums.select("skey", "source_size", target.alias("target"))


def packed(rows: DataFrame, chunks: int, targets: DataFrame) -> DataFrame:
    """Rows with ``chunk``, ``rn`` within it, ``start``, their first word's place in the source, and its target."""
    cut = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    cut = cut.repartition(chunks, "skey", "chunk")
    sums = cut.groupBy("skey", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("skey", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("chunk_start"))
    starts = starts.join(targets, "skey")
    within = Window.partitionBy("skey", "chunk").orderBy("doc_id", "hash", "size")
    earlier = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.withColumn("rn", F.row_number().over(within)).withColumn("earlier", earlier)
    return placed.join(starts, ["skey", "chunk"]).withColumn("start", F.col("chunk_start") + F.col("earlier")).drop(
        "earlier", "chunk_start"
    )


def _round(a: Column, b: Column, seed: Column, modulus: Column) -> Column:
    return F.pmod(a + F.pmod(F.xxhash64(b, seed), modulus), modulus)


def _shuffled(x: Column, n: Column, side: Column, seed: Column) -> Column:
    """One step of a permutation of ``[0, side * ceil(n / side))``: four Feistel rounds."""
    other = F.ceil(n / side)
    a, b = F.pmod(x, side), F.floor(x / side)
    for k in range(2):
        a = _round(a, b, F.concat(seed, F.lit(f":{2 * k}")), side)
        b = _round(b, a, F.concat(seed, F.lit(f":{2 * k + 1}")), other)
    return (a + b * side).cast("long")


def permuted(x: str, n: str, seed: Column) -> Column:
    """Column ``x`` in ``[0, n)`` mapped through a pseudorandom permutation of that range."""
    x, n = F.col(x).cast("long"), F.col(n).cast("long")
    side = F.ceil(F.sqrt(n.cast("double")))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), _shuffled(x, n, side, seed),
        lambda y, _: F.when(y < n, y).otherwise(_shuffled(y, n, side, seed)),
    )


def shard_draws(wanted: DataFrame, shards: int, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """``(skey, shard, drawn)`` of sources ``(skey, slots, slots_before)``: multinomial counts."""
    width = max(1, -(-slots // CELLS))
    tasks = max(1, -(-shards * shard_slots // TASK_SLOTS))
    draws = wanted.sparkSession.range(0, shards, 1, tasks).select(
        F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(shard_slots - 1))).alias("slot")
    ).withColumn("u", F.pmod(F.xxhash64("shard", "slot", F.lit(seed)), F.lit(slots)))
    last = F.col("slots_before") + F.col("slots") - 1
    cells = wanted.filter("slots > 0").withColumn("last", last).withColumn(
        "cell", F.explode(F.sequence(F.expr(f"slots_before div {width}"), F.expr(f"last div {width}")))
    )
    hit = draws.withColumn("cell", F.expr(f"u div {width}")).join(
        cells.select("skey", "cell", "slots_before", "last").hint("merge"), "cell"
    ).filter("u BETWEEN slots_before AND last")
    return hit.groupBy("skey", "shard").agg(F.count("*").alias("drawn"))


def mix_slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """``(skey, shard, slot, pass, block)``: which block every slot of the mix holds."""
    wanted = targets.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn(
        "slots", F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"), MOST * F.col("blocks"))
    )
    before = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    wanted = stage(wanted.select("skey", "blocks", "slots", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("slots_before")))
    slots = wanted.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-slots // shard_slots))
    drawn = shard_draws(wanted, shards, max(1, slots), shard_slots, seed)
    # A source that drew nothing gets its few slots in one shard.
    none = wanted.join(drawn.select("skey").distinct().hint("merge"), "skey", "left_anti").select(
        "skey", F.pmod(F.xxhash64("skey", F.lit(seed)), F.lit(shards)).alias("shard"), F.lit(1).cast("long").alias("drawn")
    )
    by_shard = Window.partitionBy("skey").orderBy("shard")
    upto = F.sum("drawn").over(by_shard.rowsBetween(Window.unboundedPreceding, 0))
    counts = drawn.unionByName(none).select(
        "skey", "shard", "drawn", upto.alias("upto"), F.sum("drawn").over(Window.partitionBy("skey")).alias("all_drawn")
    ).join(wanted.hint("merge"), "skey")
    scaled = lambda c: F.floor(c / F.col("all_drawn") * F.col("slots"))
    counts = counts.withColumn("a", scaled(F.col("upto") - F.col("drawn"))).withColumn("b", scaled(F.col("upto")))
    # Few rows that become many: dealt out before, or one task would number a hot source's slots.
    dealt = counts.filter("b > a").repartition(max(1, -(-slots // TASK_SLOTS)), "skey", "shard")
    each = dealt.select("skey", "shard", "blocks", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("slot"))
    each = each.withColumn("pass", F.expr("slot div blocks")).withColumn("x", F.expr("slot % blocks"))
    seeded = F.concat_ws(":", F.col("skey"), F.col("pass").cast("string"), F.lit(str(seed)))
    return each.select("skey", "shard", "slot", "pass", permuted("x", "blocks", seeded).alias("block"))


def block_pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each block a document has words in: ``first_word`` and ``words``; none if it has no words."""
    end = F.col("start") + F.col("size")
    blocks = F.when(
        F.col("size") > 0, F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    )
    rows = placed.withColumn("block", F.explode_outer(blocks))
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    last = F.least(end, (F.col("block") + 1) * block_words)
    return rows.withColumn("first_word", first - F.col("start")).withColumn("words", F.coalesce(last - first, F.lit(0)))


def _mixed(docs: DataFrame, key: str, source: str, text: str, block_words: int, seed: int):
    rows = stage(sized(docs, key, source, text))
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    targets = stage(source_targets(rows))
    pieces = block_pieces(packed(rows, chunks, targets), block_words)
    return pieces, mix_slots(targets, block_words, seed=seed).hint("merge")


def mixture(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    block_words: int = BLOCK_WORDS, seed: int = 0,
) -> DataFrame:
    """The mix: ``(shard, slot, pass, skey, block, doc_id, hash, first_word, words)``, a row per piece."""
    pieces, slots = _mixed(docs, key, source, text, block_words, seed)
    return slots.join(pieces.filter("size > 0"), ["skey", "block"]).select(
        "shard", "slot", "pass", "skey", "block", "doc_id", "hash", "first_word", "words"
    )


def taken_words(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    block_words: int = BLOCK_WORDS, seed: int = 0,
) -> DataFrame:
    """``(key, size, source_size, target, taken)``, one row per document."""
    pieces, slots = _mixed(docs, key, source, text, block_words, seed)
    times = slots.groupBy("skey", "block").agg(F.count("*").alias("times"))
    taken = F.sum(F.col("words") * F.coalesce(F.col("times"), F.lit(0)))
    whole = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    per_doc = pieces.join(times.hint("merge"), ["skey", "block"], "left").groupBy("skey", "chunk", "rn").agg(
        *whole, taken.alias("taken")
    )
    return per_doc.select(F.col("doc_id").alias(key), "size", "source_size", "target", "taken")


def mix_documents(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    block_words: int = BLOCK_WORDS, seed: int = 0,
) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, with those words."""
    pieces, slots = _mixed(docs, key, source, text, block_words, seed)
    taken = slots.join(pieces.filter("size > 0 AND rn > 0"), ["skey", "block"])
    # One share for rows that agree in everything: that of the first.
    first = taken.groupBy("skey", "chunk", "rn", "doc_id", "hash", "pass").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("_parts")
    )
    first = first.groupBy("skey", "doc_id", "hash", "pass").agg(F.min_by("_parts", "rn").alias("_parts"))
    shares = first.select(F.col("skey").alias("_s"), F.col("doc_id").alias("_d"), F.col("hash").alias("_h"), "_parts")
    # The row travels as one column: its own names may be anything.
    own = F.col("_row")[text]
    named = docs.select(
        F.struct(*docs.columns).alias("_row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
        _key(F.col(source)).alias("_source"),
    )
    joined = named.join(
        shares.hint("merge"),
        F.col("_row")[key].eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")) & (F.col("_source") == F.col("_s")),
    )
    words = F.filter(F.split(own, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    whole = F.aggregate("_parts", F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.size("_words")
    chosen = F.flatten(F.transform("_parts", lambda p: F.slice("_words", (p["first_word"] + 1).cast("int"), p["words"].cast("int"))))
    joined = joined.withColumn("_words", words)
    taken_text = F.when(whole, own).otherwise(F.array_join(chosen, " "))
    return joined.select(*((taken_text if c == text else F.col("_row")[c]).alias(c) for c in docs.columns))
