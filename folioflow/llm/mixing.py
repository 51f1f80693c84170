"""Operator 10, mixing sources to target weights (DataFrame functions only).

Each source's words form one stream that is cut into blocks of ``block`` words; a document lies in a row of blocks. The
mix is a number of slots per source (its target over the block length; a last slot may be cut), dealt to output shards
of even size: each place of a shard draws a source by target weight, so a shard's source counts are a multinomial draw,
and a seeded correction swaps the few places that a source drew above its number for sources below theirs. A shard's
slots are then permuted, so sources alternate in it. Slot ``j`` of a source reads block ``permutation(j mod blocks)``,
so each pass over a source reads every block once, in a pseudorandom order, and no block is read more often than the
target's multiple rounded up. Blocks join slots by index; what comes out are rows (shard, slot, source, block, words),
and what is taken of a document is counted over them.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating; together they get ``share`` percent of all
words; a target stops at ``most`` times its source's words and the excess goes to the others by weight until none is
above. One row per source meets in one task there (a source is a name, not data).
The word stream of a source is numbered in buckets of hashed doc_ids, so that a hot source is spread over many tasks.
Null texts have no words; documents without words take none; an empty table gives no rows; repeated doc_ids are
separate documents; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.workspace import stored

BLOCK = 128
BUCKETS = 512
CHUNK = 4096
#: Rows per source up to which they are broadcast.
SOURCES = 200_000
#: Weights of the sources in order.
WEIGHTS = (3, 1, 2)


def beside(side: DataFrame) -> DataFrame:
    """A stored table with few rows per source, broadcast if it's small enough; Spark picks the join otherwise."""
    return F.broadcast(side) if side.count() <= SOURCES else side


def word_count(text: Column) -> Column:
    """Runs of bytes other than 0x20 and 0x09-0x0D."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sizes: DataFrame, share: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights are poured in until caps hold them back."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(whole) * share / 100)
        .withColumn("caps", F.sum("cap").over(upto) - F.col("cap"))
        .withColumn("rest", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("caps")) / F.col("rest"))  # if this source is the first that isn't capped
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def permuted(j: Column, n: Column, salt: Column, rounds: int = 2, walks: int = 32, back: bool = False) -> Column:
    """A keyed permutation of 0..n-1: a Feistel network over a grid of about root n by root n cells; ``back`` inverts it.

    A cell beyond n - 1 is walked on until one below comes out; such cells are fewer than a row of the grid, so 32 walks
    are never used up in practice, and an error is raised if they are. Four half rounds make a pseudorandom permutation.
    """
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    whole = F.struct(j.cast("long").alias("x"), n.cast("long").alias("n"), wide.alias("wide"), salt.alias("salt"))

    def turn(at: Column, k: Column) -> Column:
        low = F.pmod(at["low"] + F.pmod(F.xxhash64(at["salt"], k, at["up"]), at["wide"]), at["wide"])
        up = lambda low: F.pmod(at["up"] + F.pmod(F.xxhash64(k, at["salt"], low), at["high"]), at["high"])
        return F.transform(F.array(low), lambda low: F.struct(low.alias("low"), up(low).alias("up"), at["wide"].alias("wide"), at["high"].alias("high"), at["salt"].alias("salt")))[0]

    def turn_back(at: Column, k: Column) -> Column:
        up = F.pmod(at["up"] - F.pmod(F.xxhash64(k, at["salt"], at["low"]), at["high"]), at["high"])
        low = lambda up: F.pmod(at["low"] - F.pmod(F.xxhash64(at["salt"], k, up), at["wide"]), at["wide"])
        return F.transform(F.array(up), lambda up: F.struct(low(up).alias("low"), up.alias("up"), at["wide"].alias("wide"), at["high"].alias("high"), at["salt"].alias("salt")))[0]

    def network(x: Column, g: Column) -> Column:
        high = F.floor((g["n"] + g["wide"] - 1) / g["wide"])
        start = F.struct(F.pmod(x, g["wide"]).alias("low"), F.floor(x / g["wide"]).alias("up"), g["wide"].alias("wide"), high.alias("high"), g["salt"].alias("salt"))
        order = [*range(1, rounds + 1)]
        return F.aggregate(F.array(*map(F.lit, order[::-1] if back else order)), start, turn_back if back else turn, lambda at: at["up"] * at["wide"] + at["low"])

    def ended(g: Column) -> Column:
        def walked(x: Column) -> Column:
            on = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), x, lambda x, _: F.when(x < g["n"], x).otherwise(network(x, g)))
            return F.when(x < g["n"], x).otherwise(F.coalesce(F.filter(F.array(on), lambda x: x < g["n"])[0], F.raise_error(F.lit("the permutation did not end")).cast("long")))

        return F.transform(F.array(network(g["x"], g)), walked)[0]

    return F.coalesce(F.transform(F.array(whole), ended)[0], F.lit(-1).cast("long"))  # never null: no filter repeats it


def _pass_salt(seed: int, turn: Column) -> Column:
    """What picks the permutation of a source's pass."""
    return F.xxhash64(F.lit(seed), "s", turn.cast("long"))


def _numbered(docs: DataFrame, share: int, most: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row with its place in its source's word stream, with text and without; and a row for each source (s) with blocks, slots and rest.

    Rows without text come from sizes counted and stored once; equal rows of (mark, doc_id, size) have equal texts, so both
    forms number alike. slots are whole blocks, rest is the words of one more, cut slot.
    """
    marked = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("mark")).withColumn("bucket", F.pmod("mark", F.lit(BUCKETS)).cast("int"))
    sized = stored(marked.select("doc_id", "source", "mark", "bucket", word_count(F.col("text")).alias("size")), "sizes")
    buckets = stored(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    aimed = (
        targets(sizes, share, most)
        .withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("passes", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)))
        .withColumn("more", F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.floor(F.col("more") / block))
        .withColumn("rest", F.pmod("more", F.lit(block)))
    )
    aimed = stored(aimed, "targets")
    named = beside(aimed.select(F.col("source").alias("name"), "s", "source_size", "target", "blocks", (F.col("slots") + (F.col("rest") > 0).cast("long")).alias("reads")))
    starts = buckets.join(named, F.col("source").eqNullSafe(F.col("name"))).select("s", "bucket", (F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("first"))
    inside = Window.partitionBy("s", "bucket").orderBy("mark", "doc_id", "size")

    def placed(rows: DataFrame, *more: str) -> DataFrame:
        return (
            rows.join(named, F.col("source").eqNullSafe(F.col("name")))
            .select("doc_id", *more, "mark", "bucket", "s", "source_size", "target", "blocks", "reads", "size")
            .withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("nth", F.row_number().over(inside))
            .join(starts, ["s", "bucket"])
            .select("doc_id", *more, "size", "s", "bucket", "nth", "source_size", "target", "blocks", "reads", (F.col("first") + F.col("end") - F.col("size")).alias("start"))
        )

    return placed(marked.withColumn("size", word_count(F.col("text"))), "text"), placed(sized), aimed


def dealt(aimed: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, s, n, first, before, places): how many slots of a source a shard holds; first slot of the source there.

    before counts the shard's slots of sources ahead, places all its slots. Each place draws a source by target weight;
    then sources above their slots give up places, spread over their shards, and sources below theirs take them.
    """
    whole = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = aimed.where("blocks > 0").select("s", (F.col("slots") + (F.col("rest") > 0).cast("long")).alias("want")).where("want > 0")
    ranges = stored(
        wanted.withColumn("lo", F.sum("want").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("want")).withColumn("total", F.sum("want").over(whole)),
        "wanted",
    )
    width = F.floor(F.col("total") / CHUNK) + 1
    reach = ranges.select("s", "lo", (F.col("lo") + F.col("want")).alias("hi"), F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("want") - 1) / width))).alias("part"))
    places = (
        ranges.select("total").limit(1)
        .select("total", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        .withColumn("places", F.floor(F.col("total") / shards) + (F.col("shard") < F.pmod("total", F.lit(shards))).cast("long"))
        .where("places > 0")
        .select("total", "shard", "places", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("places") - 1) / CHUNK))).alias("chunk"))
        .repartition("shard", "chunk")
        .select("total", "shard", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, "places") - 1)).alias("place"))
        .withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "shard", "place"), F.col("total")))
        .withColumn("part", F.floor(F.col("at") / width))
    )
    drawn = stored(places.join(beside(reach), "part").where("at >= lo and at < hi").groupBy("shard", "s").agg(F.count("*").alias("n")), "drawn")

    per = Window.partitionBy("s")
    upto = per.orderBy(F.xxhash64(F.lit(seed), "s", "shard"), "shard").rowsBetween(Window.unboundedPreceding, 0)
    above = (
        drawn.join(beside(ranges.select("s", "want")), "s")
        .select("shard", "s", "n", "want", F.sum("n").over(upto).alias("upto"), F.sum("n").over(per).alias("got"))
        .where("got > want")
        .select("shard", "s", F.expr("(upto * (got - want)) div got - ((upto - n) * (got - want)) div got").alias("gone"))
        .where("gone > 0")
    )
    above = stored(above, "above")
    numbered = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    freed = above.groupBy("shard").agg(F.sum("gone").alias("n")).withColumn("upto", F.sum("n").over(numbered)).withColumn("all", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    freed = freed.select("shard", "all", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("x")).select("shard", permuted(F.col("x"), F.col("all"), F.xxhash64(F.lit(seed), "all")).alias("x"))
    below = ranges.join(drawn.groupBy("s").agg(F.sum("n").alias("got")), "s", "left").select("s", (F.col("want") - F.coalesce("got", F.lit(0))).alias("n")).where("n > 0")
    below = below.withColumn("upto", F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
    below = below.select("s", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("x"))
    swapped = freed.join(below, "x").select("shard", "s", F.lit(1).cast("long").alias("n"))
    exact = drawn.unionByName(above.select("shard", "s", (-F.col("gone")).alias("n"))).unionByName(swapped).groupBy("shard", "s").agg(F.sum("n").alias("n")).where("n > 0")
    first = F.sum("n").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return stored(exact.select("shard", "s", "n", first.alias("first"), before.alias("before"), F.sum("n").over(Window.partitionBy("shard")).alias("places")), "dealt")


def block_slots(aimed: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """(s, shard, slot, block, words): the source and block that each slot of an output shard reads, and words of it."""
    held = dealt(aimed, shards, seed).join(beside(aimed.select("s", "blocks", "slots", "rest")), "s")
    spread = held.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).repartition("s", "shard", "chunk")
    return (
        spread.withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, "n") - 1)))
        .withColumn("nth_slot", F.col("first") + F.col("i"))
        .select(
            "s",
            "shard",
            permuted(F.col("before") + F.col("i"), F.col("places"), F.xxhash64(F.lit(seed), F.lit("shard"), "shard")).alias("slot"),
            permuted(F.pmod("nth_slot", "blocks"), F.col("blocks"), _pass_salt(seed, F.floor(F.col("nth_slot") / F.col("blocks")))).alias("block"),
            F.when(F.col("nth_slot") < F.col("slots"), F.lit(block).cast("long")).otherwise(F.col("rest")).alias("words"),
        )
    )


def _packed(placed: DataFrame, aimed: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """(shard, slot, s, block, words, pieces): the mix; pieces are the rows (bucket, nth) that its words are of, with n."""
    end = F.col("start") + F.col("size")
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(end - F.col("block") * block, F.lit(block))
    skipped = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    # a source that isn't read whole once: blocks that no slot reads aren't moved
    read = F.when(F.col("reads") >= F.col("blocks"), True).otherwise(permuted(F.col("block"), F.col("blocks"), _pass_salt(seed, F.lit(0)), back=True) < F.col("reads"))
    pieces = (
        placed.where("size > 0")
        .select("s", "bucket", "nth", "size", "start", "blocks", "reads", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
        .where(read)
        .select("s", "block", F.struct(lo.alias("lo"), hi.alias("hi"), "bucket", "nth", F.array_join(F.slice("words", (skipped + 1).cast("int"), (hi - lo).cast("int")), " ").alias("text")).alias("piece"))
        .repartition("s", "block")
    )
    blocks = pieces.groupBy("s", "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    slots = block_slots(aimed, block, shards, seed).withColumnRenamed("words", "upto").hint("shuffle_hash")  # grows with the words: never broadcast
    text = F.array_join(F.col("pieces.text"), " ")
    taken = F.transform("pieces", lambda p: F.struct(p["bucket"].alias("bucket"), p["nth"].alias("nth"), F.greatest(F.least(p["hi"], F.col("upto")) - p["lo"], F.lit(0)).alias("n")))
    return blocks.join(slots, ["s", "block"]).select(
        "shard", "slot", "s", "block", F.when(F.col("upto") < block, F.array_join(F.slice(F.split(text, " "), 1, F.col("upto").cast("int")), " ")).otherwise(text).alias("words"), taken.alias("pieces")
    )


def mixed_blocks(docs: DataFrame, share: int = 150, most: int = 2, block: int = BLOCK, shards: int = 64, seed: int = 11) -> DataFrame:
    """The packed mix: (shard, slot, source, block, words); a shard's slots are 0, 1, ...; words are parted by a space."""
    placed, _, aimed = _numbered(docs, share, most, block)
    named = beside(aimed.select("s", "source"))
    return _packed(placed, aimed, block, shards, seed).join(named, "s").select("shard", "slot", "source", "block", "words")


def taken_words(docs: DataFrame, share: int = 150, most: int = 2, block: int = BLOCK, shards: int = 64, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of it in the packed mix, repeats counted) of every row."""
    placed, bare, aimed = _numbered(docs, share, most, block)
    mix = stored(_packed(placed, aimed, block, shards, seed), "mix", "zstd")
    taken = mix.select("s", F.explode("pieces").alias("p")).groupBy("s", "p.bucket", "p.nth").agg(F.sum("p.n").alias("taken"))
    return bare.join(taken.hint("merge"), ["s", "bucket", "nth"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", **more) -> DataFrame:
    """Whole documents of the mix: each row comes out taken / size times, the fraction rounded by a hash of its key.

    Rows that nothing is taken of go. Keeps the columns of docs; key must tell documents apart (repeats count as one).
    """
    share = taken_words(docs, **more).groupBy(F.col("doc_id").alias("mix_id")).agg(F.sum("taken").alias("mix_taken"), F.sum("size").alias("mix_size"))
    part = F.col("mix_taken") / F.col("mix_size")
    chance = F.pmod(F.xxhash64(F.lit(1), "mix_id"), F.lit(1 << 20)) / (1 << 20)
    copies = share.where("mix_taken > 0").withColumn("mix_copies", (F.floor(part) + (chance < part - F.floor(part)).cast("int")).cast("int")).where("mix_copies > 0")
    return docs.join(copies, F.col(key).eqNullSafe(F.col("mix_id"))).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*(docs[c] for c in docs.columns))
