"""Mixing sources to target weights, with DataFrame functions only.

Each source's words form one stream, packed into blocks of a fixed number of words. Every slot of an
output shard draws a source (so a shard's counts are multinomial); the draws are reconciled with the
sources' totals; a source's k-th slot takes the block that a pseudorandom permutation of its block
indexes gives; slots and blocks meet in a join on (source, block).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, save

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
SEED = 20260811
#: Rows that one window group of the offsets has, about, and the fewest groups of a source.
GROUP_ROWS, GROUPS = 10_000, 256
#: Rounds of the permutations, and steps after which a walk back into the range has ended (see permuted).
ROUNDS, WALK = 6, 64


def idiv(a: str, b: str) -> Column:
    return F.expr(f"({a}) div ({b})")


def sides(n: Column) -> tuple[Column, Column]:
    """Sides of a rectangle that holds n (1 or more) cells, with less than one row to spare."""
    a = F.ceil(F.sqrt(n.cast("double")))
    return a, F.ceil(n / a)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def rounds(x: Column, a: Column, b: Column, key: Column, inverse: bool = False) -> Column:
    """A keyed Feistel network on the numbers below a * b: x = left + a * right, where each half in turn is moved by a hash of the other."""
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        n, own, other = (F.when(even, p).otherwise(q) for p, q in ((a, b), (s["left"], s["right"]), (s["right"], s["left"])))
        by = F.pmod(F.xxhash64(other, key, k), n)
        moved = F.pmod(own - by if inverse else own + by, n)
        return F.struct(F.when(even, moved).otherwise(s["left"]).alias("left"), F.when(even, s["right"]).otherwise(moved).alias("right"))

    start = F.struct(F.pmod(x, a).alias("left"), F.floor(x / a).alias("right"))
    return bound(F.aggregate(F.array(*map(F.lit, order)), start, step), lambda s: s["left"] + a * s["right"])


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """The place of x in a pseudorandom permutation of the numbers below n (1 or more), or its inverse.

    The network permutes a rectangle; a number that it moves out of the range is moved on until it
    is inside again (cycle walking), so the numbers below n are permuted among themselves. Fewer than a row's
    cells are out of range: with up to WALK of them the walk ends for sure, with more it is longer
    with a chance below 1 in WALK ** WALK, and is an error then.
    """

    def within(s: Column) -> Column:
        a, b = s["a"], s["b"]
        on = lambda v, _: F.when(v < n, v).otherwise(rounds(v, a, b, key, inverse))
        walk = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), v, on)
        checked = lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("walk of a permutation is too long")).cast("long"))
        return bound(rounds(x, a, b, key, inverse), lambda v: F.when(v < n, v).otherwise(bound(walk(v), checked)))

    a, b = sides(n)
    return bound(F.struct(a.alias("a"), b.alias("b")), within)


def targets(sizes: DataFrame, weights: int = 3, most: int = 3) -> DataFrame:
    """Of rows (source, size): (source, s, source_size, target), s numbering the sources.

    Sources by code point, null last, weigh 1 to `weights`, repeating. Targets share all sizes by
    weight and stop at `most` times their source's size; the excess goes to the others by weight. In
    closed form: with sources by rising cap per weight, the level at a source is what the caps before
    it leave, per weight of it and those after; those whose cap is not above their level are capped,
    and the first other one's level holds for the rest.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()  # one row per source
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    rows = total.withColumn("s", (F.row_number().over(by_name) - 1).cast("long"))
    rows = rows.withColumn("w", F.pmod("s", F.lit(weights)) + 1).withColumn("cap", most * F.col("source_size"))
    up = everything.orderBy(F.col("cap") / F.col("w"), "s")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("w").over(after)).withColumn("n", F.row_number().over(up))
    free = F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct("n", "level"))
    level = F.min(free).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("w"), F.col("cap").cast("double")))
    return rows.withColumn("target", target).select("source", "s", "source_size", "target")


def locate(rows: DataFrame, ranges: DataFrame, total: int, n: int) -> DataFrame:
    """Joins rows (column ticket in [0, total)) to the one of n ranges (lo, hi) that holds the ticket.

    Ranges go to the strides of tickets that they overlap, rows to their stride, so the join is on
    equal strides: no row meets more than the ranges of one stride.
    """
    stride = max(1, total // (4 * n))
    spread = ranges.where("hi > lo").withColumn("stride", F.explode(F.sequence(idiv("lo", str(stride)), idiv("hi - 1", str(stride)))))
    return rows.withColumn("stride", idiv("ticket", str(stride))).join(spread, "stride").where("ticket >= lo and ticket < hi").drop("stride")


def running(df: DataFrame, by: str, order: str, value: str, out: str, group: str) -> DataFrame:
    """Adds out: the sum of value over the rows of `by` before this one, by (group, order).

    Sums of groups come first, then sums within groups, so no task sorts all rows of one key.
    """
    sums = df.groupBy(by, group).agg(F.sum(value).alias("__sum"))
    past = Window.partitionBy(by).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(by).alias("__by"), F.col(group).alias("__group"), F.coalesce(F.sum("__sum").over(past), F.lit(0)).alias("__base"))
    joined = df.join(base, (df[by] == base["__by"]) & (df[group] == base["__group"]))
    within = Window.partitionBy(by, group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__by", "__group", "__base")


def draw(docs: DataFrame, block_words: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """What mix returns, before it is summed up: rows of documents with s and at, the place of a row's first
    word in its source, and the pieces with at and turn, the number of the pass over the source's blocks."""
    spark, L = docs.sparkSession, block_words
    base = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("content"), n_words(F.col("text")).alias("size")))
    n_rows = base.count()
    groups = max(GROUPS, -(-n_rows // GROUP_ROWS))
    plan = targets(base)
    plan = plan.withColumn("words", F.round("target").cast("long")).withColumn("nb", idiv(f"source_size + {L - 1}", str(L)))
    plan = plan.withColumn("key", F.xxhash64("s", F.lit(seed)))
    # The turn of the last block, the one that lacks some words.
    plan = plan.withColumn("short_at", F.when(F.col("nb") > 0, permuted(F.greatest(F.col("nb"), F.lit(1)) - 1, F.greatest(F.col("nb"), F.lit(1)), F.col("key"), inverse=True)))
    plan = plan.withColumn("short", L * F.col("nb") - F.col("source_size"))  # what the last block lacks
    plan = plan.withColumn("passes", F.expr("if(source_size > 0, words div source_size, 0)")).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    last = F.when(F.col("rest") <= L * F.col("short_at"), idiv(f"rest + {L - 1}", str(L))).otherwise(idiv(f"rest + short + {L - 1}", str(L)))
    plan = plan.withColumn("slots", F.coalesce(F.col("passes") * F.col("nb") + last, F.lit(0)))
    plan = save(plan.withColumn("hi", F.sum("slots").over(Window.partitionBy().orderBy("s"))).withColumn("lo", F.col("hi") - F.col("slots")))
    n_sources, n_slots = plan.agg(F.count("*"), F.coalesce(F.max("hi"), F.lit(0))).first()
    docs_at = base.join(plan.select(F.col("source").alias("src"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    docs_at = docs_at.withColumn("salt", F.pmod(F.xxhash64("doc_id", "content"), F.lit(groups)))
    docs_at = docs_at.withColumn("order", F.struct(F.col("doc_id"), F.col("content"), F.col("size")))
    docs_at = save(running(docs_at, "s", "order", "size", "at", "salt").drop("order"))

    numbers = spark.range(n_slots).select(idiv("id", str(shard_slots)).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n_slots))).alias("ticket"))
    share = plan.select("s", "lo", "hi")
    drawn = locate(numbers, share, n_slots, max(1, n_sources)).groupBy("s", "shard").agg(F.count("*").alias("n"))
    drawn = save(running(drawn.withColumn("group", idiv("shard", "4096")), "s", "shard", "n", "k", "group").select("s", "shard", "k", "n"))
    # Draws beyond a source's slots go, in order, to the sources that were drawn too seldom.
    got = drawn.groupBy("s").agg(F.sum("n").alias("got"))
    got = plan.select("s", "slots").join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    order = Window.partitionBy().orderBy("s")
    got = got.withColumn("over", F.greatest(F.lit(0), F.col("got") - F.col("slots"))).withColumn("under", F.greatest(F.lit(0), F.col("slots") - F.col("got")))
    got = save(got.withColumn("over_at", F.sum("over").over(order) - F.col("over")).withColumn("under_at", F.sum("under").over(order) - F.col("under")))
    n_over = got.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    draws = drawn.join(got, "s")
    kept = draws.where("k < slots").select("s", "shard", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + F.col("n"), F.col("slots")) - 1)).alias("k"))
    spare = draws.where("k + n > slots").select("shard", F.explode(F.sequence(F.greatest("k", "slots"), F.col("k") + F.col("n") - 1)).alias("k"), "over_at", "slots")
    spare = spare.select("shard", (F.col("over_at") + F.col("k") - F.col("slots")).alias("ticket"))
    need = got.select("s", "got", F.col("under_at").alias("lo"), (F.col("under_at") + F.col("under")).alias("hi"))
    moved = locate(spare, need, n_over, max(1, n_sources)).select("s", "shard", (F.col("got") + F.col("ticket") - F.col("lo")).alias("k"))
    slots = kept.unionByName(moved).join(plan.select("s", "nb", "key", "short_at", "short", "passes", "rest"), "s")
    slots = slots.withColumn("turn", idiv("k", "nb")).withColumn("j", F.pmod("k", F.col("nb"))).withColumn("block", permuted(F.col("j"), F.col("nb"), F.col("key")))
    before = L * F.col("j") - F.when(F.col("j") > F.col("short_at"), F.col("short")).otherwise(0)
    slots = slots.withColumn("take", F.when(idiv("k", "nb") < F.col("passes"), F.lit(L)).otherwise(F.greatest(F.lit(0), F.least(F.lit(L), F.col("rest") - before))))
    pieces = docs_at.where("size > 0").withColumn("block", F.explode(F.sequence(idiv("at", str(L)), idiv("at + size - 1", str(L)))))
    first = F.greatest(F.col("at"), L * F.col("block"))
    pieces = pieces.select("s", "block", "doc_id", "content", "at", (first - L * F.col("block")).alias("offset"), (first - F.col("at")).alias("start"), (F.least(F.col("at") + F.col("size"), L * (F.col("block") + 1)) - first).alias("length"))
    mixed = slots.select("shard", "s", "k", "turn", "block", "take").join(pieces, ["s", "block"]).withColumn("words", F.greatest(F.lit(0), F.least("length", F.col("take") - F.col("offset")))).where("words > 0")
    return docs_at, mixed.select("shard", "s", "k", "turn", "block", "doc_id", "content", "at", "start", "words")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of docs (doc_id, text, source): a row per document, and the mix itself.

    First: doc_id, source, content (hash of the text), size, source_size, target, taken. Second, a row
    for each piece of a document in a slot: shard, s, k (the source's slot), block, doc_id, content, start
    (first word of the piece in its document), words.

    A source takes round(target) words: whole passes over its blocks, then blocks in permuted order
    with the last one cut. As no target is over 3 times its source's size, no word is taken more than
    3 times. Documents without words (null or empty text) are taken 0 times; equal rows count as rows
    of their own; an empty table gives an empty mix. Equal input and seed give an equal mix.
    """
    docs_at, mixed = draw(docs, block_words, shard_slots, seed)
    taken = mixed.groupBy(F.col("s").alias("ts"), F.col("at").alias("tat")).agg(F.sum("words").alias("taken"))
    joined = docs_at.join(taken, (F.col("size") > 0) & (F.col("s") == F.col("ts")) & (F.col("at") == F.col("tat")), "left")
    per_doc = joined.select("doc_id", "source", "content", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return per_doc, mixed.drop("at", "turn")


def runs(mixed: DataFrame) -> DataFrame:
    """(s, at, runs) of each row that the mix takes words of: its pieces as (start, words), those that adjoin in one pass as one."""
    past = Window.partitionBy("s", "at", "turn").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    gap = mixed.withColumn("gap", F.col("start") - F.coalesce(F.sum("words").over(past), F.lit(0)))
    run = gap.groupBy("s", "at", "turn", "gap").agg(F.min("start").alias("start"), F.sum("words").alias("words"))
    return run.groupBy("s", "at").agg(F.sort_array(F.collect_list(F.struct("turn", "start", "words"))).alias("runs"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """The documents that the mix asks for, with the columns of docs: its drawn pieces as texts.

    A whole pass over a document's blocks gives the document whole. Of a pass that draws some of them,
    each run of adjoining pieces gives a row: the text from the white space before its first word to
    the end of its last. n_chars, if docs has it, is that of the new text. Documents without words are not in
    the mix. Words that a mix takes are so kept, each as often as it is drawn.
    """
    if "content" in docs.columns:  # a clashing name steps aside
        return apply_mix(docs.withColumnRenamed("content", "__own_content")).withColumnRenamed("__own_content", "content").select(*docs.columns)
    docs_at, mixed = draw(docs, BLOCK_WORDS, SHARD_SLOTS, SEED)
    # Two hashes of the row stand for it; one alone is the join key, so that texts are shuffled once.
    row = ["doc_id", "source", "content"]
    key = [F.xxhash64(F.col("doc_id").cast("long"), "source", "content"), F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), "source", "content")]
    share = docs_at.where("size > 0").join(runs(mixed), ["s", "at"]).withColumn("__n", F.row_number().over(Window.partitionBy(*row).orderBy("at")))
    share = share.select(key[0].alias("__s1"), key[1].alias("__s2"), "__n", F.col("size").alias("__size"), F.col("runs").alias("__runs"))
    rows = docs.withColumn("content", F.xxhash64("text")).withColumns({"__k1": key[0], "__k2": key[1]}).repartition("__k1")
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy("content")))
    on = (rows["__k1"] == share["__s1"]) & (rows["__k2"] - share["__s2"] == 0) & (rows["__nth"] - share["__n"] == 0)
    out = rows.join(share, on)
    whole = lambda r: r["words"] == F.col("__size")
    words = F.when(F.exists("__runs", lambda r: ~whole(r)), F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)))
    part = lambda w, r: F.array_join(F.slice(w, (r["start"] + 1).cast("int"), r["words"].cast("int")), "")
    # As the element of an array, the words are taken out once and not for each run.
    texts = F.transform(F.array(words), lambda w: F.transform("__runs", lambda r: F.when(whole(r), F.col("text")).otherwise(part(w, r))))[0]
    out = out.withColumn("text", F.explode(texts))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
