"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Sources, in code-point order and null last, weigh 1, 2, 3, 1, 2, 3 ... of all words; a target
   stops at `most` times its source's size and the excess is shared again by weight (water filling,
   solved in closed form over the sources sorted by the level at which they fill up).
2. Blocks. Documents fall by hash into blocks of about `block_words` words of their source. A target
   takes whole passes over its source and, for what is left, the first blocks of a hashed permutation;
   the last of these is taken up to the word. So block quotas are exact and blocks are disjoint.
3. Splitting tree. The block quotas of all sources are split among the output shards by recursive
   halving: the left child's share of each source is hypergeometric given what is left (seeded
   by node and source, so that reruns agree), down to exact quotas for each source and shard.
   Each shard takes its disjoint slice of each source's permuted blocks and shuffles them by hash.

Nothing gathers all sources or all shards: ranks, water level and slices are prefix sums over ranges, and a
node of the tree holds at most `group` sources. More sources form groups of groups: a shard's share of a group
is split among its members by the same tree, which is the same distribution. Prefix sums of documents go in
three short levels (nodes of a source, blocks of a node, documents of a block), so that a source with a third of
all rows is never one task's window.

Defined results. Null text counts 0 words and is taken 0 times; a null source is a source of its own;
no rows give no rows; repeated rows take part one by one (which of two rows of equal id and text is taken is
not told apart), and rows of one id with different texts are told apart by their text. Columns of any name pass
through untouched, but for size, source_size, target, taken and copies, which give way to the operator's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, n_words, running, table, unwrapped, wrapped, written

SEED, SHARDS, MOST, BLOCK_WORDS, WEIGHTS, GROUP = 20240601, 16, 3, 32_768, (1, 2, 3), 64
SHARD_WORDS = 16_000_000
_COPIES = "array<struct<shard:int,words:bigint,place:bigint>>"


def _key(source: Column) -> Column:
    """Sorts as the sources do, null last."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2**52)) + 0.5) / float(2**52)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """skey, ord, source_size, target: one row a source, numbered in the order of their names."""
    sizes = running(sized.groupBy("skey").agg(F.sum("size").alias("source_size")), ["skey"], ord=F.lit(1))
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("ord"), F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("fills", most * F.col("source_size") / F.col("weight"))
    s = written(running(s, ["fills", "skey"], filled=most * F.col("source_size"), lighter=F.col("weight")))
    size, weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    level = (F.lit(size) - F.col("filled")) / (F.lit(weight) - F.col("lighter"))
    top = s.agg(F.max(F.when(level <= F.col("fills"), level))).first()[0]  # none: every source is taken `most` times
    target = F.least(F.lit(math.inf if top is None else float(top)) * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return s.select("skey", "ord", "source_size", target.alias("target"))


def _hypergeometric(k: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` out of `total` fall on `k` of them, from a uniform of 52 bits: exact inversion.

    The outcomes are walked from the mode outwards, by exact ratios of neighbours: once to add up their weights, once
    to find the outcome. The walk ends 40 values and ten standard deviations from the mode; what lies beyond has
    less than 2**-53 of the probability (Bernstein), which no uniform of 52 bits can tell.
    """
    low, high = F.greatest(F.lit(0), draws - (total - k)), F.least(k, draws)
    mode = F.greatest(low, F.least(high, F.expr("CAST(0 AS BIGINT)") + F.floor((draws + 1) * (k + 1) / (total + 2)))).cast("long")
    some = F.greatest(total, F.lit(1))
    sd = F.sqrt(F.greatest(F.lit(0.0), draws * k / some * (1 - k / some) * (total - draws) / F.greatest(total - 1, F.lit(1))))
    steps = F.least(F.ceil(40 + 10 * sd), F.greatest(high - mode, mode - low)).cast("int")
    walk = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))

    def up(x: Column, w: Column) -> Column:
        return F.when(x < high, w * (k - x) * (draws - x) / ((x + 1) * (total - k - draws + x + 1)).cast("double")).otherwise(0.0)

    def down(x: Column, w: Column) -> Column:
        return F.when(x > low, w * x * (total - k - draws + x) / ((k - x + 1) * (draws - x + 1)).cast("double")).otherwise(0.0)

    def moved(t: Column) -> list[Column]:
        return [(t.xu + 1).alias("xu"), up(t.xu, t.wu).alias("wu"), (t.xd - 1).alias("xd"), down(t.xd, t.wd).alias("wd")]

    def start(goal: Column) -> Column:
        here = [mode.alias("xu"), F.lit(1.0).alias("wu"), mode.alias("xd"), F.lit(1.0).alias("wd")]
        return F.struct(*here, goal.alias("sum"), F.when(goal <= 0, mode).alias("x"))

    def added(t: Column, _: Column) -> Column:
        return F.transform(F.array(F.struct(*moved(t))), lambda n: F.struct(n.xu.alias("xu"), n.wu.alias("wu"), n.xd.alias("xd"), n.wd.alias("wd"), (t.sum + n.wu + n.wd).alias("sum"), t.x.alias("x")))[0]

    def found(t: Column, _: Column) -> Column:
        def taken(n: Column) -> Column:
            x = F.coalesce(t.x, F.when(t.sum - n.wu <= 0, n.xu).when(t.sum - n.wu - n.wd <= 0, n.xd))
            return F.struct(n.xu.alias("xu"), n.wu.alias("wu"), n.xd.alias("xd"), n.wd.alias("wd"), (t.sum - n.wu - n.wd).alias("sum"), x.alias("x"))

        return F.transform(F.array(F.struct(*moved(t))), taken)[0]

    mass = F.aggregate(walk, start(F.lit(1.0)), added, lambda t: t.sum)
    return F.aggregate(walk, start(u * mass - 1.0), found, lambda t: F.coalesce(t.x, mode))


def splitting_tree(quotas: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """quotas (skey, ord, blocks) of n sources -> (skey, shard, n): how many of its blocks a source gives to a shard, where any.

    The tree's nodes are rows with an array over at most `group` sources, or groups of sources: log2(shards)
    levels of rows for each level of groups. A node that holds no block has no row.
    """
    if shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    depth, height, known = int(math.log2(shards)), 1, None
    while group**height < n:
        height += 1
    for h in range(height - 1, -1, -1):
        items = quotas.groupBy(F.expr(f"ord div {group**h}L").alias("id")).agg(F.sum("blocks").cast("long").alias("n")).where("n > 0")
        nodes = items.groupBy(F.expr(f"id div {group}L").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("q")).select("parent", F.lit(1).cast("long").alias("node"), "q")
        for d in range(depth):
            total = F.aggregate("q", F.lit(0).cast("long"), lambda t, s: t + s.n)
            if known is None:
                nodes = nodes.select("parent", "node", "q", total.alias("total"), F.expr("0L").alias("draws")).withColumn("draws", F.expr("(total + 1) div 2"))
            else:  # the parent's own tree says how many fall to the left
                left = known.groupBy("parent", F.shiftright("leaf", depth - d - 1).alias("child")).agg(F.sum("n").alias("draws")).where("child % 2 = 0").select("parent", F.expr("child div 2").alias("node"), "draws")
                nodes = nodes.join(left, ["parent", "node"], "left").select("parent", "node", "q", total.alias("total"), F.coalesce("draws", F.lit(0)).cast("long").alias("draws"))
            left = F.aggregate(
                "q",
                F.struct("total", "draws", F.array().cast("array<bigint>").alias("got")),
                lambda t, s: F.transform(
                    F.array(_hypergeometric(s.n, t.total, t.draws, _uniform(F.lit(seed), F.lit(h), "node", s.id))),
                    lambda x: F.struct((t.total - s.n).alias("total"), (t.draws - x).alias("draws"), F.concat(t.got, F.array(x)).alias("got")),
                )[0],
                lambda t: t.got,
            )
            nodes = nodes.select("parent", "node", "q", left.alias("left"))
            child = lambda f: F.filter(F.zip_with("q", "left", lambda s, x: F.struct(s.id.alias("id"), f(s, x).alias("n"))), lambda s: s.n > 0)
            both = F.array(
                F.struct("parent", (2 * F.col("node")).alias("node"), child(lambda s, x: x).alias("q")),
                F.struct("parent", (2 * F.col("node") + 1).alias("node"), child(lambda s, x: s.n - x).alias("q")),
            )
            nodes = nodes.select(F.inline(both)).where(F.size("q") > 0)
        known = written(nodes.select(F.col("node").alias("leaf"), F.inline("q")).select(F.col("id").alias("parent"), "leaf", "n"))
    return known.join(broadcast_if_small(quotas.select(F.col("ord").alias("parent"), "skey")), "parent").select("skey", (F.col("leaf") - shards).cast("int").alias("shard"), "n")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED, group: int = GROUP, keep: list[str] | None = None, own: bool = True) -> DataFrame:
    """docs (or the columns to keep) with size, source_size, target, taken and copies: array<struct<shard, words, place>>.

    own=False keeps the rows wrapped (row_), for callers that need the input's columns as they are.
    """
    # words are counted once, in a table without texts; a row is known by its source and two hashes of its id and text
    same = {"skey": _key(docs["source"]), "th": F.xxhash64(docs["doc_id"], docs["text"]), "th2": F.xxhash64(F.lit(23), docs["text"], docs["doc_id"])}
    rides = keep is not None and "text" not in keep
    size = n_words(docs["text"]).alias("size")
    sized = written(wrapped(docs, keep, **same, size=size) if rides else docs.select(*[c.alias(n) for n, c in same.items()], size))
    targets = written(source_targets(sized, weights, most))
    n, words = targets.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    if shards is None:  # a power of two, so that a shard has at most about SHARD_WORDS words
        shards = max(SHARDS, 1 << math.ceil(math.log2(max(1, words / SHARD_WORDS))))
    plan = targets.withColumn("goal", F.round("target").cast("long")).withColumn("passes", F.expr("goal div greatest(source_size, 1)"))
    plan = plan.withColumn("last", F.col("goal") - F.col("passes") * F.col("source_size")).drop("goal")
    plan = plan.withColumn("n_blocks", F.greatest(F.lit(1), F.expr(f"(source_size + {block_words} - 1) div {block_words}")))
    dealt = sized.join(broadcast_if_small(plan), "skey").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "skey", "th"), F.col("n_blocks")))
    blocks = dealt.groupBy("skey", "block").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("ord", "last", "passes")))
    blocks = written(blocks.withColumn("rank", F.xxhash64(F.lit(seed + 2), "skey", "block")).withColumn("range", F.shiftright("rank", 52)))
    nodes = blocks.groupBy("skey", "range").agg(F.sum("words").alias("rw"), F.count("*").alias("rn"))
    upto = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.select("skey", "range", F.coalesce(F.sum("rw").over(upto), F.lit(0)).alias("rw"), F.coalesce(F.sum("rn").over(upto), F.lit(0)).alias("rn"))
    inner = Window.partitionBy("skey", "range").orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(nodes, ["skey", "range"]).select(
        *("skey", "ord", "block", "words", "last", "passes"),
        (F.col("rw") + F.coalesce(F.sum("words").over(inner), F.lit(0))).alias("before"),
        (F.col("rn") + F.row_number().over(Window.partitionBy("skey", "range").orderBy("rank", "block")) - 1).alias("place"),
    )
    # the blocks drawn last are the first places of the permutation, empty ones among them
    blocks = written(blocks.withColumn("drawn", F.col("before") < F.col("last")).withColumn("part", F.greatest(F.lit(0), F.least("words", F.col("last") - F.col("before")))))
    per = blocks.groupBy("skey", "ord").agg(F.count("*").alias("held"), F.first("passes").alias("passes"), F.count_if("drawn").alias("drawn"))
    per = written(per)
    slices = splitting_tree(per.select("skey", "ord", (F.col("passes") * F.col("held") + F.col("drawn")).alias("blocks")), n, shards, seed, group)
    ahead = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("from", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    slots = slices.select("skey", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("slot"))
    taken = F.col("passes") + F.when(F.col("drawn"), 1).otherwise(0)
    uses = blocks.where(taken > 0).join(broadcast_if_small(per.select("skey", "held")), "skey").select("skey", "block", "held", "place", F.explode(F.sequence(F.lit(0).cast("long"), taken - 1)).alias("pass"))
    uses = uses.withColumn("slot", F.col("pass") * F.col("held") + F.col("place")).join(slots, ["skey", "slot"])
    uses = uses.groupBy("skey", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x.shard).alias("shards"))
    blocks = blocks.select("skey", "block", "part").join(uses, ["skey", "block"], "left")
    # within a block, documents in hashed order; a block has about block_words words, or is one document
    toss = F.xxhash64(F.lit(seed + 3), "th")
    last = Window.partitionBy("skey", "block").orderBy("toss", "th").rowsBetween(Window.unboundedPreceding, -1)
    took = dealt.select(*sized.columns, "block", "source_size", "target", "passes", toss.alias("toss"))
    took = took.withColumn("before", F.coalesce(F.sum("size").over(last), F.lit(0))).join(blocks, ["skey", "block"])
    took = took.withColumn("rest", F.greatest(F.lit(0), F.least("size", F.col("part") - F.col("before"))))
    words = F.transform(F.coalesce("shards", F.array().cast("array<int>")), lambda s, c: F.struct(s.alias("shard"), F.when(c < F.col("passes"), F.col("size")).otherwise(F.col("rest")).alias("words"), F.xxhash64(F.lit(seed + 4), s, c, "th").alias("place")))
    copies = F.filter(words, lambda x: x.words > 0).cast(_COPIES)
    mine = ("size", "source_size", "target", "taken", "copies")
    took = took.select(*[c for c in sized.columns if c != "size"], "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("rest")).cast("long").alias("taken"), copies.alias("copies"))
    if not rides:
        took = _with_rows(wrapped(docs, keep, **same), took, list(same), mine)
    return unwrapped(took, *mine) if own else took.select("row_", *mine)


def _with_rows(rows: DataFrame, took: DataFrame, key: list[str], mine: tuple[str, ...]) -> DataFrame:
    """Each row with what was taken of it. Rows of equal id, text and source share a list, from which each takes its own; only these are numbered."""
    each = written(took.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("taken", *[c for c in mine if c != "taken"]))).alias("each")))
    one, many = each.where(F.size("each") == 1), each.where(F.size("each") > 1)
    out = rows.join(one, key).select("row_", F.col("each")[0].alias("x"))
    if not many.isEmpty():
        number = F.row_number().over(Window.partitionBy(*key).orderBy("th"))
        again = rows.join(many, key).withColumn("nth", number)
        out = out.union(again.select("row_", F.element_at("each", F.col("nth")).alias("x")))
    return out.select("row_", *[F.col("x")[c].alias(c) for c in mine])


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, in shards, the last copy cut at a word if need be."""
    out = mix_sources(docs, own=False, **options).select("row_", "size", F.explode("copies").alias("copy"))
    led = F.regexp_extract_all("row_.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(led, F.lit(1), F.col("copy.words").cast("int")), "")
    out = out.withColumn("text_", F.when(F.col("copy.words") == F.col("size"), F.col("row_.text")).otherwise(cut))
    out = out.withColumn("shard", F.col("copy.shard")).repartition("shard").sortWithinPartitions("shard", "copy.place")
    return unwrapped(out, put={next(c for c in docs.columns if c.lower() == "text"): F.col("text_")})


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    shards = F.transform("copies", lambda c: c.shard)
    return mix_sources(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))
