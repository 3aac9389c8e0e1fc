"""Mixing sources to target weights, with DataFrame operations only.

Sizes are words. Each source's target is its share of all words by weight, but at most ``limit`` times
what it has; what that leaves over goes to the others by weight until none is above (:func:`targets`).
A source is drawn in passes. Its documents fall into ``blocks`` blocks by hash; a whole pass draws every
block, the last pass draws blocks in permuted order until the quota of words is met, the last block up
to a document and the last document up to a word; :func:`mixed` and :func:`mix` draw that one whole or not at all. What is drawn is thus a number of (source, pass, block)
units, the source's exact block quota.

Those quotas go to ``2**depth`` output shards by a splitting tree (:func:`split_quotas`): each node deals
half of its units to its left child by a multivariate hypergeometric draw and the rest to its right one.
A source's permuted units are then cut into disjoint runs of the shards' sizes. :func:`draw` gives each
drawn document its shard and its place there, a hash; :func:`mixed` and :func:`mix` partition the mixed
documents by shard and shuffle each shard locally, by sorting it by place.

Every random choice is an MD5 of the seed and of what it is about, so reruns agree. A null text has size
0; null and empty sources are sources of their own, null last. Documents without words are never drawn.
Rows that are equal in doc_id and size are drawn each, in either order. An empty
table gives an empty result. Columns of other names are left alone, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.store import cut, free

WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, limit: int = 3) -> DataFrame:
    """(source, source_size) with rank, weight and target added; one row per source."""
    every, by_code = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(by_code)).withColumn("weight", 1 + (F.col("rank") - 1) % 3)
    s = s.withColumns({"_total": F.sum("source_size").over(every), "_weights": F.sum("weight").over(every)})
    tightest = Window.orderBy(F.col("source_size").cast("double") / F.col("weight"), "rank")
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    level = lambda held, weights: (F.col("_total") - limit * held).cast("double") / (F.col("_weights") - weights)
    s = s.withColumn("_level", level(F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("_held", F.col("_level") * F.col("weight") > limit * F.col("source_size"))
    held = lambda c: F.coalesce(F.sum(F.when(F.col("_held"), F.col(c))).over(every), F.lit(0))
    s = s.withColumn("_last", level(held("source_size"), held("weight")))
    target = F.when(F.col("_held"), (limit * F.col("source_size")).cast("double")).otherwise(F.col("_last") * F.col("weight"))
    return s.select("source", "source_size", "rank", "weight", target.alias("target"))


def _draw(population: str, good: str, draws: str, uniform: str) -> str:
    """SQL for one hypergeometric draw by inversion, its outcomes weighed outwards from the mode."""
    low, high = f"greatest(0L, {draws} - ({population} - {good}))", f"least({good}, {draws})"
    mode = f"least({high}, greatest({low}, cast(floor(({draws} + 1D) * ({good} + 1D) / ({population} + 2D)) as bigint)))"
    up = f"a.w * ({good} - x + 1D) * ({draws} - x + 1D) / (x * cast({population} - {good} - {draws} + x as double))"
    down = f"b.w * (x + 1D) * cast({population} - {good} - {draws} + x + 1 as double) / (({good} - x) * cast({draws} - x as double))"
    step = lambda s, w: f"transform(array({w}), w -> named_struct('w', w, 's', {s}.s + w, 'x', if({s}.x < 0 and pick < {s}.s + w, x, {s}.x)))[0]"
    walk = f"""aggregate(if(z.m < {high}, sequence(z.m + 1, {high}), array()), named_struct('w', 1D, 's', 1D, 'x', if(pick < 1D, z.m, -1L)), (a, x) -> {step("a", up)},
        a -> aggregate(if(z.m > {low}, sequence(z.m - 1, {low}), array()), named_struct('w', 1D, 's', a.s, 'x', a.x), (b, x) -> {step("b", down)}))"""
    return f"""transform(array(named_struct('m', {mode})), z -> transform(
        transform(array({uniform} * transform(array(double('infinity')), pick -> {walk}.s)[0]), pick -> {walk}.x), x -> if(x < 0, z.m, x))[0])[0]"""


def split_quotas(quotas: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """(rank, units) to (shard, rank, units): every shard's exact quota of each source's units.

    The sources' quotas are one array, so there must be no more of them than fit in a row; null or empty
    quotas give no rows.
    """
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "units"))).alias("q")).where(F.size("q") > 0)
    tree = tree.select(F.lit(1).alias("node"), F.expr("transform(q, x -> x.rank)").alias("ranks"), F.expr("transform(q, x -> x.units)").alias("q"))
    uniform = f"cast(conv(substr(md5(concat_ws('|', 'tree', '{seed}', node, i)), 1, 13), 16, 10) as double) / 4503599627370496D"
    deal = f"""aggregate(sequence(1, size(q)), named_struct('rest', aggregate(q, 0L, (s, x) -> s + x), 'left', aggregate(q, 0L, (s, x) -> s + x) div 2, 'got', cast(array() as array<bigint>)),
        (t, i) -> transform(array({_draw("t.rest", "q[i - 1]", "t.left", uniform)}), y -> named_struct('rest', t.rest - q[i - 1], 'left', t.left - y, 'got', array_append(t.got, y)))[0], t -> t.got)"""
    for _ in range(depth):
        tree = cut(tree.withColumn("l", F.expr(deal)))
        sides = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("l").alias("q")), F.struct((2 * F.col("node") + 1).alias("node"), F.expr("transform(q, (x, i) -> x - l[i])").alias("q")))
        tree = tree.select("ranks", F.explode(sides).alias("s")).select("s.node", "ranks", "s.q")
    parts = tree.select((F.col("node") - 2**depth).alias("shard"), F.explode(F.arrays_zip("ranks", "q")).alias("p"))
    return parts.select("shard", F.col("p.ranks").alias("rank"), F.col("p.q").alias("units"))


def _md5(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts)))


def _keyed(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """``docs`` with _size, _h (what ranks a document) and _block."""
    df = docs.withColumn("_size", size(F.col("text")))
    df = df.withColumn("_h", _md5(f"doc|{seed}", F.col("doc_id"), F.col("_size")))
    return df.withColumn("_block", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % blocks).cast("int"))


def _quotas(items: DataFrame, limit: int, depth: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of (source, _size, _block): (source, source_size, target, passes, rest), and (source, _block, units, partial).

    ``units`` lists (pass, shard, room): the words that a pass has for the block, and the shard that draws
    it; partial: one of them is less than the block's size.
    """
    sources = targets(items.groupBy("source").agg(F.sum("_size").alias("source_size")), limit)
    quota = F.floor(F.col("target") + 0.5)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long"))
    sources = cut(sources.withColumn("rest", (quota - F.col("passes") * F.col("source_size")).cast("long")))

    sizes = items.groupBy("source", "_block").agg(F.sum("_size").alias("block_size")).where("block_size > 0")
    units = _beside(sizes, sources).withColumn("pass", F.explode(F.expr("sequence(0L, passes)")))
    order = _md5(f"block|{seed}", F.col("rank"), F.col("pass"), F.col("_block"))
    in_pass = Window.partitionBy("rank", "pass").orderBy(order, "_block").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("before", F.coalesce(F.sum("block_size").over(in_pass), F.lit(0)))
    units = units.withColumn("room", F.when(F.col("pass") < F.col("passes"), F.col("block_size")).otherwise(F.least(F.col("block_size"), F.col("rest") - F.col("before")))).where("room > 0")
    numbered = F.row_number().over(Window.partitionBy("rank").orderBy("pass", order, "_block")).cast("long")
    units = cut(units.withColumn("unit", numbered).select("source", "_block", "rank", "pass", "unit", "room", "block_size"))

    shards = split_quotas(units.groupBy("rank").agg(F.count("*").alias("units")), depth, seed)
    ends = F.sum("units").over(Window.partitionBy("rank").orderBy("shard"))
    runs = shards.withColumn("last", ends).where("units > 0").select("rank", "shard", F.explode(F.expr("sequence(last - units + 1, last)")).alias("unit"))
    dealt = units.join(runs, ["rank", "unit"]).groupBy("source", "_block")
    return sources, cut(dealt.agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "room"))).alias("units"), F.max(F.col("room") < F.col("block_size")).alias("partial")))


def _beside(df: DataFrame, small: DataFrame, *more: str, most: int = 200_000) -> DataFrame:
    """``df`` with the columns of ``small`` for its source (and ``more``); sent whole if it has at most ``most`` rows."""
    small = small.withColumnsRenamed({c: f"_r_{c}" for c in ("source", *more)})
    small = F.broadcast(small) if small.limit(most + 1).count() <= most else small
    same = F.col("source").eqNullSafe(F.col("_r_source"))
    for c in more:
        same &= F.col(c) == F.col(f"_r_{c}")
    return df.join(small, same, "left").drop("_r_source", *(f"_r_{c}" for c in more))


def _drawn(df: DataFrame, before: Column, seed: int) -> DataFrame:
    """With ``_drawn``: (pass, shard, words, place) of each time that a document is drawn."""
    return df.withColumn("_before", before).withColumn("_drawn", F.expr(f"""filter(transform(coalesce(units, array()), u -> named_struct('pass', u.pass, 'shard', u.shard,
        'words', greatest(0L, least(_size, u.room - _before)), 'place', md5(concat_ws('|', 'place', '{seed}', u.pass, _h)))), x -> x.words > 0)""")).drop("_before")


def _in_block() -> Column:
    """Words of the documents before this one in its block."""
    w = Window.partitionBy("source", "_block").orderBy("_h", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_size").over(w), F.lit(0))


def draw(docs: DataFrame, limit: int = 3, blocks: int = 1024, depth: int = 4, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and ``drawn``.

    ``drawn`` lists (pass, shard, words, place): how many of the document's words that pass takes, from
    its beginning, into which output shard, and the place to sort that shard by.
    """
    items = cut(_keyed(docs.select("doc_id", "source", "text"), blocks, seed).drop("text"))
    sources, dealt = _quotas(items, limit, depth, seed)
    out = _drawn(_beside(_beside(items, dealt, "_block"), sources.select("source", "source_size", "target")), _in_block(), seed)
    taken = F.expr("aggregate(_drawn, 0L, (s, x) -> s + x.words)")
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), F.col("_drawn").alias("drawn"))


PLACE = ("_shard", "_pass", "_place")


def mixed(docs: DataFrame, limit: int = 3, blocks: int = 1024, depth: int = 4, seed: int = 0) -> DataFrame:
    """The mixed documents: the columns of ``docs`` and PLACE, a row for each time that a document is drawn.

    Rows are partitioned by shard and by the first digits of their place, so that a shard can be of any
    size, and sorted by shard and place in each partition. Where ``docs`` has a column of such a name, the
    added one's gets one more underscore. Texts are whole: a document of which a pass takes only the first words is drawn
    if they are at least half of it, so each source stays within half a document of its quota for each such pass.
    """
    names = docs.columns
    sources, dealt = _quotas(cut(_keyed(docs.select("doc_id", "source", "text"), blocks, seed).drop("text")), limit, depth, seed)
    placed = _beside(_keyed(docs.withColumnsRenamed({c: f"_c_{c}" for c in names if c not in ("doc_id", "source", "text")}), blocks, seed), dealt, "_block")
    whole = _drawn(placed.where("units is not null and not partial"), F.lit(0).cast("long"), seed)
    whole = whole.withColumn("_drawn", F.expr("transform(_drawn, x -> named_struct('pass', x.pass, 'shard', x.shard, 'words', _size, 'place', x.place))"))
    kept = whole.unionByName(_drawn(placed.where("units is not null and partial"), _in_block(), seed)).withColumn("_one", F.explode("_drawn"))
    kept = kept.where(2 * F.col("_one.words") >= F.col("_size"))
    own = [F.col(c if c in ("doc_id", "source", "text") else f"`_c_{c}`").alias(c) for c in names]
    shard, turn, place = (free(c, names) for c in PLACE)
    out = kept.select(*own, F.col("_one.shard").alias(shard), F.col("_one.pass").alias(turn), F.col("_one.place").alias(place))
    return out.repartition(F.col(shard), F.substring(place, 1, 2)).sortWithinPartitions(shard, place, "doc_id")


def mix(docs: DataFrame, limit: int = 3, blocks: int = 1024, depth: int = 4, seed: int = 0) -> DataFrame:
    """As :func:`mixed`, in the same partitions and order, with the columns of ``docs`` alone."""
    return mixed(docs, limit, blocks, depth, seed).drop(*(free(c, docs.columns) for c in PLACE))
