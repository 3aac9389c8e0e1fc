"""Best-fit packing into bins of several permitted capacities.

A document's length is its words and one end mark, so an empty or null text has length 1. Longer ones
than the largest capacity are cut into pieces of that capacity and a rest. Pieces are dealt by hash into
shards of about ``per_shard`` pieces, and each shard is packed by itself (:func:`pack`), so memory is
bounded whatever the table's size; a shard leaves a few bins partly empty.

Within a shard pieces go by decreasing length, then doc_id (null first), piece, and start. A piece goes
where it fits best: the open bin with the least room that holds it. Where none does, the permitted size
of least cost opens, the cost being that of the capacity (``capacity + overhead``, or what ``costs`` says) per token that
the bin would come to hold: the piece, and what the longest pieces still to come that fit would fill of the rest, the capacity being that
after downsizing. At the end each bin is downsized to the least permitted capacity that holds its contents.
A greedy look ahead is not always best, so a shard is packed by a few ways to choose sizes, and the
cheapest packing stays (:func:`pack_jointly`). Repeated rows are packed each by itself, and dealt to shards
each by itself. The result is the same however the rows are partitioned. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.mixing import size
from tidepanel.llm.store import saved

CAPACITIES = (1024, 2048, 4096)


def prices(capacities: tuple[int, ...], overhead: int, costs: tuple[float, ...] | None = None) -> dict[int, float]:
    """What a bin of each capacity costs; a smaller one must not cost more than a larger one, or downsizing would not pay."""
    price = dict(zip(capacities, costs, strict=True)) if costs is not None else {c: c + overhead for c in capacities}
    if sorted(price.values()) != [price[c] for c in sorted(price)]:
        raise ValueError("costs must not fall as capacities rise")
    return price


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = 64, look: bool = False, only: int = 0, costs: tuple[float, ...] | None = None) -> tuple[list[int], list[int], dict[int, int]]:
    """Bins and offsets of pieces in the given order, and each bin's capacity after downsizing.

    ``look``: a bin's size is chosen by what the pieces still to come would fill of it, best fit first, and
    by the capacity it is then downsized to. ``only``: pieces that fit open bins of that size. ``costs``: what a bin of each
    of ``capacities`` costs.
    """
    price = prices(capacities, overhead, costs)
    sizes, left = sorted(capacities), sum(lengths)
    counts: Counter[int] = Counter(lengths) if look else Counter()
    to_come = sum(1 << n for n in counts)  # bit n is set if a piece of length n is still to come
    open_bins: dict[int, list[int]] = defaultdict(list)  # by room
    rooms = 0  # bit r is set if a bin with room r is open
    bins, offsets, used, opened = [], [], [], []

    def filled(room: int) -> int:
        """How much of ``room`` the longest pieces to come that fit would take."""
        rest, mask = room, to_come
        while fit := mask & (1 << rest + 1) - 1:
            n = fit.bit_length() - 1
            rest -= n * min(counts[n], rest // n)
            mask = fit ^ 1 << n
        return room - rest

    def cost(c: int, n: int) -> tuple[float, int]:
        held = n + filled(c - n)
        return price[next(s for s in sizes if s >= held)] / held, c

    for n in lengths:
        left -= n
        if look:
            counts[n] -= 1
            if not counts[n]:
                to_come ^= 1 << n
        fits = rooms >> n << n
        if fits:
            room = (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            if only >= n:
                room = only
            elif look:
                room = min(cost(c, n) for c in sizes if c >= n)[1]
            else:
                room = min((c for c in sizes if c >= n), key=lambda c: (price[c] / (n + min(c - n, left)), c))
            b = len(used)
            used.append(0)
            opened.append(room)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if room > n:
            open_bins[room - n].append(b)
            rooms |= 1 << room - n
    return bins, offsets, {b: next(c for c in sizes if c >= u) for b, u in enumerate(used)}


def pack_jointly(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = 64, costs: tuple[float, ...] | None = None) -> tuple[list[int], list[int], dict[int, int]]:
    """The cheapest of several best-fit packings, by the sum of the bins' costs.

    Sizes are chosen by looking ahead, by what is left in all, or are one size throughout.
    """
    tries = [{"look": True}, {}, *({"only": c} for c in capacities)]
    price = prices(capacities, overhead, costs)
    return min((pack(lengths, capacities, overhead, **t, costs=costs) for t in tries), key=lambda p: sum(price[c] for c in p[2].values()))


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = 64, per_shard: int = 4096, costs: tuple[float, ...] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, bin_offset, bin_capacity, bin_used."""
    largest = max(capacities)
    lengths = docs.select("doc_id", (size(F.col("text")) + 1).alias("n"))
    lengths = saved(lengths.groupBy("doc_id", "n").agg(F.count("*").alias("copies")), "lengths")  # equal rows are told apart by a number
    shards = max(1, -(-(lengths.agg(F.sum(F.col("copies") * F.ceil(F.col("n") / largest))).first()[0] or 0) // per_shard))
    again = lengths.select("doc_id", "n", F.explode(F.expr("sequence(1L, copies)")).alias("again"))
    at = F.explode(F.expr(f"sequence(0L, n - 1, {largest}L)"))
    pieces = again.select("doc_id", "n", "again", at.alias("start"))
    pieces = pieces.select("doc_id", F.floor(F.col("start") / largest).alias("piece"), "start", F.least(F.col("n") - F.col("start"), F.lit(largest)).alias("length"), "n", "again")
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "n", "again"), F.lit(shards)))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "piece", "start", "n", "again"], ascending=[False, True, True, True, True, True], na_position="first", kind="stable")
        bins, offsets, sizes = pack_jointly(p["length"].tolist(), capacities, overhead, costs)
        p["bin_id"] = p["shard"].to_numpy() * 2**32 + pd.array(bins)
        p["bin_offset"], p["bin_capacity"] = offsets, [sizes[b] for b in bins]
        p["bin_used"] = p.groupby("bin_id")["length"].transform("sum")
        return p.drop(columns=["shard", "n", "again"])

    kind = dict(docs.dtypes)["doc_id"]
    return dealt.groupBy("shard").applyInPandas(run, f"doc_id {kind}, piece long, start long, length long, bin_id long, bin_offset long, bin_capacity long, bin_used long")
