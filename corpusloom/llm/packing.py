"""Documents into blocks of fixed capacity (problem 4).

Documents are dealt by hash to shards of a bounded number of documents, and each shard is packed in one task. Best fit, longest first, gives the first
packing; a local search then empties bins: any two underfull bins exchange one document or two for none, one or two, always by the step that raises the sum
of squared fills most, until no step is left or a lower bound shows that no packing has fewer bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a shard, on average.
SHARD = 20_000
#: Configurations that are packed at once.
MOST_CONFIGS = 1_000
NO_ID = -(2**63)  # stands for a null id within a shard


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling length (ties: by number), each into the fullest bin that it fits."""
    bins, room, places = [], {}, []  # room -> bins with that much room; places: the rooms there are, sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        k = bisect_left(places, n)
        if k < len(places):
            r = places[k]
            b = room[r].pop()
            if not room[r]:
                del room[r], places[k]
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if r > n:
            if r - n not in room:
                insort(places, r - n)
                room[r - n] = []
            room[r - n].append(b)
    return bins


def _sums(lengths: list[int]) -> tuple[np.ndarray, dict[int, tuple[int, ...]]]:
    """The sums of one or two documents of a bin, sorted, and each sum's places in the bin: one document before two, then the first ones.

    Documents of equal length are interchangeable, so a bin has no more such sums than its capacity.
    """
    first: dict[int, tuple[int, ...]] = {}
    for k, n in enumerate(lengths):
        first.setdefault(n, (k,))
    second = {}
    for k, n in enumerate(lengths):
        if k != first[n][0]:
            second.setdefault(n, k)
    one, places = sorted(first), dict(first)
    for k, a in enumerate(one):
        if a in second:
            places.setdefault(2 * a, (first[a][0], second[a]))
        for b in one[k + 1 :]:
            places.setdefault(a + b, (first[a][0], first[b][0]))
    return np.array(sorted(places), np.int64), places


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below: Martello and Toth's second bound, which also covers the total over the capacity.

    Items longer than capacity - k can't share a bin with items of k or more, those over half a bin can't share one with each other, and items of k up to
    half a bin fit only into the room that the latter leave; the bound is the largest over all k.
    """
    s = np.sort(lengths.astype(np.int64))
    if not len(s):
        return 0
    sums = np.concatenate([[0], np.cumsum(s)])
    k = np.unique(np.concatenate([[0], s[s <= capacity // 2]]))
    half, long = np.searchsorted(s, capacity // 2, "right"), np.searchsorted(s, capacity - k, "right")
    room = (long - half) * capacity - (sums[long] - sums[half])
    rest = sums[half] - sums[np.searchsorted(s, k, "left")]
    return int((len(s) - half + np.maximum(0, -(-(rest - room) // capacity))).max())


def improve(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """The bins after the local search. Documents stay whole; the number of bins never grows.

    Any two underfull bins may exchange: one document or two of the emptier one for none, one or two of the fuller one. The emptiest bin that may have such a
    step goes first and takes the step that raises the sum of squared fills most; one without a step waits until another bin has changed. The search
    ends when no two bins have a step, or as few bins are left as any packing needs. Each step raises a bounded whole number, so it does end.
    """
    bins = [list(b) for b in bins if b]
    least = least_bins(lengths, capacity)
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    sums: dict[int, tuple] = {}  # of the bins as they are
    clock, changed, tried = 1, np.ones(len(bins), np.int64), np.zeros(len(bins), np.int64)
    left = len(bins)

    def sums_of(k: int) -> tuple[np.ndarray, dict[int, tuple[int, ...]]]:
        if k not in sums:
            one, places = _sums([int(lengths[i]) for i in bins[k]])
            sums[k] = np.concatenate([[0], one]), places
        return sums[k]

    while left > least:
        open_ = np.flatnonzero((fill > 0) & (fill < capacity))
        news = changed[open_].max() if len(open_) else 0
        rest = open_[(changed[open_] > tried[open_]) | (news > tried[open_])]
        if len(open_) < 2 or not len(rest):
            break
        p = int(rest[np.argmin(fill[rest])])
        others = open_[(open_ != p) & (fill[open_] >= fill[p])]
        if changed[p] <= tried[p]:
            others = others[changed[others] > tried[p]]
        tried[p] = clock
        if not len(others):
            continue
        give, places = sums_of(p)
        give = give[1:]
        backs = [sums_of(q)[0] for q in others.tolist()]  # what comes back: nothing, or one document or two
        of = np.repeat(np.arange(len(others)), [len(b) for b in backs])
        take, fills = np.concatenate(backs), fill[others][of]
        at = np.searchsorted(give, take + capacity - fills, "right") - 1
        gain = np.where(at >= 0, give[np.maximum(at, 0)] - take, 0)
        t = int(np.argmax(np.where(gain > 0, 2 * gain * (fills - fill[p] + gain), 0)))  # the rise of squared fills
        if gain[t] <= 0:
            continue
        q, back = int(others[of[t]]), int(take[t])
        moved = [bins[p][k] for k in places[int(give[at[t]])]]
        c = [bins[q][k] for k in sums_of(q)[1][back]] if back else []
        bins[p] = [i for i in bins[p] if i not in moved] + c
        bins[q] = [i for i in bins[q] if i not in c] + moved
        fill[p] -= int(gain[t])
        fill[q] += int(gain[t])
        clock += 1
        changed[p] = changed[q] = clock
        left -= not bins[p]
        del sums[p], sums[q]
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; no item may be longer than the capacity."""
    return improve(lengths, best_fit(lengths, capacity), capacity) if len(lengths) else []


def _shard(t: pa.Table) -> pa.Table:
    name, shard, capacity = t.column("config_name")[0].as_py(), t.column("shard")[0].as_py(), t.column("block_size")[0].as_py()
    ids = t.column("id").fill_null(NO_ID).to_numpy()
    order = np.lexsort((t.column("n").to_numpy(), ids))
    ids, n = ids[order], t.column("n").to_numpy()[order]
    whole = n // capacity * (n > capacity)  # full blocks of documents that alone exceed a block
    tail = n - whole * capacity
    rows, block = [], shard << 32
    for k in np.flatnonzero(whole).tolist():
        for part in range(int(whole[k])):
            rows.append((block, ids[k], part, 0, capacity))
            block += 1
    keep = np.flatnonzero(tail)
    for members in pack(tail[keep], capacity):
        at = 0
        for m in members:
            k = int(keep[m])
            rows.append((block, ids[k], int(whole[k]), at, int(tail[k])))
            at += int(tail[k])
        block += 1
    c = list(zip(*rows)) or [[]] * 5
    return pa.table({"config_name": pa.array([name] * len(rows), pa.string()), "block_id": pa.array(c[0], pa.int64()), "doc_id": pa.array([None if x == NO_ID else int(x) for x in c[1]], pa.int64()), "part": pa.array(c[2], pa.int32()), "start": pa.array(c[3], pa.int32()), "tokens": pa.array(c[4], pa.int32())})


def packed(lengths: DataFrame, configs: DataFrame, shards: int) -> DataFrame:
    """(config_name, block_id, doc_id, part, start, tokens): where each document lies, for each configuration with a positive block size.

    lengths: (doc_id, n). Documents of no length are left out. A document longer than a block fills blocks of its own; its rest is packed like others,
    as the last part. Repeated ids are items of their own; the packing of a shard doesn't depend on the order of its rows.
    """
    items = lengths.where("n > 0").select(F.col("doc_id").alias("id"), "n", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    wanted = configs.where("block_size > 0").select("config_name", "block_size")
    out = None
    rows = [(r[0], r[1]) for r in wanted.toLocalIterator()]
    # no configuration: no row is packed; each further MOST_CONFIGS are a pass of their own
    for part in [rows[k : k + MOST_CONFIGS] for k in range(0, len(rows), MOST_CONFIGS)] or [[]]:
        each = F.explode(F.array(*(F.struct(F.lit(a).cast("string").alias("config_name"), F.lit(b).cast("int").alias("block_size")) for a, b in part or [(None, 1)]))).alias("c")
        own = (items if part else items.where("false")).select("id", "n", "shard", each).select("id", "n", "shard", "c.config_name", "c.block_size")
        # a given number of partitions isn't merged: shards are few bytes but long work, and each partition should hold one at most
        own = own.repartition(4 * shards * max(1, len(part)), "config_name", "block_size", "shard")
        packed_ = own.groupBy("config_name", "block_size", "shard").applyInArrow(lambda t: _shard(t), "config_name string, block_id bigint, doc_id bigint, part int, start int, tokens int")
        out = packed_ if out is None else out.unionByName(packed_)
    return out


def summary(blocks: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_name, block_size, blocks, documents, split_documents, tokens, least_blocks, unused_share) of a packing."""
    per = blocks.groupBy("config_name", "block_id").agg(F.sum("tokens").alias("tokens"))
    a = per.groupBy("config_name").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"))
    b = blocks.groupBy("config_name").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct(F.when(F.col("part") > 0, F.col("doc_id"))).alias("split_documents"))
    room = F.col("blocks") * F.col("block_size")
    return a.join(b, "config_name").join(configs.select("config_name", "block_size"), "config_name").select("config_name", "block_size", "blocks", "documents", "split_documents", "tokens", F.ceil(F.col("tokens") / F.col("block_size")).alias("least_blocks"), F.round((room - F.col("tokens")) / room, 6).alias("unused_share"))
