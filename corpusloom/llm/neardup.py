"""Near-duplicate documents as an exact similarity join on bags of words (problem 5).

Similarity of two documents: words in both, with multiplicity, / words of the longer. A bag becomes a set by numbering a word's occurrences. Documents
with equal bags form a class; only one representative per class is compared.

Candidates come from a partition of the universe of words: sizes are cut into bands, each band's universe into so many segments (by a hash of the word)
that two similar documents can't differ by two words or more in all of them. A document's words in a segment are one subset; the index holds a hash
of each subset and of its one-deletion neighbourhood. The longer document of a pair probes: of its segments it leaves out some (-1), looks some up as
they are (0) and some with one deletion on either side (1), so that the sum of (choice + 1) exceeds the most words in which a similar pair can differ.
By the pigeonhole principle one of the chosen segments then matches. Choices are made by cost, the expected number of matches from the words' document
frequencies.

Entries travel twice. First only their keys do, by buckets; keys that no document probes, or that one document alone holds, end there. What is left is
dealt to units of bounded size and gets the documents' folded bitmaps, on which an exact bound rules most pairs out; the others are verified on the sets
themselves, so no link is lost and none is wrong. A key that more than HOT documents may hold is split both ways: its index entries and its probes are
dealt to a grid of parts, so that each entry meets each probe in one of them and no part grows with the collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, small
from .arrow import slices
from .confusables import Keys, repeated, salted
from .tiling import word_code

#: Sizes from one band to the next.
BAND = 1.7
#: Segments beyond the least number, as a factor: what a probe may leave out.
SLACK = 1.2
#: Entries of a bucket, on average, and those of a unit, which also carry bitmaps: they are sorted in one task's memory.
BUCKET, UNIT = 1_600_000, 200_000
#: Documents that one key may lead to before it is split, and copies after which a class is joined apart.
HOT = 250_000
COPIES = 10_000
#: Cells in which document frequencies are added up for the costs.
CELLS = 1 << 16

codes = Keys(word_code)
_U = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 64-bit values."""
    x = (x ^ _U(seed)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def as_set(text: str) -> np.ndarray:
    """The bag of a text's words as a sorted set of 64-bit codes of (word, number of the occurrence)."""
    a = np.array([codes[w] for w in text.split()], _U)
    a = np.sort(a[a != 0])
    if len(a) == 0:
        return a
    first = np.concatenate([[True], a[1:] != a[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    return np.sort(mix(a + (np.arange(len(a)) - start).astype(_U) * _U(0xA24BAED4963EE407), 17))


def bitmaps(doc: np.ndarray, tok: np.ndarray, docs: int, width: int) -> np.ndarray:
    """A row of 64-bit words for each document: parities of its members folded onto so many words. Two sets differ in at least as many members as their
    bitmaps differ in bits."""
    bits = doc.astype(np.int64) * (64 * width) + (mix(tok, 61) % _U(64 * width)).astype(np.int64)
    odd = (np.bincount(bits, minlength=docs * 64 * width) & 1).astype(np.uint8)
    return np.packbits(odd).view(_U).reshape(docs, width)


def width_of(band: int) -> int:
    """64-bit words of the bitmaps of a band: twice as many bits as the largest set has members, so that strangers differ in far more than similar sets."""
    return max(4, -(-2 * int(band_end(np.int64(band))) // 64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) of the rows with text."""
    for b in slices(batches):
        rows = [(i, as_set(t).tobytes()) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) if i is not None and t and not t.isspace()]
        c = list(zip(*rows)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary())], ["id", "words"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bag, n) of the rows with text; and of each task rows (cell, n) with the document frequencies of the cells of words."""
    cells = np.zeros(CELLS, np.int64)
    for b in _sets(batches):
        raw = b.column("words").to_pylist()
        if raw:
            cells += np.bincount((np.frombuffer(b"".join(raw), _U) & _U(CELLS - 1)).astype(np.int64), minlength=CELLS)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array([len(x) // 8 for x in raw], pa.int64()), pa.nulls(len(raw), pa.int32())], ["id", "bag", "n", "cell"])
    at = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(cells[at]), pa.array(at.astype(np.int32))], ["id", "bag", "n", "cell"])


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(BAND) + 1e-9).astype(np.int64)


def band_end(k: np.ndarray) -> np.ndarray:
    """The largest size in a band."""
    return np.ceil(BAND ** (k + 1.0) - 1e-9).astype(np.int64) - 1


def shared(n: np.ndarray, percent: int) -> np.ndarray:
    """The least number of shared words for the longer size."""
    return -(-n * percent // 100)


def segments(k: np.ndarray, percent: int) -> np.ndarray:
    """Segments of a band: with all of them looked up with one deletion, the sum exceeds every difference between similar sets of the band."""
    u = band_end(k)
    return np.ceil(SLACK * ((u - shared(u, percent)) + 1)).astype(np.int64)


def parts_of(band: np.ndarray, docs: np.ndarray, percent: int, hot: int) -> np.ndarray:
    """For each band and number of words of a subset (the last column for more): what the frequency of the subset's rarest word is multiplied by to give the
    parts of its key less one. A document of the band holds the subset if it holds that word and no other of its words falls into the segment, or just one."""
    m = segments(band, percent).astype(float)
    least = np.ceil(BAND**band - 1e-9)
    rest = np.maximum(least[:, None] - np.arange(64)[None, :], 0) / m[:, None]
    return docs[:, None] * np.exp(-rest) * (1 + rest) / hot


def entries(n: np.ndarray, doc: np.ndarray, tok: np.ndarray, band: np.ndarray, budget: np.ndarray, df: np.ndarray, total: float, percent: int, index: bool, parts: np.ndarray):
    """Entries (key, document, kind) of documents in a band each. kind: 1 a whole subset, 0 one with a deletion; +2 if the document probes with it, +4 if the
    probe of a whole subset allows a deletion, +8 if it isn't in the index.

    doc gives the document of each word of tok, budget what the sum of a document's choices must reach (0: it doesn't probe). With index all
    entries are made, else those that probe. parts: see parts_of.
    """
    m = segments(band, percent)
    base = np.concatenate([[0], np.cumsum(m)])
    h = mix(tok, 23)
    seg = base[doc] + (mix(tok, 31) % m[doc].astype(_U)).astype(np.int64)
    total_seg = int(base[-1])
    order = np.argsort(seg, kind="stable")
    seg, h, doc, tok = seg[order], h[order], doc[order], tok[order]
    sums = np.zeros(total_seg, _U)
    np.add.at(sums, seg, h)
    owner = np.repeat(np.arange(len(n)), m)
    p = np.maximum(df[(tok & _U(CELLS - 1)).astype(np.int64)], 1.0) / total
    log_p = np.bincount(seg, np.log(p), total_seg)
    per_word = np.bincount(seg, 1 / p, total_seg)
    mean = n[owner] / m[owner]
    with np.errstate(over="ignore"):
        c0 = np.exp(log_p - mean)
        c1 = c0 * (mean + per_word)
    # the cheapest steps of each document until its budget is reached
    step_doc, step_seg = np.concatenate([owner, owner]), np.concatenate([np.arange(total_seg)] * 2)
    cost = np.concatenate([c0, np.maximum(c1, c0)])
    o = np.lexsort((cost, step_doc))
    rank = np.arange(len(o)) - np.repeat(2 * base[:-1], 2 * m)
    chosen = o[rank < budget[step_doc[o]]]
    choice = np.full(total_seg, -1)
    np.add.at(choice, step_seg[chosen], 1)
    salt = mix((band[owner].astype(_U) << _U(40)) + (np.arange(total_seg) - base[owner]).astype(_U), 41)
    whole = np.flatnonzero((choice >= 0) | index)
    part = np.flatnonzero((choice[seg] > 0) | index)
    key = mix(np.concatenate([sums[whole] + salt[whole], sums[seg[part]] - h[part] + salt[seg[part]]]), 53)
    kind = np.concatenate([1 + 2 * (choice[whole] >= 0), 2 * (choice[seg[part]] > 0)]).astype(np.uint8)
    # with choice 0 whole subsets meet whole ones only
    kind[: len(whole)] |= (4 * (choice[whole] > 0)).astype(np.uint8)
    if not index:
        kind |= np.uint8(8)
    holder = np.concatenate([owner[whole], doc[part]])
    # the rarest word of each subset, without the deleted one
    size = np.bincount(seg, minlength=total_seg)
    start = np.cumsum(size) - size
    by = np.lexsort((p, seg))
    rarest, second = np.ones(total_seg), np.ones(total_seg)
    rarest[size > 0] = p[by[start[size > 0]]]
    second[size > 1] = p[by[start[size > 1] + 1]]
    first = np.zeros(len(seg), bool)
    first[by[start[size > 0]]] = True
    low = np.concatenate([rarest[whole], np.where(first[part], second[seg[part]], rarest[seg[part]])])
    words = np.concatenate([size[whole], size[seg[part]] - 1])
    k = 1 + np.floor(low * parts[band[holder], np.minimum(words, 63)]).astype(np.int64)
    hot = k > 1
    if not hot.any():
        return key, holder, kind
    return tuple(np.concatenate([x[~hot], y]) for x, y in zip((key, holder, kind), _grid(key[hot], holder[hot], kind[hot], k[hot], tok, doc)))


def _grid(key: np.ndarray, holder: np.ndarray, kind: np.ndarray, k: np.ndarray, tok: np.ndarray, doc: np.ndarray):
    """Entries of hot keys dealt to k times k parts: as index entries to one row of the grid, as probes to one column, rows and columns by the document."""
    of = np.zeros(int(doc.max()) + 1, _U)
    np.add.at(of, doc, mix(tok, 83))  # a hash of the whole set
    out = []
    for probes in (False, True):
        some = kind & 2 > 0 if probes else kind & 8 == 0
        key_, h, kd, n = key[some], holder[some], kind[some], k[some]
        at = np.repeat(np.arange(len(n)), n)
        other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        own = (mix(of[h], 89 if probes else 97) % n.astype(_U)).astype(np.int64)[at]
        cell = np.where(probes, other * n[at] + own, own * n[at] + other)
        out.append((mix(key_[at] + cell.astype(_U), 71), h[at], kd[at] | np.uint8(8) if probes else kd[at] & np.uint8(1)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _binary(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """The bytes of values cut at the starts."""
    ends = np.concatenate([start, [len(values)]]).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _index(batches: Iterator[pa.RecordBatch], df: np.ndarray, total: float, percent: int, buckets: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "words"):
        ids, raw = b.column("id").to_numpy(), b.column("words").to_pylist()
        n = np.array([len(x) // 8 for x in raw], np.int64)
        # sets so small that no longer set and no different one can be similar are left out
        some = n * 100 // percent > n
        ids, n, raw = ids[some], n[some], [x for x, k in zip(raw, some) if k]
        if not len(ids):
            continue
        tok = np.frombuffer(b"".join(raw), _U)
        doc = np.repeat(np.arange(len(n)), n)
        band = band_of(n)
        key, owner, kind = entries(n, doc, tok, band, 2 * (n - shared(n, percent)) + 1, df, total, percent, True, parts)
        scheme = band[owner]
        # documents whose shorter partners may lie in the band below probe there, too
        below = np.flatnonzero(band_end(band - 1) >= shared(n, percent))
        if len(below):
            code = np.full(len(n), -1)
            code[below] = np.arange(len(below))
            inside = code[doc] >= 0
            u = band_end(band[below] - 1)
            k2, o2, f2 = entries(n[below], code[doc[inside]], tok[inside], band[below] - 1, u + n[below] - 2 * shared(n[below], percent) + 1, df, total, percent, False, parts)
            key, owner, kind = np.concatenate([key, k2]), np.concatenate([owner, below[o2]]), np.concatenate([kind, f2])
            scheme = np.concatenate([scheme, band[below[o2]] - 1])
        # a band has buckets of its own, so a document is in few of them
        bucket = buckets[scheme] + ((key >> _U(32)) % (buckets[scheme + 1] - buckets[scheme]).astype(_U)).astype(np.int64)
        order = np.lexsort((owner, bucket))
        key, owner, kind, bucket = key[order].astype(np.uint32), owner[order], kind[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        # a document's entries in a bucket lie together
        run = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))
        count = np.diff(np.concatenate([run, [len(key)]])).astype(np.int32)
        at = np.searchsorted(run, cuts)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), _binary(ids[owner[run]], at), _binary(n[owner[run]].astype(np.int32), at), _binary(count, at), _binary(key, cuts), _binary(kind, cuts)], ["bucket", *INDEX])


INDEX = ["ids", "sizes", "counts", "keys", "kinds"]


def _column(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def _useful(t: pa.Table, unit: int, percent: int) -> pa.Table:
    """(id, unit, keys, kinds): the entries of a bucket that may meet one of another document, by kind and by size, in units of whole keys."""
    count = _column(t, "counts", np.int32)
    row = np.repeat(np.arange(len(count), dtype=np.int32), count)
    ids, sizes, key, kind = _column(t, "ids", np.int64), _column(t, "sizes", np.int32), _column(t, "keys", np.uint32), _column(t, "kinds", np.uint8)
    order = np.argsort(key, kind="stable")
    key, kind, row = key[order], kind[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.minimum.reduceat(row, start) < np.maximum.reduceat(row, start)
    keep = np.repeat(several, np.diff(np.concatenate([start, [len(key)]])))
    key, kind, row = key[keep], kind[keep], row[keep]
    if not len(key):
        return pa.table({"id": pa.array([], pa.int64()), "unit": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "kinds": pa.array([], pa.binary())})
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(key)]])))
    n, whole, probe, index = sizes[row].astype(np.int64), kind & 1 > 0, kind & 2 > 0, kind & 8 == 0
    some = lambda x: np.logical_or.reduceat(x, start)[group]
    least = lambda x: np.minimum.reduceat(np.where(x, n, 1 << 60), start)[group]
    most = lambda x: np.maximum.reduceat(np.where(x, n, -1), start)[group]
    # parts don't meet parts, and a whole subset meets parts only if the probe allows a deletion
    as_index = index & np.where(whole, some(probe), some(probe & (kind & 4 > 0))) & (n <= most(probe)) & (n >= shared(np.where(some(probe), least(probe), 0), percent))
    as_probe = probe & np.where(whole, some(index & whole) | (kind & 4 > 0), some(index & whole)) & (most(index) >= shared(n, percent)) & (least(index) <= n)
    keep = (as_index & some(as_probe)) | (as_probe & some(as_index))
    key, kind, row = key[keep], kind[keep], row[keep]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([start, [len(key)]])).astype(np.int64)
    number = np.repeat((np.cumsum(length) - length) // unit, length)
    order = np.lexsort((row, number))
    key, kind, row, number = key[order], kind[order], row[order], number[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (number[1:] != number[:-1])])) if len(row) else np.zeros(0, np.int64)
    bucket = t.column("bucket")[0].as_py()
    return pa.table([pa.array(ids[row[new]]), pa.array((bucket << 32) + number[new]), _binary(key, new), _binary(kind, new)], ["id", "unit", "keys", "kinds"])


def _mapped(batches: Iterator[pa.RecordBatch], buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each of a document's units, with its size and its bitmap, as wide as the unit's band asks."""
    for b in slices(batches, "words"):
        raw, lists = b.column("words").to_pylist(), b.column("units")
        row, each = np.repeat(np.arange(len(raw)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
        unit = each.field("unit").to_numpy()
        band = np.searchsorted(buckets, unit >> 32, "right") - 1
        n = np.array([len(x) // 8 for x in raw], np.int64)
        maps = np.empty(len(unit), object)
        for k in np.unique(band):
            at = np.flatnonzero(band == k)
            those, of = np.unique(row[at], return_inverse=True)
            rows = bitmaps(np.repeat(np.arange(len(those)), n[those]), np.frombuffer(b"".join(raw[i] for i in those), _U), len(those), width_of(int(k)))
            own = np.empty(len(those), object)
            own[:] = [x.tobytes() for x in rows]
            maps[at] = own[of]
        yield pa.RecordBatch.from_arrays([pa.array(unit), b.column("id").take(pa.array(row)), pa.array(n[row].astype(np.int32)), each.field("keys"), each.field("kinds"), pa.array(maps, pa.binary())], ["unit", "id", "n", "keys", "kinds", "map"])


def _meet(t: pa.Table, percent: int) -> pa.Table:
    """The candidate pairs of a unit: entries with one key, the longer document's one probing, whose bitmaps don't rule the pair out."""
    doc_ids, doc_n = t.column("id").to_numpy(), t.column("n").to_numpy()
    maps = _column(t, "map", _U).reshape(len(doc_n), -1)
    kinds = t.column("kinds").to_pylist()
    row = np.repeat(np.arange(len(kinds), dtype=np.int32), [len(x) for x in kinds])
    key, kind = _column(t, "keys", np.uint32), np.frombuffer(b"".join(kinds), np.uint8)
    order = np.argsort(key, kind="stable")
    key, kind, row = key[order], kind[order], row[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(first)
    length = np.diff(np.concatenate([start, [len(key)]]))
    group = np.cumsum(first) - 1
    probing = np.flatnonzero((kind & 2 > 0) & (length[group] > 1))
    found = []
    at, most = 0, max(1000, 4_000_000 // maps.shape[1])
    steps = length[group[probing]]
    ends = np.cumsum(steps)
    while at < len(probing):  # so many pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        p, k = probing[at:to], steps[at:to]
        left = np.repeat(p, k)
        right = np.repeat(start[group[p]], k) + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        # whole with whole; whole with part if the probe allows a deletion; the other side must be an entry of the index of that band
        kl, kr = kind[left], kind[right]
        fits = (kr & 8 == 0) & ((kl & 1 > 0) & ((kr & 1 > 0) | (kl & 4 > 0)) | (kl & 1 == 0) & (kr & 1 > 0))
        a, b = row[right[fits]], row[left[fits]]
        na, nb = doc_n[a].astype(np.int64), doc_n[b].astype(np.int64)
        ia, ib = doc_ids[a], doc_ids[b]
        ok = (na <= nb) & (na >= shared(nb, percent)) & (ia != ib)
        ok[ok] = np.bitwise_count(maps[a[ok]] ^ maps[b[ok]]).sum(1, dtype=np.int64) <= na[ok] + nb[ok] - 2 * shared(nb[ok], percent)
        lo, hi = np.minimum(ia[ok], ib[ok]), np.maximum(ia[ok], ib[ok])
        o = np.lexsort((hi, lo))
        lo, hi = lo[o], hi[o]
        new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) if len(lo) else np.zeros(0, bool)
        found.append((lo[new], hi[new]))
        at = to
    lo = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    hi = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    return pa.table({"a": lo, "b": hi})


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "wa"):
        wa, wb = b.column("wa").to_pylist(), b.column("wb").to_pylist()
        na, nb = (np.array([len(x) // 8 for x in w], np.int64) for w in (wa, wb))
        pair = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
        tok = np.frombuffer(b"".join(wa + wb), _U)
        order = np.lexsort((tok, pair))
        tok, pair = tok[order], pair[order]
        both = np.bincount(pair[1:][(tok[1:] == tok[:-1]) & (pair[1:] == pair[:-1])], minlength=len(na))
        yield b.select(["a", "b"]).filter(pa.array(both * 100 >= percent * np.maximum(na, nb)))


class NearDuplicates:
    """members: (id, rep), every document with words and its class of equal bags; links: (a, b), a < b, the similar pairs of classes."""

    def __init__(self, docs: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text"):
        """Null, empty and blank texts, and null ids, belong to no class; texts of punctuation only are one class.

        Rows that repeat an id and its text count once.
        """
        rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
        first = cut(rows.mapInArrow(lambda it: _bags(it), "id bigint, bag binary, n bigint, cell int"))
        bags = first.where("cell is null").select("id", "bag", "n")
        # one representative of a class, the least id; copies are pre-aggregated before the shuffle
        reps = cut(bags.groupBy("bag").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("k")))
        # members of large classes are joined apart: a class of COPIES documents takes one row, so these rows are few
        large, bags = small(reps.where(F.col("k") > COPIES).select("bag", "rep")), bags.select("id", "bag")
        few = bags.join(large, "bag", "left_anti").join(reps.where(F.col("k") <= COPIES).select("bag", "rep"), "bag").withColumn("large", F.lit(False))
        self.members = few.unionByName(bags.join(large, "bag").withColumn("large", F.lit(True))).select("id", "rep", "large").distinct()
        self.links = self._links(rows.mapInArrow(lambda it: _sets(it), "id bigint, words binary"), reps, first, percent)

    def by_class(self, info: DataFrame) -> DataFrame:
        """The members with a table of at most a row for each class, on rep; without the rows of large classes in the shuffle."""
        m = self.members
        large = small(m.where("large").select("rep").distinct())
        return m.where("NOT large").join(info, "rep", "left").unionByName(m.where("large").join(small(info.join(large, "rep", "left_semi")), "rep", "left")).drop("large")

    def _links(self, sets: DataFrame, reps: DataFrame, first: DataFrame, percent: int) -> DataFrame:
        df = np.zeros(CELLS)
        for r in first.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("df")).collect():  # CELLS rows at most
            df[r["cell"]] = r["df"]
        # classes and words by band: at most some sixty rows
        band = F.floor(F.log(F.col("n")) / float(np.log(BAND)) + 1e-9).cast("int")
        of = {r[0]: (r[1], r[2]) for r in reps.where("n > 0").groupBy(band.alias("band")).agg(F.sum("n"), F.count("*")).collect()}
        total = max(1, sum(x[1] for x in of.values()))
        words = [of.get(k, (0, 0))[0] for k in range(max(of, default=0) + 2)]
        buckets = np.concatenate([[0], np.cumsum([max(1, round((1.25 * a + 0.6 * b) / BUCKET)) for a, b in zip(words, words[1:])])]).astype(np.int64)
        bands = np.arange(len(buckets) - 1)
        docs = np.array([of.get(k, (0, 0))[1] for k in range(len(buckets))], float)
        parts = parts_of(bands, docs[:-1] + docs[1:], percent, HOT)
        # the sets go over the network once, by id: for the index, the bitmaps and the verification
        mine = sets.join(reps.select(F.col("rep").alias("id")), "id").select("id", "words")
        index = mine.mapInArrow(lambda it: _index(it, df, total, percent, buckets, parts), "bucket int, " + ", ".join(f"{x} binary" for x in INDEX))
        unit = UNIT
        useful = index.groupBy("bucket").applyInArrow(lambda t: _useful(t, unit, percent), "id bigint, unit bigint, keys binary, kinds binary")
        useful = useful.groupBy("id").agg(F.collect_list(F.struct("unit", "keys", "kinds")).alias("units"))  # by the key that its words lie by
        mapped = useful.join(mine, "id").select("id", "units", "words").mapInArrow(lambda it: _mapped(it, buckets), "unit bigint, id bigint, n int, keys binary, kinds binary, map binary")
        close = mapped.groupBy("unit").applyInArrow(lambda t: _meet(t, percent), "a bigint, b bigint").distinct()
        sides = close.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
        pairs = sides.join(sets, "id").groupBy("a", "b").agg(F.min_by("words", "id").alias("wa"), F.max_by("words", "id").alias("wb"))
        return pairs.mapInArrow(lambda it: _verify(it, percent), "a bigint, b bigint")


def similar_pairs(docs: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: every pair of documents with at least that similarity, copies listed in full."""
    found = NearDuplicates(docs, percent, id, text)
    links = cut(found.links)
    m = found.members.drop("large")
    # a class of copies may hold a third of all documents: its members are split by salts, the links and the other members repeated for each
    members = lambda s: salted(m).select(F.col("rep").alias(s), F.col("id").alias(f"id_{s}"), "salt")
    across = repeated(links).join(members("a"), ["a", "salt"]).select("b", "id_a")
    across = repeated(across).join(members("b"), ["b", "salt"]).select("id_a", "id_b")
    several = m.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").select("rep")
    copies = cut(salted(m).join(repeated(several), ["rep", "salt"]).select("rep", "id"))
    left = salted(copies).select("rep", "salt", F.col("id").alias("id_a"))
    same = left.join(repeated(copies.select("rep", F.col("id").alias("id_b"))), ["rep", "salt"]).where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(same).select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b"))


def groups(docs: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, group_id, links): each document with words, its class of equal bags, its group and its class's number of links.

    A group holds the classes that are connected by links; its id is the least document id in it. The least id spreads over the links round by round,
    each round's table written to the checkpoint folder, until nothing changes; ids of neighbours' neighbours shorten the way.
    """
    found = NearDuplicates(docs, percent, id, text)
    links = cut(found.links)
    edges = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("g")))
    while True:
        spread = edges.join(label.select(F.col("a").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("near"))
        hop = label.select(F.col("a").alias("g"), F.col("g").alias("far"))
        new = cut(label.join(spread, "a").join(hop, "g", "left").select("a", F.least("g", "near", "far").alias("g"), (F.least("g", "near", "far") < F.col("g")).alias("moved")))
        label, moved = new.select("a", "g"), new.where("moved").limit(1).count()
        if not moved:
            break
    degree = edges.groupBy("a").agg(F.count("*").alias("links"))
    info = label.join(degree, "a").select(F.col("a").alias("rep"), "g", "links")
    return found.by_class(info).select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), F.coalesce("g", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
