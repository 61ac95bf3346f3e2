"""Line dedup by a segment-partition edit join.

Two lines of MIN_CHARS code points or more are near copies if they are within `edits` of the shorter one's
length: EDITS, and more as lines grow. At so few edits one of edits + 1 disjoint segments stays whole, and the
k-th with k edits before and edits - k behind it at most (Li et al., 2011: Pass-Join). Segments of lines of
similar length have one size; the first half are counted from the line's start, the others from its end,
so the k-th from its side moves by k places at most, whatever the lengths. Each line's segments are index
rows, its substrings at the other places they can move to are probe rows; equal hashes of (length class,
number, substring) make candidates. Places for a line are (edits + 1)**2 / 2 about, a fixed number a code point.
Candidates are verified by how far each number of edits reaches on each diagonal. Lines linked directly or through others form a
class; of a class the first line, by document and place, stays and every other goes.

Links that would join what is joined already need no check. A quarter of the keys is enough to join most
copies: there each component of a group names one partner, so a group of m lines makes m pairs at most.
Lines that some key then still holds with a possible partner of another component are looked at more closely: an edit
changes four bigrams at most, so parities of bigrams, 256 bits a line, tell near copies from lines that share a phrase by
chance, which the more lines have the larger a table is. Those that are left form clusters by these keys.
A cluster's texts are sent once to each pair of its blocks, where all pairs that lengths and characters
allow are verified, many at once, unless joined meanwhile; what comes back is a spanning forest, again
no more than the members.
"""

from __future__ import annotations

import hashlib
import math
import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KNOWN, SPACE_BYTES, chunks, components, lists, mapped, merged, mix, prefix_sums, range_hash, scratch, stash

EDITS, MIN_CHARS = 2, 30
#: Edits grow as the square root of the length over this, so that the rows grow as the text.
CHARS = 8
#: Of this many keys one is taken in the first round. Members of a group, and of a cluster, that are compared in one task.
FIRST_KEYS, BLOCK, CLUSTER_BLOCK = 4, 2048, 512
#: Pairs of lines verified at once, their diagonals and code points at most, code points compared in one step, and bins of characters that are counted before.
PAIRS, CELLS, POINTS, WIDTH, BINS = 512, 1 << 15, 1 << 22, 32, 64
#: Words of 64 bits, and so bins, of the parities of bigrams.
SIGN_WORDS, SIGN_BINS = 4, 256
#: Rows of a group whose pairs are listed together with those of other groups, and pairs listed at once.
SMALL, STEP = 64, 1 << 19
#: Lines to verify, classed or repeated, or places of lines to remove, that may be broadcast (8 or 16 bytes each); beyond, rows are shuffled and joined.
BROADCAST = 2_000_000
#: Bytes of text whose rows, some 30 a line, are made at once.
ROWS_BYTES = 1 << 20
#: Bytes of text for each bucket of index and probe rows; a task holds the rows of one bucket.
BUCKET_BYTES = 8 << 20
#: By byte.
IS_SPACE = np.isin(np.arange(256), SPACE_BYTES)


def edits_within(x: str, y: str, most: int = EDITS) -> bool:
    """Whether the edit distance is at most `most`.

    Level e holds, as bits, the diagonals (place in y less place in x, plus most) that e edits reach; a
    step over one character of x moves all diagonals of the band at once.
    """
    if abs(len(x) - len(y)) > most:
        return False
    if x == y:
        return True
    same = len(os.path.commonprefix((x, y)))
    x, y = x[same:], y[same:]
    same = len(os.path.commonprefix((x[::-1], y[::-1])))
    x, y = x[: len(x) - same], y[: len(y) - same]
    places: dict[str, int] = {}
    for j, c in enumerate(y):
        places[c] = places.get(c, 0) | 1 << (j + most)
    band = (1 << (2 * most + 1)) - 1
    levels, reach = [], 1 << most
    for _ in range(most + 1):
        levels.append(reach)
        reach = (reach | reach << 1) & band
    for i, c in enumerate(x):
        hit = (places.get(c, 0) >> i) & band
        before = 0
        now = 0
        fresh = []
        for old in levels:
            # a match; a character of x replaced or left out; a character of y put in
            now = (old & hit) | before | before >> 1 | (now << 1 & band)
            fresh.append(now)
            before = old
        levels = fresh
        if not now:
            return False
    end = 1 << (len(y) - len(x) + most)
    return bool(levels[-1] & end)


def runs(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many code points from i on in x equal those from j on in y. Behind i and j must be a difference, and then WIDTH at least."""
    out = np.zeros(len(i), np.int64)
    # most go no further than this
    live = np.flatnonzero(x[i] == y[j])
    xs, ys = (np.lib.stride_tricks.sliding_window_view(z, WIDTH) for z in (x, y))
    while len(live):
        equal = np.packbits(xs[i[live] + out[live]] == ys[j[live] + out[live]], axis=1, bitorder="little").view(np.uint32)[:, 0]
        # ones below the lowest zero
        step = np.bitwise_count(equal & ~(equal + np.uint32(1)))
        out[live] += step
        live = live[step == WIDTH]
    return out


def distances(xs: list[np.ndarray], ys: list[np.ndarray], most: int | np.ndarray) -> np.ndarray:
    """Edit distances of pairs of code point arrays, exact up to most, a bound for all or each its own, else larger than it.

    For e edits and each diagonal (place in y less place in x), how far in x they reach: one edit further than e - 1 edits on this
    diagonal or a neighbour, then as long as both go on alike (Ukkonen, 1985). All pairs and diagonals take a step at once,
    but for diagonals from which the edits left don't lead to the pair's own, on which it ends.
    """
    m, n = (np.array([len(z) for z in zs], np.int64) for zs in (xs, ys))
    most = np.broadcast_to(np.asarray(most, np.int64), len(xs))
    out = np.abs(n - m) + most + 1
    able = np.flatnonzero(np.abs(n - m) <= most)
    able = able[np.argsort(most[able], kind="stable")]
    begin = 0
    while begin < len(able):
        # bounds of one batch are alike
        own = most[able[begin : begin + PAIRS]]
        size = int(np.searchsorted(own, 2 * own[0] + 4))
        size = max(1, min(size, CELLS // (2 * int(own[size - 1]) + 1), int(np.searchsorted(np.cumsum((m + n)[able[begin : begin + size]]), POINTS, "right"))))
        at, begin = able[begin : begin + size], begin + size
        k = int(most[at].max())
        flat, base = [], []
        for zs, sizes, end in ((xs, m[at], 0xFFFFFFFF), (ys, n[at], 0xFFFFFFFE)):
            # what stands behind the lines equals nothing
            flat.append(np.concatenate([z for p in at.tolist() for z in (zs[p], np.array([end], np.uint32))] + [np.full(WIDTH, end, np.uint32)]))
            base.append(np.cumsum(sizes + 1) - sizes - 1)
        # a column beside the diagonals on either side; reached places, -1 - 2 k: none
        d = np.arange(-k - 1, k + 2)
        none = -2 - 2 * k
        reach = np.full((len(at), 2 * k + 3), none, np.int64)
        ends = np.minimum(m[at, None], n[at, None] - d)
        final = n[at] - m[at]
        left = most[at, None] - np.abs(d - final[:, None])
        live = np.arange(len(at))
        for e in range(k + 1):
            lo, hi = k + 1 - e, k + 2 + e
            if e:
                old = reach[live, lo - 1 : hi + 1]
                now = np.maximum(np.maximum(old[:, 1:-1] + 1, old[:, 2:] + 1), old[:, :-2])
                now = np.where(now < 0, none, np.minimum(now, ends[live, lo:hi]))
            else:
                now = np.zeros((len(live), 1), np.int64)
            row, col = np.nonzero((now >= 0) & (left[live, lo:hi] >= e))
            pair, i = live[row], now[row, col]
            now[row, col] = i + runs(*flat, base[0][pair] + i, base[1][pair] + i + d[lo + col])
            reach[live, lo:hi] = now
            done = now[np.arange(len(live)), np.clip(final[live] + e, 0, 2 * e)] >= m[at[live]]
            done &= np.abs(final[live]) <= e
            out[at[live[done]]] = e
            live = live[~done & (most[at[live]] > e)]
            if not len(live):
                break
    return out


def within(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether the distance of each pair is at most its own bound."""
    return distances(xs, ys, most) <= most


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def line_hashes(raw: bytes, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """As Spark's xxhash64 of each range as a string."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(raw[a:b], 42) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], np.uint64).view(np.int64)


def edits(length: int) -> int:
    """Edits between near copies of which the shorter one has so many code points."""
    return max(EDITS, math.isqrt(length // CHARS))


def length_classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least length, length of the next class, edits)."""
    now, k = MIN_CHARS, EDITS + 1
    while now <= longest:
        grows = CHARS * k * k
        # lines of EDITS edits are cut once more, for longer segments
        after = 3 * MIN_CHARS // 2 if now == MIN_CHARS and grows > 2 * MIN_CHARS else grows
        yield now, after, edits(now)
        k += after == grows
        now = after


def segment_rows(sums: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, which lines, and whether probes, of lines at lo with size code points, sums: of the code points.

    Lines a few code points longer than a class are probes there, too. An index row is the probe at its
    own place. The low bits of a key are the class's edits, 15 for more.
    """
    found = []
    for least, after, most in length_classes(int(size.max(initial=0))):
        who = np.flatnonzero((size >= least) & (size < after + most))
        if not len(who):
            continue
        q, left = least // (most + 1), (most + 2) // 2
        moves = [(i * q + at, False, i, at) for i in range(left) for at in range(-i, i + 1)]
        moves += [(at - (i + 1) * q, True, left + i, at) for i in range(most + 1 - left) for at in range(-i, i + 1)]
        off, back, number, at = (np.array(x) for x in zip(*moves, strict=True))
        # none leaves its line: the segments that a side counts are half of them, and the others' length allows the moves
        begin = lo[who, None] + off + np.where(back, size[who, None], 0)
        keys = range_hash(sums, begin, begin + q) ^ mix((np.uint64(least) << np.uint64(24)) + number.astype(np.uint64))
        keys = keys & ~np.uint64(15) | np.uint64(min(most, 15))
        found.append((keys.ravel(), np.repeat(who, len(moves)), ((at != 0) | (size[who, None] >= after)).ravel()))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def line_ends(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in bytes and document of each line, empty documents aside; places of line feeds."""
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    doc = np.minimum(np.searchsorted(bounds, begin, "right"), len(bounds) - 1)
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], bounds[doc])
    return begin, stop, doc - 1, breaks


def long_lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in bytes, start and end in code points of each line of MIN_CHARS code points or more."""
    begin, stop, _, _ = line_ends(data, bounds)
    # bytes that begin no code point
    inner = np.flatnonzero(data.view(np.int8) < -64)
    lo, hi = begin - np.searchsorted(inner, begin), stop - np.searchsorted(inner, stop)
    long = np.flatnonzero(hi - lo >= MIN_CHARS)
    return begin[long], stop[long], lo[long], hi[long]


def worded(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each line has a word. Most begin with one."""
    found = begin < stop
    found[found] = ~IS_SPACE[data[begin[found]]]
    for k in np.flatnonzero(~found & (begin < stop)).tolist():
        found[k] = not IS_SPACE[data[begin[k] : stop[k]]].all()
    return found


def _lines(short: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes and places of each document's long lines, or of all with a word, and the text's bytes."""
        for rows, data, bounds in chunks(batches, "text", ROWS_BYTES):
            if short:
                begin, stop, doc, breaks = line_ends(data, bounds)
                # white space is ASCII, so a long line without a word has as many bytes as code points
                own = np.flatnonzero(worded(data, begin, stop) | (stop - begin >= MIN_CHARS))
                begin, stop, doc = begin[own], stop[own], doc[own]
            else:
                begin, stop, _, _ = long_lines(data, bounds)
                breaks = np.flatnonzero(data == 10)
                doc = np.searchsorted(bounds, begin, "right") - 1
            place = np.searchsorted(breaks, begin) - np.searchsorted(breaks, bounds[doc])
            cuts = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists(pa.array(line_hashes(data.tobytes(), begin, stop)), cuts), lists(pa.array(place.astype(np.int32)), cuts), pa.array(np.diff(bounds))], names=["r", "k", "lines", "places", "size"])

    return run


#: The bin, as a bit, of each character of the first plane.
_BIN = np.uint32(1) << (np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(24)


def parities(cp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range of code points 24 bits: whether the number of characters in a bin is odd; above them the length modulo 128.

    An edit changes two bins at most, so lines within so many differ in twice as many bits at most.
    """
    if not len(lo):
        return np.zeros(0, np.int32)
    # as good for a character of another plane: the bin of its low bits
    bits = np.append(_BIN[cp.astype(np.uint16)], np.uint32(0))
    odd = np.bitwise_xor.reduceat(bits, np.stack([lo, hi], axis=1).ravel())[::2]
    return (odd | ((hi - lo) & 127).astype(np.uint32) << np.uint32(24)).astype(np.int32)


#: Kinds of packed rows: to be grouped, known to be shared, and standing for shared ones.
_ROWS, _KNOWN, _STANDS = 0, 1, 2
_ROW = np.dtype([("key", np.int64), ("line", np.int64), ("tag", np.int32)])


def _keys(buckets: int):
    """Index and probe rows of each line, packed by bucket of the key.

    Rows whose key two lines of one chunk have need no grouping; two of them stand for all of their
    chunk, so a very common segment sends two rows a chunk to its bucket, and the others go anywhere.
    The tag has the parities and the length, and the sign bit tells probes from index rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for n, (_, data, bounds) in enumerate(chunks(batches, "text", ROWS_BYTES)):
            begin, stop, lo, hi = long_lines(data, bounds)
            raw = data.tobytes()
            ids, at = [], []
            for k, own in enumerate(line_hashes(raw, begin, stop).tolist()):
                if own not in known:
                    if len(known) > KNOWN:
                        known.clear()
                    known.add(own)
                    ids.append(own)
                    at.append(k)
            if not ids:
                continue
            lids, lo, hi = np.array(ids, np.int64), lo[at], hi[at]
            cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
            sig = parities(cp, lo, hi)
            keys, who, probe = segment_rows(prefix_sums(cp), lo, hi - lo)
            order = np.argsort(keys)
            who, probe = who[order], probe[order]
            rows = np.empty(len(who), _ROW)
            rows["key"], rows["line"] = keys[order].view(np.int64), lids[who]
            rows["tag"] = sig[who] | np.where(probe, np.iinfo(np.int32).min, 0).astype(np.int32)
            cut, low, high = _ends(rows)
            size = np.diff(np.append(cut, len(rows)))
            many = (low < high) & (size > 2)
            direct = np.repeat(many, size)
            stands = np.zeros(2 * int(many.sum()), _ROW)
            stands["key"], stands["line"] = np.repeat(rows["key"][cut[many]], 2), np.stack([low[many], high[many]], axis=1).ravel()
            if direct.any():
                yield _pack([(int(lids[0] + n) % buckets, rows[direct])], _KNOWN)
                rows = rows[~direct]
            yield from _packed(rows, _ROWS, buckets)
            yield from _packed(stands, _STANDS, buckets)

    return run


def _ends(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key: where each key begins, its least and its largest line."""
    cut = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    return cut, np.minimum.reduceat(rows["line"], cut), np.maximum.reduceat(rows["line"], cut)


def _pack(parts: list[tuple[int, np.ndarray]], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int64()), pa.array([kind] * len(parts), pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["bucket", "kind", "rows"])


def _packed(rows: np.ndarray, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; a bucket is a range of keys."""
    if not len(rows):
        return
    bucket = ((rows["key"].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    yield _pack([(int(bucket[a]), rows[a:b]) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True)], kind)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key another line has too. Buckets come whole, sorted; one is held at a time."""
    held: list[tuple[int, np.ndarray]] = []
    last = None

    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[x])) for x in _ROW.names], names=list(_ROW.names))

    def flush() -> pa.RecordBatch:
        rows = np.concatenate([x for _, x in held])
        own = np.concatenate([np.full(len(x), kind == _ROWS) for kind, x in held])
        order = np.argsort(rows["key"].view(np.uint64))
        rows, own = rows[order], own[order]
        cut, low, high = _ends(rows)
        return out(rows[np.repeat(low < high, np.diff(np.append(cut, len(rows)))) & own])

    for batch in batches:
        for bucket, kind, raw in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("rows"), strict=True):
            rows = np.frombuffer(raw.as_buffer(), _ROW)
            if kind == _KNOWN:
                yield out(rows)
                continue
            if held and bucket != last:
                yield flush()
                held.clear()
            last = bucket
            held.append((kind, rows.copy()))
    if held:
        yield flush()


def _whole(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, rows equal in key and part, by which they come sorted, and where each group begins, then the end."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cuts(table: pa.Table) -> np.ndarray:
        key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
        return np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held)
        cut = cuts(table)
        held, size = table.slice(int(cut[-1])).combine_chunks().to_batches(), table.num_rows - int(cut[-1])
        if len(cut) > 1:
            yield table.slice(0, int(cut[-1])), cut
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(cuts(table), table.num_rows)


def pairs_within(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of all rows of one group, group by group, at most STEP or one group's at once."""
    count = size * (size - 1) // 2
    upto = np.cumsum(count)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        # each row but a group's last with those behind it
        rows = np.repeat(begin[at:end], size[at:end])
        place = np.arange(len(rows)) - np.repeat(np.cumsum(size[at:end]) - size[at:end], size[at:end])
        behind = np.repeat(size[at:end], size[at:end]) - place - 1
        first = np.repeat(rows + place, behind)
        step = np.arange(len(first)) - np.repeat(np.cumsum(behind) - behind, behind)
        yield first, first + step + 1
        at = end


def _possible(table: pa.Table, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, unlikeness) of rows of one group, one of them an index row, of different components that may be near copies.

    The small groups' together, then each larger one's, a block of rows at once.
    """
    key, tag, comp = (table.column(x).to_numpy() for x in ("key", "tag", "comp"))
    sig = (tag & np.int32(0x7FFFFFFF)).astype(np.uint32)
    odd, length = sig & np.uint32(0xFFFFFF), (sig >> np.uint32(24)).astype(np.int16)
    low = (key & 15).astype(np.int16)
    bits, apart = np.where(low < 15, 2 * low, 24).astype(np.int16), np.where(low < 15, low, 127).astype(np.int16)

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = ((tag[i] >= 0) | (tag[j] >= 0)) & (comp[i] != comp[j])
        i, j = i[ok], j[ok]
        longer = (length[i] - length[j]) & 127
        longer = np.minimum(longer, 128 - longer)
        unlike = np.bitwise_count(odd[i] ^ odd[j]).astype(np.int16)
        ok = (unlike <= bits[i]) & (longer <= apart[i])
        return i[ok], j[ok], (unlike + longer)[ok].astype(np.int64)

    size = np.diff(cut)
    mixed = np.minimum.reduceat(comp, cut[:-1]) < np.maximum.reduceat(comp, cut[:-1])
    small = mixed & (size <= SMALL)
    for i, j in pairs_within(cut[:-1][small], size[small]):
        yield near(i, j)
    for k in np.flatnonzero(mixed & (size > SMALL)).tolist():
        index = np.arange(cut[k], cut[k + 1])
        index = index[tag[index] >= 0]
        for a in range(int(cut[k]), int(cut[k + 1]), 256):
            own = np.arange(a, min(a + 256, int(cut[k + 1])))
            i, j = np.repeat(own, len(index)), np.tile(index, len(own))
            # two index rows meet twice
            once = (i < j) | (tag[i] < 0)
            yield near(i[once], j[once])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group the most alike partner of each component."""
    for table, cut in _whole(batches):
        line, comp = table.column("line").to_numpy(), table.column("comp").to_numpy()
        group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        i = j = worst = np.zeros(0, np.int64)
        for p, q, unlike in _possible(table, cut):
            i, j, worst = np.concatenate([i, p]), np.concatenate([j, q]), np.concatenate([worst, unlike])
            if len(i) > STEP:
                keep = _best(group, line, comp, i, j, worst)
                i, j, worst = i[keep], j[keep], worst[keep]
        keep = _best(group, line, comp, i, j, worst)
        if len(keep):
            both = np.unique(np.sort(np.stack([line[i[keep]], line[j[keep]]]), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _best(group: np.ndarray, line: np.ndarray, comp: np.ndarray, i: np.ndarray, j: np.ndarray, worst: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that are the most alike ones of either component in the group."""
    if not len(i):
        return np.zeros(0, np.int64)
    who, other, pair = np.concatenate([comp[i], comp[j]]), np.concatenate([line[j], line[i]]), np.tile(np.arange(len(i)), 2)
    of = group[i][pair]
    order = np.lexsort((other, worst[pair], who, of))
    first = np.concatenate([[True], (who[order][1:] != who[order][:-1]) | (of[order][1:] != of[order][:-1])])
    return np.unique(pair[order[first]])


def _doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line, tag) of rows with a possible partner of another component in their group."""
    for table, cut in _whole(batches):
        seen = np.zeros(table.num_rows, bool)
        for p, q, _ in _possible(table, cut):
            seen[p] = seen[q] = True
        if seen.any():
            own = pa.array(np.flatnonzero(seen))
            yield pa.RecordBatch.from_arrays([table.column(x).combine_chunks().take(own) for x in ("key", "line", "tag")], names=["key", "line", "tag"])


def signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and in SIGN_WORDS words whether the number of bigrams in each bin is odd. An edit changes four bins at most."""
    lines = [points(t) for t in texts]
    size = np.array([len(x) for x in lines], np.int64)
    odd = np.zeros((len(lines), SIGN_BINS), bool)
    for k, x in enumerate(lines):
        pairs = (x[:-1] * np.uint32(2654435761) ^ x[1:]) * np.uint32(2246822519)
        odd[k] = np.bincount(pairs >> np.uint32(24), minlength=SIGN_BINS) & 1
    return size, np.packbits(odd, axis=1).view(np.uint64).reshape(-1, SIGN_WORDS)


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, words = signs(batch.column("words").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("line"), pa.array(size), *(pa.array(words[:, k].view(np.int64)) for k in range(SIGN_WORDS))], names=["line", "size", *SIGNS])


SIGNS = [f"sign{k}" for k in range(SIGN_WORDS)]


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line) of rows with a possible partner of another component that lengths and bigrams allow, too."""
    for table, cut in _whole(batches):
        size = table.column("size").to_numpy()
        most = np.maximum(EDITS, np.sqrt(size // CHARS + 0.5).astype(np.int64))
        words = [table.column(x).to_numpy() for x in SIGNS]
        seen = np.zeros(table.num_rows, bool)
        for p, q, _ in _possible(table, cut):
            near = np.minimum(most[p], most[q])
            ok = np.abs(size[p] - size[q]) <= near
            p, q, near = p[ok], q[ok], near[ok]
            unlike = sum((np.bitwise_count((w[p] ^ w[q]).view(np.uint64)).astype(np.int64) for w in words), np.zeros(len(p), np.int64))
            ok = unlike <= 4 * near
            seen[p[ok]] = seen[q[ok]] = True
        if seen.any():
            own = pa.array(np.flatnonzero(seen))
            yield pa.RecordBatch.from_arrays([table.column(x).combine_chunks().take(own) for x in ("key", "line")], names=["key", "line"])


def forest(texts: list[str], comp: np.ndarray, cut: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join all lines of each group that are linked, apart from those that comp joins already.

    cut: where each group begins, then the end. Pairs that lengths and counts of characters allow, the most alike
    first, many groups' at once; those that links have joined meanwhile aren't checked.
    """
    lines = [points(t) for t in texts]
    size = np.array([len(x) for x in lines], np.int64)
    most = np.maximum(EDITS, np.sqrt(size // CHARS + 0.5).astype(np.int64))
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(lines)), size)
    bins = np.bincount(owner * BINS + np.concatenate([np.zeros(0, np.uint32), *lines]) % BINS, minlength=len(lines) * BINS).reshape(-1, BINS).astype(np.int16) if len(ends) else np.zeros((0, BINS), np.int16)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            if above[x] in above:
                above[x] = above[above[x]]
            x = above[x]
        return x

    found: list[tuple[int, int]] = []
    for i, j in pairs_within(cut[:-1], np.diff(cut)):
        near = np.minimum(most[i], most[j])
        ok = (comp[i] != comp[j]) & (np.abs(size[i] - size[j]) <= near)
        i, j, near = i[ok], j[ok], near[ok]
        unlike = np.concatenate([np.zeros(0, np.int64), *(np.abs(bins[i[k : k + 8192]] - bins[j[k : k + 8192]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 8192))])
        ok = unlike <= 2 * near
        order = np.argsort(unlike[ok] - 2 * near[ok], kind="stable")
        i, j, near = i[ok][order], j[ok][order], near[ok][order]
        at, step = 0, PAIRS
        while at < len(i):
            now = [k for k in range(at, min(at + step, len(i))) if top(int(comp[i[k]])) != top(int(comp[j[k]]))]
            if now:
                ok = within([lines[i[k]] for k in now], [lines[j[k]] for k in now], near[now])
                for k in np.array(now)[ok].tolist():
                    x, y = top(int(comp[i[k]])), top(int(comp[j[k]]))
                    if x != y:
                        above[x] = y
                        found.append((int(i[k]), int(j[k])))
            at, step = at + step, min(2 * step, 16 * PAIRS)
    return found


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, cut in _whole(batches, 1 << 12):
        line = table.column("line").to_numpy()
        links = forest(table.column("words").to_pylist(), table.column("comp").to_numpy(), cut)
        yield pa.RecordBatch.from_arrays([pa.array(line[[i for i, _ in links]]), pa.array(line[[j for _, j in links]])], names=["a", "b"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4 * PAIRS):
            rows = batch.slice(at, 4 * PAIRS)
            xs, ys = ([points(t) for t in rows.column(c).to_pylist()] for c in ("s", "t"))
            ok = pa.array(within(xs, ys, np.array([edits(min(len(x), len(y))) for x, y in zip(xs, ys, strict=True)])))
            yield pa.RecordBatch.from_arrays([rows.column("a").filter(ok), rows.column("b").filter(ok)], names=["a", "b"])


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """df (key, n: the key's rows, line, ...) with column part: a larger group is cut into blocks, each pair of blocks a part."""
    m = F.ceil(F.col("n") / size).cast("int")
    cut = df.select("*", m.alias("m"), F.pmod(F.xxhash64("line"), m).cast("int").alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("y"))
    part = F.least("x", "y") * F.col("m") + F.greatest("x", "y")
    return cut.withColumn("part", part.cast("bigint")).drop("m", "x", "y", "n")


def _dealt(df: DataFrame) -> DataFrame:
    """Groups whole and sorted; in as many partitions as are set, as few bytes can be much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "part").sortWithinPartitions("key", "part")


def _texts(spark: SparkSession, own: DataFrame, where: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, words) of the wanted lines, each from one document that has it."""
    wanted = stash(spark, wanted)
    few = wanted.count() <= BROADCAST
    wanted = F.broadcast(wanted) if few else wanted
    at = where.select("r", F.explode("lines").alias("line")).join(wanted, "line", "left_semi").groupBy("line").agg(F.min("r").alias("r")).select("r").distinct()
    docs = own.join(F.broadcast(at) if few else at, "r", "left_semi").select(F.explode(F.split("text", "\n")).alias("words"))
    return stash(spark, docs.where(F.length("words") >= MIN_CHARS).select(F.xxhash64("words").alias("line"), "words").join(wanted, "line", "left_semi").dropDuplicates(["line"]))


def line_classes(spark: SparkSession, own: DataFrame, where: DataFrame) -> DataFrame | None:
    """(c, comp): classes of line hashes with more than one line; None if there is none.

    own has the documents (r, text), where their long lines and bytes (r, lines, size)."""
    buckets = max(1, (where.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES)
    rows = mapped(own.select("text"), _keys(buckets), "bucket bigint, kind int, rows binary").repartition("bucket").sortWithinPartitions("bucket")
    shared = stash(spark, mapped(rows, _shared, "key bigint, line bigint, tag int").distinct())
    # keys of more rows than a block
    large = stash(spark, shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key"))
    any_large = not large.isEmpty()

    def apart(comps: DataFrame | None, rows: DataFrame, signed: DataFrame | None = None) -> DataFrame:
        """Rows with their components, those of large groups that hold two cut into blocks; signed: what further to have of each line."""
        if comps is not None and comps.count() <= BROADCAST:
            comps = F.broadcast(comps)

        def owned(rows: DataFrame) -> DataFrame:
            return rows.withColumn("comp", F.col("line")) if comps is None else rows.join(comps, F.col("line") == F.col("c"), "left").select("key", "line", "tag", F.coalesce("comp", "line").alias("comp"))

        now = owned(rows)
        if any_large:
            # a row for BLOCK rows of the table at most
            held = owned(rows.join(F.broadcast(large), "key", "left_semi")).groupBy("key").agg(F.count("*").alias("n"), (F.min("comp") < F.max("comp")).alias("mixed"))
            now = _blocks(now.join(F.broadcast(held), "key", "left").where("n is null or mixed").drop("mixed").withColumn("n", F.coalesce("n", F.lit(1))), BLOCK)
        else:
            now = now.withColumn("part", F.lit(0).cast("bigint"))
        if signed is not None:
            now = now.join(signed, "line")
        return _dealt(now.select("key", "part", "line", "tag", "comp", *(["size", *SIGNS] if signed is not None else [])))

    few = shared.where(F.shiftright("key", 4) % FIRST_KEYS == 0)
    pairs = stash(spark, mapped(apart(None, few), _candidates, "a bigint, b bigint").distinct())
    texts = _texts(spark, own, where, pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct())
    both = pairs.join(texts.select(F.col("line").alias("a"), F.col("words").alias("s")), "a").join(texts.select(F.col("line").alias("b"), F.col("words").alias("t")), "b")
    comps = merged(spark, None, stash(spark, mapped(both, _check, "a bigint, b bigint")))
    doubtful = stash(spark, mapped(apart(comps, shared), _doubtful, "key bigint, line bigint, tag int").distinct())
    if doubtful.isEmpty():
        return comps
    texts = _texts(spark, own, where, doubtful.select("line").distinct())
    signed = stash(spark, mapped(texts, _signs, "line bigint, size bigint, " + ", ".join(f"{x} bigint" for x in SIGNS)))
    doubtful = stash(spark, mapped(apart(comps, doubtful, signed), _alike, "key bigint, line bigint").distinct())
    if doubtful.isEmpty():
        return comps
    # lines that a key holds together form a cluster: each hangs on the key's least line
    star = doubtful.join(doubtful.groupBy("key").agg(F.min("line").alias("least")), "key").select(F.col("line").alias("a"), F.col("least").alias("b"))
    cluster = components(spark, star).select(F.col("node").alias("line"), F.col("component").alias("key"))
    cluster = cluster.join(cluster.groupBy("key").agg(F.count("*").alias("n")), "key")
    if comps is not None:
        cluster = cluster.join(comps, F.col("line") == F.col("c"), "left").select("key", "n", "line", F.coalesce("comp", "line").alias("comp"))
    else:
        cluster = cluster.withColumn("comp", F.col("line"))
    cluster = stash(spark, cluster)
    dealt = _dealt(_blocks(cluster, CLUSTER_BLOCK).join(texts, "line").select("key", "part", "line", "comp", "words"))
    return merged(spark, comps, stash(spark, mapped(dealt, _clusters, "a bigint, b bigint").distinct()))


DEDUPED = "n_lines bigint, n_removed bigint, kept_sha256 string, kept string"


def dedup_lines(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, short: bool = False) -> DataFrame:
    """key, n_lines, n_removed, kept_sha256, kept (lines left, joined by line feeds; null without with_text): a row for each row of df.

    Lines are what line feeds separate, white space and case kept. Of those shorter than MIN_CHARS only
    exact copies are removed, and that if short; else they always stay. Short lines without a word stay.
    Of each class the line of the least key (null last), then least hash of the text, then least place
    stays. Rows equal in key and text are one document in this. A null text is empty: one empty line.
    """
    kind = df.schema[key].dataType.simpleString()
    own = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.xxhash64("k", "text").alias("r"), "k", "text")
    where = stash(spark, mapped(own, _lines(short), f"r bigint, k {kind}, lines array<bigint>, places array<int>, size bigint"))
    with scratch(spark) as keep:
        comps = keep(line_classes(spark, own, where))
    places = where.select("r", "k", F.explode(F.arrays_zip("lines", "places")).alias("x")).select("r", "k", F.col("x.lines").alias("line"), F.col("x.places").alias("place"))
    # lines that occur once and resemble none stay
    doubtful = places.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    if comps is not None:
        doubtful = doubtful.union(comps.select("c")).distinct()
    doubtful = stash(spark, doubtful)
    where = stash(spark, places.join(F.broadcast(doubtful) if doubtful.count() <= BROADCAST else doubtful, "line", "left_semi"))
    first = F.min(F.struct(F.col("k").isNull().alias("last"), "k", "r", "place")).alias("first")
    firsts = where.groupBy("line").agg(first)
    if comps is not None:
        firsts = firsts.join(comps.select(F.col("c").alias("line"), "comp"), "line", "left").select("line", "first", F.coalesce("comp", "line").alias("comp"))
        firsts = firsts.select("line", "comp", "first").join(firsts.groupBy("comp").agg(F.min("first").alias("best")), "comp").select("line", F.col("best").alias("first"))
    gone = where.join(firsts, "line").where("first.r <> r or first.place <> place").select("r", "place").distinct()
    cut = stash(spark, gone.groupBy("r").agg(F.collect_list("place").alias("gone"), F.count("*").alias("n")))
    if (cut.agg(F.sum("n")).first()[0] or 0) <= BROADCAST:
        cut = F.broadcast(cut)
    cut = cut.select("r", "gone")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                rows = text.split("\n")
                drop = set(gone or ())
                kept = [x for k, x in enumerate(rows) if k not in drop] if drop else rows
                rest = "\n".join(kept)
                for column, value in zip(out, (len(rows), len(rows) - len(kept), hashlib.sha256(rest.encode()).hexdigest(), rest if with_text else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=[key, "n_lines", "n_removed", "kept_sha256", "kept"])

    return mapped(own.join(cut, "r", "left").select("k", "text", "gone"), strip, f"`{key}` {kind}, {DEDUPED}")
