"""Byte-level BPE encoding and decoding with a public vocabulary.

Pre-tokenisation runs over arrays of codepoint classes, without regex. Each code point carries one of
two transition functions of the position where its run began, "stay" or "begin here"; composing them is
associative, so one running maximum yields every code point's run at once. From runs and their neighbours
follow the boundaries: where a run begins, where its white space belongs to the next one, and where an
apostrophe that is a run of its own takes letters with it. The slices feed a cache of merged pairs; their offsets are retained.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, mapped

L, N, S, O = range(4)
#: Bytes of a worker's cache of merged slices (about 200 an entry beside its text). A half that is full gives way to
#: a new one, which takes over what is asked for again; results don't depend on it.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 200
#: Bytes of text whose slices are held at once.
SLICED_BYTES = 1 << 20
#: Unicode's White_Space, fixed values.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    if not _CLASSES:
        kinds = {"L": L, "N": N}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        table[list(WHITE_SPACE)] = S
        _CLASSES.append(table)
    return _CLASSES[0]


def boundaries(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the slices of PATTERN in the code points of texts laid end to end (bounds: theirs)."""
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[cp]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]  # of texts that aren't empty
    begins = np.ones(n, dtype=bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[heads] = True
    head = np.zeros(n + 1, dtype=bool)
    head[heads] = True
    head[n] = True
    # the scan: where each code point's run began
    run = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    cut = run == np.arange(n)
    # The last white space before a visible run is cut off; a blank there joins that run.
    after = np.flatnonzero(begins & (kind != S) & ~head[:n])
    after = after[kind[after - 1] == S]
    cut[after - 1] = True
    cut[after[cp[after - 1] == 0x20]] = False
    # 's 't 'm 'd 're 've 'll where an apostrophe alone is a run at a slice's start.
    marks = np.flatnonzero((cp == 0x27) & cut)
    marks = marks[marks + 1 < n]
    if len(marks):
        marks = marks[(run[marks] == marks) & ~head[marks + 1] & (kind[marks + 1] == L)]
        a = cp[marks + 1]
        room = (marks + 2 < n) & ~head[np.minimum(marks + 2, n)]
        b = np.where(room, cp[np.minimum(marks + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~one & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for found, size in ((marks[one], 2), (marks[two], 3)):
            cut[found + 1] = False
            rest = found + size
            rest = rest[rest < n]
            rest = rest[~head[rest] & (kind[rest] == L)]
            cut[rest] = True
    return np.flatnonzero(cut)


class Coder(dict):
    """Slices to packed ids (little-endian unsigned 32-bit), filled on demand."""

    def __init__(self, vocabulary: bytes) -> None:
        self.held, self.old = 0, {}
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece

    def __missing__(self, slice_: str) -> bytes:
        packed, size = self.old.get(slice_), len(slice_)
        if packed is None:
            raw = slice_.encode("utf-8")
            whole, size = self.ranks.get(raw), len(raw)
            packed = np.array([whole] if whole is not None else self.merge(raw), dtype="<u4").tobytes()
        if size <= 256:
            self.held += ENTRY_BYTES + 2 * size
            if 2 * self.held > CACHE_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self[slice_] = packed
        return packed

    def merge(self, raw: bytes) -> list[int]:
        """Joins the pair of lowest rank, leftmost first, until none is in the vocabulary."""
        get, n = self.ranks.get, len(raw)
        if n < 48:
            parts = [raw[i : i + 1] for i in range(n)]
            rank = [get(raw[i : i + 2]) for i in range(n - 1)]
            while True:
                low, at = None, -1
                for i, r in enumerate(rank):
                    if r is not None and (low is None or r < low):
                        low, at = r, i
                if low is None:
                    return [self.ranks[p] for p in parts]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del rank[at]
                if at < len(rank):
                    rank[at] = get(parts[at] + parts[at + 1])
                if at:
                    rank[at - 1] = get(parts[at - 1] + parts[at])
        end, before, after = [i + 1 for i in range(n)], list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) < n and (r := get(raw[k : end[m]])) is not None:
                    heapq.heappush(heap, (r, k, end[m]))
        return [self.ranks[raw[i : end[i]]] for i in range(n) if end[i]]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def slices(data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The slices of texts laid end to end, their starts in code points, and each text's bounds among them."""
    text = data.tobytes().decode("utf-8")
    cp = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ahead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=ahead[1:])
    ends = ahead[bounds]
    starts = boundaries(cp, ends)
    return [text[a:b] for a, b in pairwise([*starts.tolist(), len(cp)])], starts, np.searchsorted(starts, ends)


_CODERS: dict[str, Coder] = {}


def _coder(name: str, vocabulary: bytes) -> Coder:
    if name not in _CODERS:
        _CODERS[name] = Coder(vocabulary)
    return _CODERS[name]


def encode_texts(spark: SparkSession, df: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("ids", "offsets", "decoded")) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and, as asked for: ids (array of int), offsets (the code
    point at which each pre-token begins) and decoded (the text got back from the ids).

    Null and empty texts have no token; the hashes are those of no bytes. The vocabulary (a fixed file of
    under 1 MB, read on the driver) goes to the executors by broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        raw = f.read()
    sent, mark = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()
    extra = {"ids": "array<int>", "offsets": "array<int>", "decoded": "string"}
    kind = df.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(mark, sent.value)
        for rows, data, bounds in chunks(batches, text, SLICED_BYTES):
            cut, starts, own = slices(data, bounds)
            packed = list(map(coder.__getitem__, cut))
            out: dict[str, list] = {x: [] for x in names[1:]}
            low = 0
            for a, b in pairwise(own.tolist()):
                ids = b"".join(packed[a:b])
                back = coder.decode(ids)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                if "ids" in keep:
                    out["ids"].append(np.frombuffer(ids, dtype="<i4"))
                if "offsets" in keep:
                    low = int(starts[a]) if b > a else low
                    out["offsets"].append((starts[a:b] - low).astype(np.int32))
                if "decoded" in keep:
                    out["decoded"].append(back.decode("utf-8"))
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "offsets": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(out[x], types.get(x, pa.string())) for x in names[1:])], names=names)

    return mapped(df.select(key, text), run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {x} {extra[x]}" for x in keep))
