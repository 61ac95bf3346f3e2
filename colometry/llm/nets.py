"""Small convolutional text classifiers, trained in numpy on a bounded sample, applied to whole texts.

Language: a byte network. Filters of several widths slide over fixed-length windows of bytes, each
filter's maximum over the window feeds a softmax; windows cover the whole text and their log
probabilities add up. Toxicity: a word network. Each word's embedding is the sum of hashed embeddings of
the word and its beginnings; filters of several widths slide over all words of the text, each filter's
maximum feeds a logistic output. A filter over an embedding is a sum of table look-ups (the embedding
times one slice of the filter), so applying a net needs gathers and additions only.

Training reads at most a documented number of labelled rows, picked by a hash of the id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fold32, lowered, mapped, mix, prefix_sums, range_hash, spans

# ---------------------------------------------------------------- shared: Adam


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray] | None = None) -> None:
        """rows: for a parameter whose gradient holds these rows only (lazy Adam)."""
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at = (rows or {}).get(k, slice(None))
            m = self.m[k][at] * np.float32(0.9) + np.float32(0.1) * g
            v = self.v[k][at] * np.float32(0.999) + np.float32(0.001) * g * g
            self.m[k][at], self.v[k][at] = m, v
            self.p[k][at] -= np.float32(scale) * m / (np.sqrt(v) + np.float32(1e-7))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


# ---------------------------------------------------------------- language: bytes

WINDOW = 256
BYTE_WIDTHS, BYTE_FILTERS, BYTE_DIM = (2, 3, 4), 12, 8
#: Labelled documents taken to fit, per language, and languages at most; each gives up to SAMPLE_CHARS characters.
LANG_SAMPLE, SAMPLE_CHARS = 400, 1500


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of WINDOW bytes that cover each text (the last one padded with 0), and each row's text."""
    sizes = np.diff(bounds)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (bounds[owner] + place * WINDOW)[:, None] + np.arange(WINDOW)
    inside = at < bounds[owner + 1][:, None]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0), owner


class ByteNet:
    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.labels = labels
        self.p = {"E": rng.normal(0, 0.5, (256, BYTE_DIM)).astype(f32), "O": rng.normal(0, 0.1, (BYTE_FILTERS * len(BYTE_WIDTHS), len(labels))).astype(f32), "o": np.zeros(len(labels), f32)}
        for w in BYTE_WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * BYTE_DIM), (w, BYTE_DIM, BYTE_FILTERS)).astype(f32)
            self.p[f"b{w}"] = np.zeros(BYTE_FILTERS, f32)
        self.tables: dict | None = None

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of all filters over each row of x, and the places of the maxima if wanted."""
        outs, places = [], []
        for w in BYTE_WIDTHS:
            tables = self.p["E"] @ self.p[f"W{w}"]
            n = x.shape[1] - w + 1
            z = tables[0][x[:, :n]]
            for k in range(1, w):
                z += tables[k][x[:, k : k + n]]
            if where:
                at = z.argmax(axis=1)
                places.append(at)
                outs.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.p[f"b{w}"])
            else:
                outs.append(z.max(axis=1) + self.p[f"b{w}"])
        return np.concatenate(outs, axis=1), places

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNet:
        rng, adam = np.random.default_rng(seed), Adam(self.p, rate)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                own = order[i : i + batch]
                h, places = self.pooled(x[own], True)
                act = np.maximum(h, 0)
                d = softmax(act @ self.p["O"] + self.p["o"])
                d[np.arange(len(own)), y[own]] -= 1
                d /= len(own)
                grads = {"O": act.T @ d, "o": d.sum(0), "E": np.zeros_like(self.p["E"])}
                dh = (d @ self.p["O"].T) * (h > 0)
                for j, w in enumerate(BYTE_WIDTHS):
                    g = dh[:, j * BYTE_FILTERS : (j + 1) * BYTE_FILTERS]
                    grads[f"b{w}"] = g.sum(0)
                    dw = np.zeros_like(self.p[f"W{w}"])
                    for k in range(w):
                        seen = x[own][np.arange(len(own))[:, None], places[j] + k]
                        dt = np.zeros((256, BYTE_FILTERS), np.float32)
                        np.add.at(dt, (seen, np.arange(BYTE_FILTERS)[None, :]), g)
                        dw[k] = self.p["E"].T @ dt
                        grads["E"] += dt @ self.p[f"W{w}"][k].T
                    grads[f"W{w}"] = dw
                adam.step(grads)
        return self

    def ready(self) -> ByteNet:
        """Tables for pairs of bytes, so that width 2 takes one gather, 3 and 4 two."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        t = {w: self.p["E"] @ self.p[f"W{w}"] for w in BYTE_WIDTHS}
        self.tables = {2: pair(*t[2]), 3: (pair(t[3][0], t[3][1]), t[3][2]), 4: (pair(t[4][0], t[4][1]), pair(t[4][2], t[4][3]))}
        return self

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Of each row of windows, in blocks that stay in the cache."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        for i in range(0, len(x), 32):
            own = x[i : i + 32].astype(np.int32)
            two = (own[:, :-1] << 8) | own[:, 1:]
            h = [self.tables[2].take(two, 0).max(axis=1)]
            z = self.tables[3][0].take(two[:, :-1], 0)
            z += self.tables[3][1].take(own[:, 2:], 0)
            h.append(z.max(axis=1))
            z = self.tables[4][0].take(two[:, :-2], 0)
            z += self.tables[4][1].take(two[:, 2:], 0)
            h.append(z.max(axis=1))
            act = np.maximum(np.concatenate([a + self.p[f"b{w}"] for a, w in zip(h, BYTE_WIDTHS, strict=True)], axis=1), 0)
            out[i : i + 32] = np.log(softmax(act @ self.p["O"] + self.p["o"]) + 1e-9)
        return out


def train_language(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = LANG_SAMPLE) -> ByteNet | None:
    """Fits on rows whose fold isn't 2 and whose lang isn't null: about sample rows of each language (all
    of a rarer one), picked by a hash of the id; None if there is no such row."""
    usable = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.coalesce(fold32("k"), F.lit(0)) != 2).where("l is not null and t rlike '\\\\p{L}'")
    counts = {r.l: r.n for r in usable.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, sample / n))])
    u = (F.xxhash64("k", F.lit(11)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    room = F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("k", F.lit(13)), room.cast("long")) + 1
    rows = usable.where(u < share[F.col("l")]).select("k", "l", F.col("t").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"))
    found = sorted(rows.orderBy("k").limit(2 * sample * len(counts)).collect(), key=lambda r: (str(r.k), r.l, r.t))
    labels = sorted(counts)
    xs, ys = [], []
    for r in found:
        raw = np.frombuffer(r.t.encode(), np.uint8)
        x, _ = windows(raw, np.array([0, len(raw)]))
        xs.append(x)
        ys += [labels.index(r.l)] * len(xs[-1])
    if not ys:
        return None
    return ByteNet(labels).fit(np.concatenate(xs), np.array(ys)).ready()


def predict_language(spark: SparkSession, df: DataFrame, net: ByteNet | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score. Windows cover the whole text. A null text, or one without a letter, is
    `und` with score 1; so is every text if there is no net (nothing to learn from)."""
    sent, kind = spark.sparkContext.broadcast(net), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for rows, data, bounds in chunks(batches, "t"):
            some = np.array(rows.column("has").fill_null(False).to_pylist(), dtype=bool)
            names, scores = ["und"] * len(some), np.ones(len(some))
            if net is not None and some.any():
                x, owner = windows(data, bounds)
                total = np.zeros((len(some), len(net.labels)))
                z, heads = net.log_probs(x), np.flatnonzero(np.diff(bounds) > 0)
                total[heads] = np.add.reduceat(z, np.searchsorted(owner, heads), axis=0)
                p = softmax(total / np.maximum(1, -(-np.diff(bounds) // WINDOW))[:, None])
                best = p.argmax(axis=1)
                for i in np.flatnonzero(some):
                    names[i], scores[i] = net.labels[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names), pa.array(scores)], names=[key, "lang_pred", "score"])

    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return mapped(df.select(F.col(key), has.alias("has"), F.col(text).alias("t")), run, f"`{key}` {kind}, lang_pred string, score double")


# ---------------------------------------------------------------- toxicity: words

BUCKETS, WORD_DIM, WORD_FILTERS, WORD_WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
#: Bytes of a word's beginnings that have embeddings of their own, beside the whole word.
BEGINNINGS = (4, 5)
#: Labelled documents taken to fit, for each of the two labels, and the bytes of text they may have together.
TOXIC_SAMPLE, TOXIC_BYTES = 1500, 24 << 20
#: Characters that a labelled document gives.
TOXIC_CHARS = 20_000
THRESHOLD = 0.3
#: Share of words that are blank in a training step, so that no document is known by one of its words.
WORD_DROPOUT = 0.5


def _letters() -> np.ndarray:
    """Bytes that belong to a word here: ASCII letters and digits and all bytes over 127."""
    keep = np.zeros(256, dtype=bool)
    keep[[*range(48, 58), *range(97, 123)]] = True
    keep[128:] = True
    return keep


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words x 1 + beginnings) of all words, two blank rows (-1) before each text, and each text's bounds among them.

    So a filter that begins in a text ends in it, or in the blank rows of the next one.
    """
    low = np.where(_letters()[lowered(data)], lowered(data), 32).astype(np.uint8)
    starts, ends, own = spans(low, bounds)
    sums, size = prefix_sums(low), ends - starts
    cols = [range_hash(sums, starts, ends)]
    for k in BEGINNINGS:  # a word no longer than the beginning has the word's own bucket once more
        cols.append(mix(range_hash(sums, starts, np.minimum(starts + k, ends)) + np.uint64(k) * (size > k).astype(np.uint64)))
    hashed = (np.stack(cols, axis=1) % np.uint64(BUCKETS)).astype(np.int32)
    places = own + 2 * np.arange(len(own))
    out = np.full((len(hashed) + 2 * (len(own) - 1), hashed.shape[1]), -1, dtype=np.int32)
    out[np.arange(len(hashed)) + 2 * np.repeat(np.arange(1, len(own)), np.diff(own))] = hashed
    return out, places


class WordNet:
    def __init__(self, seed: int = 5) -> None:
        rng, f32 = np.random.default_rng(seed), np.float32
        self.p = {"E": rng.normal(0, 0.02, (BUCKETS + 1, WORD_DIM)).astype(f32), "O": rng.normal(0, 0.3, WORD_FILTERS * len(WORD_WIDTHS)).astype(f32), "o": np.zeros(1, f32)}
        for w in WORD_WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(WORD_DIM), (w, WORD_DIM, WORD_FILTERS)).astype(f32)
            self.p[f"b{w}"] = np.zeros(WORD_FILTERS, f32)
        self.p["E"][-1] = 0  # of blank rows
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def pooled(self, f: np.ndarray, places: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Maxima of filters over each text. A text without words has its two blank rows."""
        e = self.p["E"][f[:, 0]]
        for j in range(1, f.shape[1]):
            e = e + self.p["E"][f[:, j]]
        outs, at = [], []
        for w in WORD_WIDTHS:
            z = e @ self.p[f"W{w}"][0]
            for k in range(1, w):
                z[:-k] += e[k:] @ self.p[f"W{w}"][k]
            h = np.maximum.reduceat(z, places[:-1], axis=0)
            outs.append(h + self.p[f"b{w}"])
            if where:
                same = z == np.repeat(h, np.diff(places), axis=0)
                at.append(np.stack([places[:-1] + np.array([same[a:b, c].argmax() for a, b in zip(places[:-1], places[1:], strict=True)]) for c in range(WORD_FILTERS)], axis=1))
        return np.concatenate(outs, axis=1), at, e

    def logits(self, f: np.ndarray, places: np.ndarray) -> np.ndarray:
        h, _, _ = self.pooled(f, places)
        return np.maximum(h, 0) @ self.p["O"] + self.p["o"][0]

    def scores(self, f: np.ndarray, places: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(f, places).astype(np.float64) + self.shift, -40, 40)))

    def fit(self, texts: list[tuple[np.ndarray, float]], epochs: int = 6, batch: int = 32, rate: float = 0.02, seed: int = 5) -> WordNet:
        """texts: (features of one text with its two blank rows, label)."""
        rng, adam = np.random.default_rng(seed), Adam(self.p, rate)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                own = [texts[j] for j in order[i : i + batch]]
                f = np.concatenate([x for x, _ in own])
                f[rng.random(len(f)) < WORD_DROPOUT] = -1
                places = np.concatenate([[0], np.cumsum([len(x) for x, _ in own])])
                h, at, e = self.pooled(f, places, True)
                act = np.maximum(h, 0)
                z = act @ self.p["O"] + self.p["o"][0]
                d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - np.array([y for _, y in own])).astype(np.float32) / len(own)
                grads = {"O": act.T @ d, "o": d.sum(keepdims=True)}
                dh = np.outer(d, self.p["O"]) * (h > 0)
                rows, parts = [], []
                for j, w in enumerate(WORD_WIDTHS):
                    g = dh[:, j * WORD_FILTERS : (j + 1) * WORD_FILTERS]
                    grads[f"b{w}"] = g.sum(0)
                    dw = np.zeros_like(self.p[f"W{w}"])
                    for k in range(w):
                        seen = np.where(at[j] + k < len(f), at[j] + k, 0)  # row 0 is blank
                        dw[k] = np.einsum("tfd,tf->df", e[seen], g)
                        de = (g[:, :, None] * self.p[f"W{w}"][k].T[None]).reshape(-1, WORD_DIM)
                        for c in range(f.shape[1]):
                            rows.append(f[seen.ravel(), c])
                            parts.append(de)
                    grads[f"W{w}"] = dw
                r, g = np.concatenate(rows), np.concatenate(parts)
                live = (r >= 0) & (np.abs(g).max(axis=1) > 0)
                ids, inverse = np.unique(r[live], return_inverse=True)
                total = np.zeros((len(ids), WORD_DIM), np.float32)
                np.add.at(total, inverse, g[live])
                grads["E"] = total
                adam.step(grads, {"E": ids})
                self.p["E"][-1] = 0
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Platt scaling by gradient steps on weighted log loss, labels smoothed as Platt does."""
        a, b = 1.0, 0.0
        up, down = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        for _ in range(400):
            d = (1 / (1 + np.exp(-np.clip(a * z + b, -40, 40))) - target) * weight / weight.sum()
            a, b = a - 0.3 * float((d * z).sum()), b - 1.0 * float(d.sum())
        self.scale, self.shift = max(a, 1e-3), b


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap at which F1 is largest; THRESHOLD if a label is missing."""
    if not 0 < y.sum() < len(y):
        return THRESHOLD
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = score[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((score[order[k]] + below) / 2)


def train_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = TOXIC_SAMPLE) -> WordNet | None:
    """Fits on labelled rows whose fold isn't 2: about sample of each label, picked by a hash of the id.

    Null labels and texts don't count. Scores are Platt-scaled to the labels' true shares on a fifth of
    the sample that isn't fitted; thresholds are calibrated there by language, for those who know it (the
    score itself never sees it). None if a label is missing.
    """
    marks = labels.select(F.col(key).alias("k"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1)").where(fold32("k") != 2)
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    u = (F.xxhash64("k", F.lit(17)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    some = marks.where(u < F.when(F.col("y") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))).dropDuplicates(["k"])
    some = some.orderBy("k").limit(4 * sample)  # 2 * sample rows in expectation
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null")
    # a long text gives the part of it that begins at a place named by its id; an id that recurs gives one text
    start = F.pmod(F.xxhash64("k", F.lit(19)), F.greatest(F.length("t") - TOXIC_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = own.join(F.broadcast(some), "k").select("k", "y", "l", F.substring("t", start, F.lit(TOXIC_CHARS)).alias("t")).groupBy("k").agg(F.min(F.struct("t", "l", "y")).alias("r")).select("k", "r.*")
    taken, room = [], TOXIC_BYTES
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.t)):  # 4 * sample rows of TOXIC_CHARS characters at most
        raw = np.frombuffer(r.t.encode(), np.uint8)
        if len(raw) <= room:
            room -= len(raw)
            taken.append((features(raw, np.array([0, len(raw)]))[0], float(r.y), r.l))
    fifth = [i for i in range(len(taken)) if i % 5 == 4]
    shown = [(f, y) for i, (f, y, _) in enumerate(taken) if i % 5 != 4]
    net = WordNet().fit(shown, epochs=int(np.clip(16_000 // max(1, len(shown)), 6, 40)))  # few rows are shown more often
    held = [taken[i] for i in fifth] or taken
    places = np.concatenate([[0], np.cumsum([len(f) for f, _, _ in held])])
    everything = np.concatenate([f for f, _, _ in held])
    y = np.array([y for _, y, _ in held])
    z = net.logits(everything, places).astype(np.float64)
    net.calibrate(z, y, np.where(y > 0, counts[1] / max(1, y.sum()), counts[0] / max(1, len(y) - y.sum())))
    s = net.scores(everything, places)
    for name in sorted({x for _, _, x in held if x}):
        at = np.array([x == name for _, _, x in held])
        net.thresholds[name] = best_threshold(s[at], y[at])
    return net


def score_toxicity(spark: SparkSession, df: DataFrame, net: WordNet | None, key: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """key, score, predicted (score >= 0.3); with lang, a column, also predicted_lang, by the threshold of
    the row's language (0.3 for one without). Null and empty texts have the score of no words, near 0;
    without a net (a label missing) every score is 0."""
    sent, kind = spark.sparkContext.broadcast(net), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for rows, data, bounds in chunks(batches, text, 1 << 20):
            s = np.zeros(rows.num_rows) if net is None else net.scores(*features(data, bounds))
            out = [rows.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]
            if lang is not None:
                own = {} if net is None else net.thresholds
                least = np.array([own.get(x, THRESHOLD) for x in rows.column("l").to_pylist()], dtype=float)
                out.append(pa.array((s >= least).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, names=[key, "score", "predicted", "predicted_lang"][: len(out)])

    if lang is not None:
        return mapped(df.select(key, text, F.col(lang).alias("l")), run, f"`{key}` {kind}, score double, predicted int, predicted_lang int")
    return mapped(df.select(key, text), run, f"`{key}` {kind}, score double, predicted int")
