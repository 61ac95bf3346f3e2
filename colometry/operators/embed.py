"""Embedders: anything that maps a list of texts to a list of vectors, loaded once a worker.

Texts are embedded once each: distinct first, joined back afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .align import semantic_scores

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Deterministic: character 3-grams hashed with signs, normalised. Needs no model."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dimension)
            for i in range(max(1, len(text) - 2)):
                h = int.from_bytes(hashlib.blake2b(text[i : i + 3].encode(), digest_size=8).digest(), "big")
                v[h % dimension] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out

    return embed


def get_embedder(name: str = "hash", **options) -> Callable[[], Embedder]:
    """A loader to call on the worker. Model embedders are optional extras; what isn't installed says so."""
    if name == "hash":
        return lambda: hashing_embedder(options.get("dimension", 64))
    if name == "bge":

        def load_bge() -> Embedder:
            from FlagEmbedding import BGEM3FlagModel

            model = BGEM3FlagModel(options.get("model", "BAAI/bge-m3"), use_fp16=options.get("device", "cpu") != "cpu")
            return lambda texts: model.encode(texts)["dense_vecs"].tolist()

        return load_bge
    if name == "openai":

        def load_openai() -> Embedder:
            from openai import OpenAI

            client = OpenAI(api_key=options.get("api_key"))
            model = options.get("model", "text-embedding-3-large")
            return lambda texts: [d.embedding for d in client.embeddings.create(input=texts, model=model).data]

        return load_openai
    raise ValueError(f"no such embedder: {name}")


def embed(df: DataFrame, text: str, loader: Callable[[], Embedder], out: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in model(texts.fillna("").tolist())])

    vectors = df.select(F.col(text).alias("_t")).distinct().select("_t", run("_t").alias(out))
    return df.join(vectors, F.col(text).eqNullSafe(F.col("_t"))).drop("_t")


#: Rows scored at once, texts embedded at once, products of words and units held at once, and bytes of vectors remembered between rows.
ROWS, TEXTS, CELLS, KNOWN = 64, 2048, 1 << 22, 24 << 20


def _best_units(units: list[list[str] | None], words: list[list[str] | None], model: Embedder, known: dict[str, np.ndarray]) -> pa.Array:
    """Each row's (best_src_idx, similarity) of its words. known: vectors of earlier rows' texts, begun anew beyond KNOWN bytes."""
    texts = {t for column in (units, words) for row in column if row is not None for t in row}
    if known and len(known) * next(iter(known.values())).nbytes > KNOWN:
        known.clear()
    missing = sorted(texts - known.keys())
    for k in range(0, len(missing), TEXTS):
        some = missing[k : k + TEXTS]
        known.update(zip(some, np.asarray(model(some), dtype=float).reshape(len(some), -1), strict=True))
    ends, best, similar = [0], [], []
    for u, w in zip(units, words, strict=True):
        if u and w:
            b = np.stack([known[t] for t in u])
            norms, step = np.linalg.norm(b, axis=1), max(1, CELLS // len(u))
            for k in range(0, len(w), step):
                a = np.stack([known[t] for t in w[k : k + step]])
                found = (a @ b.T) / (np.outer(np.linalg.norm(a, axis=1), norms) + 1e-8)
                best.append(found.argmax(axis=1))
                similar.append(found[np.arange(len(a)), best[-1]])
        ends.append(ends[-1] + (len(w) if u and w else 0))
    columns = [pa.array(np.concatenate([np.zeros(0), *x]).astype(kind)) for x, kind in ((best, np.int32), (similar, np.float64))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["best_src_idx", "similarity"]))


def embedded(loader: Callable[[], Embedder]):
    """A scorer by meaning for `align.analysis`: each word's most similar source unit, then the boundaries between words."""

    @F.arrow_udf("array<struct<best_src_idx:int,similarity:double>>")
    def best(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model, known = loader(), {}
        for units, words in batches:
            for k in range(0, len(units), ROWS):
                yield _best_units(units.slice(k, ROWS).to_pylist(), words.slice(k, ROWS).to_pylist(), model, known)
        pa.default_memory_pool().release_unused()

    return lambda units, words: let(best(units, words), lambda w: F.when(F.size(w) > 1, semantic_scores(w)).otherwise(F.array().cast("array<double>")))


def tagged(loader: Callable[[], Callable[[str], str | None]]):
    """A tagger for `align.analysis` from a loader of a function that tags a word by its first morpheme (null if it can't)."""

    @F.pandas_udf("array<string>")
    def tags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tag = loader()
        for words in batches:
            yield pd.Series([None if row is None else [tag(w) for w in row] for row in words])

    return tags


def mecab_tagger() -> Callable[[], Callable[[str], str | None]]:
    """Optional: MeCab's tag of a word's first morpheme."""

    def load() -> Callable[[str], str | None]:
        import MeCab

        tagger = MeCab.Tagger()

        def tag(word: str) -> str | None:
            line = tagger.parse(word).split("\n", 1)[0]
            return line.split("\t", 1)[1].split(",", 1)[0] if "\t" in line else None

        return tag

    return load
