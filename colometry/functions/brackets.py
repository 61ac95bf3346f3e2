"""Bracketed spans that a cut must not enter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Bracket pairs in the order of masking, and their names.
PAIRS = (("(", ")", "parenthesis"), ("[", "]", "square"), ("{", "}", "curly"), ("「", "」", "corner"), ("『", "』", "double_corner"), ("〈", "〉", "angle"), ("《", "》", "double_angle"))
PATTERNS = tuple(f"{re.escape(a)}[^{re.escape(a)}{re.escape(b)}]*{re.escape(b)}" for a, b, _ in PAIRS)
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
HIDDEN = _SPACE + "：" + "".join(a + b for a, b, _ in PAIRS)
STAND_INS = "".join(chr(0xE000 + i) for i in range(len(HIDDEN)))


def _hide(p: str):
    def step(x: Column) -> Column:
        spans = F.transform(F.regexp_extract_all(x, F.lit(p), 0), lambda s: F.translate(s, HIDDEN, STAND_INS))
        return F.array_join(F.zip_with(F.split(x, p, -1), spans, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return step


def protect(c: Column) -> Column:
    """Spans get private stand-ins for white space, colon and brackets, so they are one word to any split."""
    for p in PATTERNS:
        c = let(c, _hide(p))
    return c


def unprotect(c: Column) -> Column:
    return F.translate(c, STAND_INS, HIDDEN)


def bracket_counts(c: Column) -> list[Column]:
    """Number of spans of each type, earlier types hidden."""
    out = []
    for p, (_, _, name) in zip(PATTERNS, PAIRS, strict=True):
        out.append(F.size(F.regexp_extract_all(c, F.lit(p), 0)).alias(f"n_{name}"))
        c = let(c, _hide(p))
    return out


MASKED = "masked string, masks array<struct<mask_token:string,content:string,start_pos:int,end_pos:int,bracket_type:string,text_type:string>>"


def mask_text(text: str, kind: str = "source") -> tuple[str, list[dict]]:
    """Numbered tokens for spans, one pass a type, spans of a pass numbered from the right."""
    masks: list[dict] = []
    for p, (_, _, name) in zip(PATTERNS, PAIRS, strict=True):
        for m in reversed(list(re.finditer(p, text))):
            token = f"__BRACKET_MASK_{len(masks)}__"
            masks.append({"mask_token": token, "content": m[0], "start_pos": m.start(), "end_pos": m.end(), "bracket_type": name, "text_type": kind})
            text = text[: m.start()] + token + text[m.end() :]
    return text, masks[::-1]


def restore_text(text: str, masks: list[dict]) -> str:
    """Each token once, latest mask first; tokens left over go. Without masks the text is as it was."""
    if not masks:
        return text
    for m in masks:
        text = text.replace(m["mask_token"], m["content"], 1)
    return re.sub(r"__BRACKET_MASK_\d+__", "", text)


#: Texts masked or restored at once, so that a worker holds no more of them as Python objects.
ROWS = 64


def masked(c: Column, kind: str = "source") -> Column:
    inner = pa.struct([(n, pa.int32() if n.endswith("pos") else pa.string()) for n in ("mask_token", "content", "start_pos", "end_pos", "bracket_type", "text_type")])
    made = pa.struct([("masked", pa.string()), ("masks", pa.list_(inner))])

    @F.arrow_udf(f"struct<{MASKED.replace(' string', ':string').replace('masks array', 'masks:array').replace(', ', ',')}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for k in range(0, len(texts), ROWS):
                yield pa.array([dict(zip(("masked", "masks"), mask_text(t or "", kind), strict=True)) for t in texts.slice(k, ROWS).to_pylist()], made)
        pa.default_memory_pool().release_unused()

    return run(c)


def restored(text: Column, masks: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            for k in range(0, len(texts), ROWS):
                yield pa.array([restore_text(t or "", m or []) for t, m in zip(texts.slice(k, ROWS).to_pylist(), found.slice(k, ROWS).to_pylist(), strict=True)], pa.string())
        pa.default_memory_pool().release_unused()

    return run(text, F.transform(masks, lambda m: F.struct(m["mask_token"].alias("mask_token"), m["content"].alias("content"))))


def lost_masks(text: Column, masks: Column) -> Column:
    """Masks whose content a restored text lacks."""
    return F.size(F.filter(masks, lambda m: ~F.contains(text, m["content"])))
