"""Checksums, verification and diff-based repair, row by row: no registry, no global state."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, squeeze, strip
from .align import row_numbers

BLANKS = r"[ \n\t]"


def sha(c: Column) -> Column:
    return F.sha2(squeeze(c), 256)


def md5_collapsed(c: Column) -> Column:
    return F.md5(strip(F.regexp_replace(c, f"{WS}+", " ")))


def collapsed_valid(original: Column, result: Column) -> Column:
    """Equal but for runs of white space, or of equal length without blanks (so some corruption passes)."""
    bare = lambda c: F.length(F.replace(c, F.lit(" "), F.lit("")))
    return (md5_collapsed(original) == md5_collapsed(result)) | (bare(original) == bare(result))


def paragraph_valid(src: Column, tgt: Column, src_units: Column, tgt_units: Column) -> Column:
    """Blanks, line feeds and tabs out of the original, blanks out of the units."""
    same = lambda whole, units: F.regexp_replace(whole, BLANKS, "") == F.replace(F.array_join(units, ""), F.lit(" "), F.lit(""))
    return same(src, src_units) & same(tgt, tgt_units)


def verification(original: Column, result: Column) -> Column:
    """Struct of checksums and lengths without white space; accuracy is diffed only where they differ."""
    a, b = squeeze(original), squeeze(result)
    return F.struct(
        F.sha2(a, 256).alias("original_checksum"), F.sha2(b, 256).alias("processed_checksum"), F.length(a).alias("original_length"), F.length(b).alias("processed_length"),
        F.abs(F.length(a) - F.length(b)).alias("length_diff"), F.when(a == b, 1.0).otherwise(character_accuracy(a, b)).alias("character_accuracy"),
    )


def accuracy(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a else float(not b)


def character_accuracy(original: Column, result: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([accuracy(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(original, result)


def within_tolerance(original: Column, result: Column, tolerance: float = 0.95) -> Column:
    a, b = squeeze(original), squeeze(result)
    return F.when((a == "") & (b == ""), True).when((a == "") | (b == ""), False).when(a == b, True).otherwise(character_accuracy(a, b) >= tolerance)


#: Rows, then digests, that one digest stands for; levels of digests, enough for FANOUT**LEVELS rows.
FANOUT, LEVELS = 100, 5


def file_checksum(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """(checksum, n_chars) of all texts in order, white space aside: a tree of digests.

    The digest of 100 rows is the sha256 of their texts end to end, that of 100 digests the sha256 of them end
    to end, for LEVELS levels, so no task gathers more than 100 values. An empty table gives no row.
    """
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{WS}+", "")
    rows = row_numbers(df.select(*order, bare.alias("_t")), order, "_i").select("_i", "_t", F.length("_t").cast("bigint").alias("_n"))
    for _ in range(LEVELS):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda r: r["_t"]), "")
        rows = rows.groupBy(F.floor(F.col("_i") / FANOUT).cast("bigint").alias("_i")).agg(F.sha2(joined, 256).alias("_t"), F.sum("_n").alias("_n"))
    return rows.select(F.col("_t").alias("checksum"), F.col("_n").alias("n_chars"))


def joined_checksum(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """sha256 of all texts in order, for small data: one task gathers them."""
    rows = df.select(F.struct(*order, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{WS}+", "").alias("_t")).alias("_r"))
    whole = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("_r")), lambda r: r["_t"]), "").alias("_all"))
    return whole.select(F.sha2("_all", 256).alias("checksum"), F.length("_all").cast("bigint").alias("n_chars"))


def file_valid(originals: DataFrame, results: DataFrame, text: str, order: list[str], unit_order: list[str]) -> DataFrame:
    """One row (valid): whether the results' texts, in unit_order, are the originals' but for white space."""
    a, b = file_checksum_of_rows(originals, text, order, order), file_checksum_of_rows(results, text, order, unit_order)
    both = a.alias("a").join(b.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in order], "full")
    return both.agg(F.coalesce(F.bool_and(F.coalesce(F.col("a._h"), F.sha2(F.lit(""), 256)) == F.coalesce(F.col("b._h"), F.sha2(F.lit(""), 256))), F.lit(True)).alias("valid"))


def file_checksum_of_rows(df: DataFrame, text: str, keys: list[str], order: list[str]) -> DataFrame:
    """keys, _h: digest of each original row's texts in order."""
    own = df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("_t"))
    return own.select(*keys, sha(F.col("_t")).alias("_h"))


def paragraph_file_valid(df: DataFrame, keys: list[str], src: str, tgt: str, src_units: str, tgt_units: str) -> DataFrame:
    """keys, src_valid, tgt_valid of each paragraph by `collapsed_valid`: verified within the row, nothing is repaired."""
    return df.select(*keys, collapsed_valid(F.col(src), F.array_join(src_units, "")).alias("src_valid"), collapsed_valid(F.col(tgt), F.array_join(tgt_units, "")).alias("tgt_valid"))


def units_valid(text: Column, units: Column) -> Column:
    """Whether units, joined in order, are the text but for white space."""
    return squeeze(F.array_join(units, "")) == squeeze(F.coalesce(text, F.lit("")))


def row_checks(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, valid, missing from (keys, src, tgt, src_units, tgt_units): compared within the row, no shuffle."""
    missing = (F.size("src_units") <= 0) & (F.size("tgt_units") <= 0)
    return units.select(*keys, (units_valid(F.col("src"), F.col("src_units")) & units_valid(F.col("tgt"), F.col("tgt_units"))).alias("valid"), missing.alias("missing"))


def row_integrity(units: DataFrame, originals: DataFrame, keys: list[str]) -> DataFrame:
    """As row_checks, of exploded units: joins them per row first."""
    side = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("phrase_id", c))), lambda x: x[c]), "")
    joined = units.groupBy(*keys).agg(side("src").alias("_s"), side("tgt").alias("_t"))
    out = originals.join(joined, keys, "left")
    valid = (squeeze(F.col("src")) == squeeze(F.coalesce("_s", F.lit("")))) & (squeeze(F.col("tgt")) == squeeze(F.coalesce("_t", F.lit(""))))
    return out.select(*keys, valid.alias("valid"), F.col("_s").isNull().alias("missing"))


def integrity_report(checks: DataFrame) -> DataFrame:
    """Counts by status: the evidence that a checksum over the whole file would give, without its order."""
    status = F.when(F.col("missing"), "missing").when(F.col("valid"), "ok").otherwise("failed")
    return checks.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- repair


def patch(units: list[str], have: str, want: str) -> list[str]:
    """What is missing goes to the end; what is too much goes from the first unit that has it."""
    out = list(units)
    for kind, i, j, k, m in SequenceMatcher(None, have, want).get_opcodes():
        if kind == "insert":
            out[-1:] = [(out[-1] if out else "") + want[k:m]]
        elif kind == "delete":
            hit = next((n for n, unit in enumerate(out) if have[i:j] in unit), None)
            if hit is not None:
                out[hit] = out[hit].replace(have[i:j], "", 1)
    return out


def _bare(text: str) -> str:
    return "".join(text.split())


def even(text: str, n: int) -> list[str]:
    if n < 1:
        return [text]
    q, r = divmod(len(text), n)
    cuts = [k * q + min(k, r) for k in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def repair_units(original: str, units: list[str], method: str = "auto") -> tuple[list[str], bool]:
    """Units whose join is the original but for white space, or the original alone and False."""
    want = _bare(original)
    out = even(original, len(units)) if method == "character_diff" else patch(units, _bare("".join(units)), want)
    if method == "auto" and _bare("".join(out)) != want:
        out = even(original, len(units))
    return (out, True) if _bare("".join(out)) == want else ([original], False)


def repair_sentences(original: str, units: list[str]) -> list[str]:
    have, want = "".join(units).replace(" ", ""), original.replace(" ", "").replace("\n", "").replace("\t", "")
    return list(units) if have == want else patch(units, have, want)


def repaired(original: Column, units: Column, method: str = "auto") -> Column:
    @F.pandas_udf("struct<units:array<string>,ok:boolean>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [repair_units(x or "", [] if y is None else list(y), method) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"units": [r[0] for r in rows], "ok": [r[1] for r in rows]})

    return run(original, units)


def repaired_sentences(original: Column, units: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([repair_sentences(x or "", [] if y is None else list(y)) for x, y in zip(a, b, strict=True)])

    return run(original, units)


def with_integrity(df: DataFrame, text: str, units: str) -> DataFrame:
    """Any operator's array column next to the text it came from: checked, and repaired where it fails."""
    ok = squeeze(F.array_join(units, "")) == squeeze(F.col(text))
    fixed = F.when(ok, F.struct(F.col(units).alias("units"), F.lit(True).alias("ok"))).otherwise(repaired(F.col(text), F.col(units)))
    return df.withColumn("_fixed", fixed).withColumns({units: F.col("_fixed.units"), "restored": ~ok, "valid": F.col("_fixed.ok")}).drop("_fixed")


RESTORED = "array<struct<src:string,tgt:string,similarity:double,split_method:string,align_method:string>>"


def repair_rows(src: str, tgt: str, rows: list[dict]) -> list[dict]:
    """Aligned rows of a paragraph with both sides repaired; a side that lacks text gets a row of its own if there is none."""
    out = [dict(r) for r in rows]
    for side, whole in (("src", src), ("tgt", tgt)):
        fixed = repair_sentences(whole, [r[side] or "" for r in out])
        if len(fixed) > len(out):
            out.append({"src": "", "tgt": "", "similarity": 0.0, "split_method": "integrity_restore", "align_method": f"{side}_missing_restore"})
        for row, text in zip(out, fixed, strict=True):
            row[side] = text
    return out


def restored_rows(src: Column, tgt: Column, rows: Column) -> Column:
    @F.pandas_udf(RESTORED)
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([repair_rows(x or "", y or "", [] if z is None else list(z)) for x, y, z in zip(a, b, c, strict=True)])

    return run(src, tgt, rows)


def repaired_file(df: DataFrame, text: str, units: str, whole: bool = False, order: list[str] | None = None) -> DataFrame:
    """df with units repaired row by row, restored and valid. whole: as a file, for small data: if the units of all
    rows, end to end, aren't the file's text and can't be patched to the same number, the file's text is cut
    evenly over all units, whatever row they were in; the driver holds it all."""
    if not whole:
        return with_integrity(df, text, units)
    rows = df.orderBy(*order).collect()
    have = [u for r in rows for u in (r[units] or [])]
    want = "".join(r[text] or "" for r in rows)
    out, ok = (have, True) if _bare("".join(have)) == _bare(want) else repair_units(want, have, "sequence_matcher")
    if len(out) != len(have) or not ok:
        out = even(want, len(have))
    pieces, cuts = iter(out), [len(r[units] or []) for r in rows]
    fixed = [tuple([next(pieces) for _ in range(n)] if c == units else r[c] for c in df.columns) for r, n in zip(rows, cuts, strict=True)]
    return df.sparkSession.createDataFrame(fixed, df.schema)
