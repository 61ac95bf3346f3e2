"""python -m colometry.cli pa|sa INPUT OUTPUT: paragraphs to sentences, sentences to phrases."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.align import align_hybrid, align_paragraphs, phrase_rows, phrase_units
from .operators.embed import embedded, get_embedder
from .operators.integrity import row_checks, units_valid
from .operators.report import method_counts, observed, quality_report, totals
from .sources.tables import read_bitext, write_table


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="colometry")
    out.add_argument("unit", choices=("pa", "sa"))
    out.add_argument("input")
    out.add_argument("output")
    out.add_argument("--embedder", choices=("none", "hash", "bge", "openai"), default="none", help="sa: cut at boundaries of meaning by this embedder's vectors")
    out.add_argument("--hybrid", action="store_true", help="pa: score by length and check sentences")
    out.add_argument("--fusion", action="store_true", help="pa: the same with the labels of a model's sentences")
    out.add_argument("--quality-threshold", type=float, default=0.8)
    out.add_argument("--similarity-threshold", type=float, default=0.0, help="pa: rows of a lower similarity go")
    out.add_argument("--verbose", action="store_true")
    return out


def paragraphs(rows: DataFrame, args: argparse.Namespace) -> DataFrame:
    own, keys = rows.withColumn("paragraph_id", F.col("row_idx") + 1), ["paragraph_id"]
    if args.fusion:
        out = align_hybrid(own, keys, quality_threshold=args.quality_threshold, fusion=True)
    else:
        out = align_hybrid(own, keys, quality_threshold=args.quality_threshold) if args.hybrid else align_paragraphs(own, keys)
    return out.where(F.col("similarity") >= args.similarity_threshold)


def main(argv: list[str] | None = None) -> int:
    """0 if rows were written, else 1."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("colometry").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    try:
        rows = read_bitext(spark, args.input)
        checks = None
        if args.unit == "pa":
            out, order = paragraphs(rows, args), ["paragraph_id", "sentence_no"]
        else:
            own, order = rows.withColumn("sentence_id", F.col("row_idx") + 1), ["sentence_id", "phrase_id"]
            semantic = None if args.embedder == "none" else embedded(get_embedder(args.embedder))
            # a row whose units don't give its texts again goes before its units become rows
            units = phrase_units(own, ["sentence_id"], semantic=semantic)
            checks = row_checks(units, ["sentence_id"])
            good = units.where(units_valid(F.col("src"), F.col("src_units")) & units_valid(F.col("tgt"), F.col("tgt_units")))
            out = phrase_rows(good, ["sentence_id"])
        if out.isEmpty():
            print("no rows", file=sys.stderr)
            return 1
        out, seen = observed(out, "written", order[:1])
        write_table(out, args.output, order)
        print(", ".join(f"{k}: {v}" for k, v in seen.get.items()), file=sys.stderr)
        if args.verbose and args.unit == "pa":
            quality_report(out).show(truncate=False)
            method_counts(out).show(truncate=False)
        if args.verbose and checks is not None:
            totals(out, checks).show()
        return 0
    except Exception as error:
        print(f"failed: {error}", file=sys.stderr)
        if args.verbose:
            raise
        return 1


if __name__ == "__main__":
    sys.exit(main())
