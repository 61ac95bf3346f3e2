"""The queries of this subpackage: each operator on its whole table, reduced to the columns agreed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, jaccard, lines, media, mixing, nets, phrases, quality
from .common import fold32, table

#: The vocabulary for op8: a parameter, found by name among the installed public ones.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("copies")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).drop("class_id")


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).drop("kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def _held_out(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", F.coalesce(fold32() == 2, F.lit(False)).alias("held_out"), *[c for c in scored.columns if c != "doc_id"])


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = nets.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return _held_out(nets.score_toxicity(spark, docs, net))


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(), keep=())


def op9_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return _held_out(nets.predict_language(spark, docs, nets.train_language(docs)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False, short=True).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_media_sniff, op2_mix_sources, op3_jaccard_join, op4_repeated_phrases, op5_quality_rules, op6_toxicity_cnn, op7_html_main, op8_byte_bpe, op9_language_cnn, op10_line_dedup)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id node, doc_id seen from documents union select r.node, e.b from r join e on e.a = r.seen)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.c component_id
from d left join n on n.doc_id = d.doc_id join (select node, min(seen) c from r group by 1) m on m.node = d.doc_id
""",
    "op4_repeated_phrases": rf"""
with d as (select doc_id, {_WORDS} w from documents),
x as (select doc_id, unnest(range(1, len(w) - 33)) i, w from d where len(w) >= 35),
h as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) g from x),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) n from h) where n > 1),
c as (select distinct doc_id, unnest(range(i, i + 35)) p from r),
p as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p from d),
k as (select p.doc_id, count(*) kept, string_agg(word, ' ' order by p.p) t from p anti join c on c.doc_id = p.doc_id and c.p = p.p group by 1)
select d.doc_id, len(w)::bigint n_words, (len(w) - coalesce(kept, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join k on k.doc_id = d.doc_id
""",
}
