"""Queries over the supplied tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brackets as B
from ..functions import text as T
from ..operators import align as A
from ..operators import embed as E
from ..operators import integrity as I
from ..operators import report as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["conv_id", "turn"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn, as source and target."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    answer = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return user.join(answer, KEYS)


def _explode(df: DataFrame, keys: list[str], pieces, name: str) -> DataFrame:
    return df.select(*keys, F.posexplode(pieces).alias("_i", name)).select(*keys, (F.col("_i") + 1).alias("n"), name)


# SQL pieces. DuckDB's \s is ASCII; the supplied tables hold no other white space.
_PAIRS = "p as (select u.conv_id, u.turn, u.text src, a.text tgt from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant' and trim(u.text, E' \\n\\t\\r') <> '' and trim(a.text, E' \\n\\t\\r') <> '')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({_strip(x)}, '([.!?。？！○])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: {_strip('z')}), lambda z: z <> '')"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '[：。！？；、，\s]+|[^：。！？；、，\s]+')"


def _words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^\s]+')"


def _deal(a: str, n: str, sep: str = "") -> str:
    return f"list_transform(range(0, {n}), lambda k: array_to_string({a}[k * (len({a}) // {n}) + least(k, len({a}) % {n}) + 1 : (k + 1) * (len({a}) // {n}) + least(k + 1, len({a}) % {n})], '{sep}'))"


def _rows(table: str, keys: str, lists: dict[str, str], n: str = "n") -> str:
    """Unnests lists of equal length with their places."""
    first = next(iter(lists.values()))
    return f"select {keys}, unnest(range(1, len({first}) + 1))::int {n}, " + ", ".join(f"unnest({e}) {k}" for k, e in lists.items()) + f" from {table}"


#: The documents hold no Han characters; some letters become some.
_LETTERS, _HANS = "kvwyzj", "子曰學而時習"
_HAN_TEXT = f"translate(text, '{_LETTERS}', '{_HANS}')"


def _han(c: str = "text"):
    return F.translate(F.col(c), _LETTERS, _HANS)


def _smart(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '([。？！○]|[.!?]\s)', '\1' || chr(1), 'g'), chr(1)), lambda z: z <> '')"


def _merged(pieces: str) -> str:
    """CTEs that merge pieces (doc_id, i, p) of few Han characters, and the final select. A small piece joins
    the small ones next to it, those after the last large piece join that."""
    return (
        rf"m1 as (select *, len(regexp_extract_all(p, '\p{{Han}}')) > 3 big from {pieces}), "
        "m2 as (select *, coalesce(sum(big::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) g, sum(big::int) over (partition by doc_id) total from m1), "
        "m3 as (select *, case when big then 2 * g + 1 when g = total and total > 0 then 2 * total - 1 else 2 * g end k from m2) "
        "select doc_id, row_number() over (partition by doc_id order by k)::int n, string_agg(p, '' order by i) piece from m3 group by doc_id, k"
    )


#: Where to cut a text of over 180 characters: patterns in order of preference within 20 characters of place 180.
_NEAR = "case " + " ".join(
    rf"when regexp_matches(substring(rest, 161, 40), '{p}') then 160 + length(regexp_extract(substring(rest, 161, 40), '{p}', 1))"
    for p in (r"(?s)^(.*?[。！？○])", r"(?s)^(.*?[.!?]\s)", r"(?s)^(.*?[：])", r"(?s)^(.*?[:]\s)", r"(?s)^(.*?[，]\s*)(?-s:.{10})", r"(?s)^(.*?[,]\s+)(?-s:.{10})", r"(?s)^(.*?\s+)")
) + " else 180 end"


def _cuts(table: str, keys: str) -> str:
    """CTEs c0 and cuts (keys, j, p) of the texts (keys, rest) of a table."""
    return (
        f"cut as (select {keys}, 0 j, '' p, rest from {table} union all select {keys}, j + 1, "
        f"case when length(rest) <= 180 or place >= length(rest) then rest else substring(rest, 1, place) end, case when length(rest) <= 180 or place >= length(rest) then '' else substring(rest, place + 1) end "
        f"from (select *, {_NEAR} place from cut where rest <> '')), cuts as (select {keys}, j, p from cut where j > 0)"
    )


# ---------------------------------------------------------------- splitting


@query(_rows("documents", "doc_id", {"sentence": _sentences("text")}))
def pa_sentence_split(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.sentences(F.col("text")), "sentence")


@query(_rows("documents", "doc_id", {"token": _tokens("text")}))
def pa_source_tokens(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.source_tokens(F.col("text")), "token")


@query(_rows("(select doc_id, list_filter(string_split(regexp_replace(text, '([。？！○]|[.!?]\\s)', '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '') q from documents)", "doc_id", {"piece": "q"}))
def pa_smart_punct_split(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.smart_split(F.col("text")), "piece")


_PA = f"with {_PAIRS}, s as (select conv_id, turn, {_sentences('tgt')} ts, {_tokens('src')} tk from p), d as (select conv_id, turn, ts, {_deal('tk', 'len(ts)')} cs from s where len(ts) > 0)"


@query(_PA + " " + _rows("d", "conv_id, turn", {"src": "cs", "tgt": "ts"}, "sentence_no") .replace(" from d", ", 1.0::double similarity, 'punctuation' split_method, 'sequential' align_method from d"))
def pa_balanced_align(spark, sf_dir):
    return A.align_paragraphs(pairs(spark, sf_dir), KEYS)


_SIM = rf"case when {_strip('src')} = '' or {_strip('tgt')} = '' then 0.0 else 0.5 + 0.5 * least(length(src), length(tgt))::double / greatest(length(src), length(tgt)) end"


@query(f"with {_PAIRS} select conv_id, turn, ({_SIM})::double similarity from p")
def pa_length_similarity(spark, sf_dir):
    own = pairs(spark, sf_dir).where(T.both_sides(F.col("src"), F.col("tgt")))
    return own.select(*KEYS, A.length_similarity(F.col("src"), F.col("tgt")).alias("similarity"))


# separators that hold a line feed or tab, at an edge too, leave the target whole
_SAFE = rf"case when regexp_matches(tgt, '(^|[.!?。？！○])\s*[\n\t]\s*') or regexp_matches(tgt, '[\n\t]\s*$') then [tgt] else {_sentences('tgt')} end"
_HYBRID = f"with {_PAIRS}, s as (select conv_id, turn, {_SAFE} ts, {_tokens('src')} tk from p), d as (select conv_id, turn, ts, {_deal('tk', 'len(ts)')} cs from s), e as ({_rows('d', 'conv_id, turn', {'src': 'cs', 'tgt': 'ts'}, 'sentence_no')}), f as (select *, ({_SIM})::double s, (0.3::double + 0.4::double) + ({_SIM})::double * 0.3::double w from e)"


@query(_HYBRID + " select conv_id, turn, sentence_no, src, tgt, case when w >= 0.8 then w else s end similarity, case when w >= 0.8 then 'seq+sem+tok' else 'vice_versa_tokenized' end split_method, case when w >= 0.8 then 'hybrid_with_tokenizer' else 'tokenizer_vice_versa_only' end align_method from f")
def pa_hybrid_align(spark, sf_dir):
    return A.align_hybrid(pairs(spark, sf_dir), KEYS)


@query(_HYBRID + " select conv_id, turn, sentence_no, src, tgt, s similarity, 'vice_versa_tokenized' split_method, 'tgt_based_src_split' align_method from f")
def pa_tokenized_align(spark, sf_dir):
    return A.align_tokenized(pairs(spark, sf_dir), KEYS)


@query(_HYBRID + " select conv_id, turn, sentence_no, src, tgt, s similarity, 'spacy_tokenizer_fusion' split_method, 'spacy_tokenizer_based_split' align_method from f")
def pa_fusion_tokenized_align(spark, sf_dir):
    return A.align_tokenized(pairs(spark, sf_dir), KEYS, fusion=True)


@query(_HYBRID + " select conv_id, turn, sentence_no, src, tgt, case when 0.5::double + s * 0.2::double + s * 0.3::double >= 0.8 then 0.5::double + s * 0.2::double + s * 0.3::double else s end similarity, case when 0.5::double + s * 0.2::double + s * 0.3::double >= 0.8 then 'seq+sem+tok+spacy_tok' else 'spacy_tokenizer_fusion' end split_method, case when 0.5::double + s * 0.2::double + s * 0.3::double >= 0.8 then 'hybrid_with_spacy_tokenizer' else 'spacy_tokenizer_fusion_only' end align_method from f")
def pa_fusion_align(spark, sf_dir):
    return A.align_hybrid(pairs(spark, sf_dir), KEYS, fusion=True)


@query(rf"select doc_id, md5({_strip('regexp_replace(text, ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}) md5 from documents")
def pa_md5(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", I.md5_collapsed(F.col("text")).alias("md5"))


@query(rf"with {_PAIRS}, s as (select *, {_SAFE} ts, {_tokens('src')} tk from p), d as (select *, {_deal('tk', 'len(ts)')} cs from s) select conv_id, turn, (regexp_replace(src, '[ \n\t]', '', 'g') = replace(array_to_string(cs, ''), ' ', '') and regexp_replace(tgt, '[ \n\t]', '', 'g') = replace(array_to_string(ts, ''), ' ', '')) valid from d")
def pa_paragraph_integrity(spark, sf_dir):
    own = pairs(spark, sf_dir).where(T.both_sides(F.col("src"), F.col("tgt")))
    cut = own.select("*", T.safe_sentences(F.col("tgt")).alias("ts"), T.source_tokens(F.col("src")).alias("tk")).select("*", T.deal(F.col("tk"), F.size("ts")).alias("cs"))
    return cut.select(*KEYS, I.paragraph_valid(F.col("src"), F.col("tgt"), F.col("cs"), F.col("ts")).alias("valid"))


_COLLAPSED = lambda a, b: rf"({_strip('regexp_replace(' + a + ", '\\s+', ' ', 'g')")} = {_strip('regexp_replace(' + b + ", '\\s+', ' ', 'g')")} or length(replace({a}, ' ', '')) = length(replace({b}, ' ', '')))"


@query(rf"with {_PAIRS}, s as (select *, {_SAFE} ts, {_tokens('src')} tk from p), d as (select *, {_deal('tk', 'len(ts)')} cs from s) select conv_id, turn, {_COLLAPSED('src', "array_to_string(cs, '')")} src_valid, {_COLLAPSED('tgt', "array_to_string(ts, '')")} tgt_valid from d")
def pa_file_verification(spark, sf_dir):
    own = pairs(spark, sf_dir).where(T.both_sides(F.col("src"), F.col("tgt")))
    cut = own.select("*", T.safe_sentences(F.col("tgt")).alias("ts"), T.source_tokens(F.col("src")).alias("tk")).select("*", T.deal(F.col("tk"), F.size("ts")).alias("cs"))
    return I.paragraph_file_valid(cut, KEYS, "src", "tgt", "cs", "ts")


@query(_HYBRID + rf", g as (select src, tgt, case when w >= 0.8 then w else s end x from f) select count(*) n_rows, round(avg(x), 9) avg_similarity, max(x) max_similarity, min(x) min_similarity, count(*) filter (x > 0.7) n_high, count(*) filter (x between 0.5 and 0.7) n_medium, count(*) filter (x < 0.5) n_low, count(*) filter ({_strip('src')} = '') n_blank_src, count(*) filter ({_strip('tgt')} = '') n_blank_tgt, 100.0::double * count(*) filter (x > 0.7) / count(*) pct_high, 100.0::double * count(*) filter (x between 0.5 and 0.7) / count(*) pct_medium, 100.0::double * count(*) filter (x < 0.5) / count(*) pct_low from g")
def pa_quality_report(spark, sf_dir):
    return R.quality_report(pa_hybrid_align(spark, sf_dir)).withColumn("avg_similarity", F.round("avg_similarity", 9))


@query(r"select doc_id, len(regexp_extract_all(text, '\p{Han}'))::int n_han, len(regexp_extract_all(text, '\p{Han}')) > 0.3 * length(text) chinese from documents")
def pa_han_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.han_count(F.col("text")).alias("n_han"), T.contains_chinese(F.col("text")).alias("chinese"))


@query(f"with x as (select doc_id, unnest(range(1, len(q) + 1)) i, unnest(q) p from (select doc_id, {_smart(_HAN_TEXT)} q from documents)), " + _merged("x"))
def pa_merge_low_han(spark, sf_dir):
    own = _docs(spark, sf_dir).select("doc_id", _han().alias("text"))
    return _explode(own, ["doc_id"], T.merge_low_han(T.smart_split(F.col("text"))), "piece")


@query(f"with recursive t0 as (select doc_id, text rest from documents), {_cuts('t0', 'doc_id')} select doc_id, j::int n, p piece from cuts")
def pa_long_sentence_cut(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.long_cut(F.col("text"), 180), "piece")


@query(
    f"with recursive t0 as (select doc_id, unnest(range(1, len(q) + 1)) o, unnest(q) rest from (select doc_id, {_smart(_HAN_TEXT)} q from documents)), {_cuts('t0', 'doc_id, o')}, "
    "x as (select doc_id, o * 100000 + j i, p from cuts), " + _merged("x")
)
def pa_legacy_split(spark, sf_dir):
    own = _docs(spark, sf_dir).select("doc_id", _han().alias("text"))
    return _explode(own, ["doc_id"], T.legacy_split(F.col("text"), 180), "piece")


@query(
    f"with recursive t as (select doc_id, unnest(range(1, len(tk) + 1)) i, unnest(tk) w from (select doc_id, {_tokens('text')} tk from documents)), "
    "c as (select *, sum(length(w)) over (partition by doc_id order by i) upto from t), "
    "r as (select doc_id, 1 part, 1::bigint first, 0::hugeint before from c where i = 1 union all select r.doc_id, r.part + 1, min(c.i)::bigint, min(c.upto - length(c.w))::hugeint from r join c on c.doc_id = r.doc_id and c.i > r.first and c.upto - r.before > 180 group by r.doc_id, r.part), "
    "e as (select *, lead(first, 1, 1::bigint << 60) over (partition by doc_id order by part) after from r) "
    "select e.doc_id, e.part::int n, string_agg(c.w, '' order by c.i) part from e join c on c.doc_id = e.doc_id and c.i >= e.first and c.i < e.after group by e.doc_id, e.part"
)
def pa_token_packing(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.packed(F.col("text"), 180), "part")


@query(_rows("documents", "doc_id", {"sentence": _sentences("text")}))
def pa_model_units(spark, sf_dir):
    """Without an installed model: sentences by marks."""
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.model_units(F.col("text"), load=lambda chinese: None), "sentence")


@query(_rows("(select doc_id, unnest(" + _sentences("text") + ") s from documents)", "doc_id, md5(s) sentence", {"ch": "regexp_extract_all(s, '(?s).')"}).replace("select doc_id", "select doc_id", 1).replace(")::int n", ")::int n") .replace("select doc_id, md5(s) sentence, unnest", "select doc_id, md5(s) sentence, unnest"))
def pa_characters(spark, sf_dir):
    own = _docs(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    own = own.select("doc_id", "s", F.md5("s").alias("sentence"))  # once a sentence, not once a character
    return own.select("doc_id", "sentence", F.posexplode(T.characters(F.col("s"))).alias("i", "ch")).select("doc_id", "sentence", (F.col("i") + 1).alias("n"), "ch")


# ---------------------------------------------------------------- phrases


@query(_rows("documents", "doc_id", {"unit": _words("text")}))
def sa_source_units(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.split_ws(F.col("text")), "unit")


@query(f"with {_PAIRS}, s as (select conv_id, turn, {_words('tgt')} w, len({_words('src')}) n from p), d as (select conv_id, turn, {_deal('w', 'n', ' ')} q from s) " + _rows("d", "conv_id, turn", {"unit": "q"}))
def sa_even_distribution(spark, sf_dir):
    own = pairs(spark, sf_dir).where(T.both_sides(F.col("src"), F.col("tgt")))
    return _explode(own, KEYS, A.even_words(F.col("tgt"), F.size(T.split_ws(F.col("src")))), "unit")


_PAD = "list_concat({0}, list_transform(range(0, greatest(0, {1} - len({0}))), lambda z: ''))"
_COLON = rf"with {_PAIRS}, t as (select conv_id, turn, {_sentences('tgt')} ts, len({_words('src')}) n from p), c as (select conv_id, turn, n, ts[1] l, array_to_string(ts[2:], ' ') r, {_words(chr(97) + 'rray_to_string(ts[2:], ' + chr(39) + ' ' + chr(39) + ')')} w from t where n >= 2), d as (select conv_id, turn, list_concat([l || '：'], case when n = 2 then [r] when len(w) <= n - 1 then {_PAD.format('w', '(n - 1)')} else {_deal('w', '(n - 1)', ' ')} end) q from c) " + _rows("d", "conv_id, turn", {"unit": "q"})


@query(_COLON)
def sa_colon_split(spark, sf_dir):
    """Targets with a colon put after their first sentence."""
    own = pairs(spark, sf_dir).where(T.both_sides(F.col("src"), F.col("tgt"))).select(*KEYS, T.sentences(F.col("tgt")).alias("ts"), F.size(T.split_ws(F.col("src"))).alias("n"))
    text = F.concat(F.element_at("ts", 1), F.lit("："), F.array_join(F.slice("ts", 2, F.greatest(F.lit(0), F.size("ts") - 1)), " "))
    return _explode(own.where("n >= 2"), KEYS, A.colon_units(text, F.col("n")), "unit")


_BOUNDS = "list_transform(range(0, n), lambda k: case when k = 0 then 0 else len(w) - 1 - (n - 1 - k) * greatest(1, len(w) // (n + 1)) end)"
_PHRASES = f"with {_PAIRS}, s as (select conv_id, turn, tgt, {_words('src')} u, {_words('tgt')} w, len({_words('src')}) n from p), b as (select *, {_BOUNDS} bs from s), d as (select conv_id, turn, u, case when n = 1 then [tgt] when len(w) <= n then {_PAD.format('w', 'n')} else list_transform(range(1, n + 1), lambda k: array_to_string(w[bs[k] + 1 : case when k = n then len(w) else bs[k + 1] end], ' ')) end t from b) " + _rows("d", "conv_id, turn", {"src": "u", "tgt": "t"}, "phrase_id")


@query(_PHRASES)
def sa_phrase_align(spark, sf_dir):
    return A.align_phrases(pairs(spark, sf_dir), KEYS)


@query("with e as (select vec_id, embedding::double[] e from embeddings), u as (select list(e order by vec_id) us from e where vec_id < 8), n as (select e.vec_id, list_transform(us, lambda y: list_sum(list_transform(range(1, len(y) + 1), lambda i: e[i] * y[i])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(y, lambda x: x * x))) + 1e-8)) al from e, u), b as (select vec_id, list_position(al, list_max(al)) - 1 ix, list_max(al) m from n) select x.vec_id, x.ix::int best_src_idx, round(case when x.ix <> y.ix then least(0.9, greatest(0.1, (x.m + y.m) / 2)) else 0.1 end, 6) score from b x join b y on y.vec_id = x.vec_id + 1")
def sa_semantic_boundaries(spark, sf_dir):
    """Vectors as words, the first eight as source units; a word's boundary is with the next id."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    units = own.where("vec_id < 8").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("units"))
    best = own.crossJoin(F.broadcast(units)).select("vec_id", A.best_unit(F.col("embedding"), F.col("units")).alias("b"))  # eight vectors, one row
    after = best.select((F.col("vec_id") - 1).alias("vec_id"), F.col("b").alias("c"))
    score = F.get(A.semantic_scores(F.array(F.struct("b.best_src_idx", "b.similarity"), F.struct("c.best_src_idx", "c.similarity"))), F.lit(0))
    return best.join(after, "vec_id").select("vec_id", F.col("b.best_src_idx").alias("best_src_idx"), F.round(score, 6).alias("score"))


#: Tags and scores seeded by hashes of words, so that SQL knows them too.
_TAGS = ("EF", "EC", "JX", "JC", "NNG", "NNP", "VV", "VA", "MAG")
_SEED = lambda x: f"('0x' || substr(md5({x}), 1, 4))::int"
_TAG = f"list_transform(w, lambda x: [{', '.join(repr(t) for t in _TAGS)}][{_SEED('x')} % {len(_TAGS)} + 1])"
_GRAMMAR = "list_transform(range(1, len(t)), lambda i: (case when t[i] in ('EF', 'EC') then 0.9 when t[i] in ('JX', 'JC') then 0.8 when t[i] <> t[i + 1] then case when (t[i] like 'N%' and t[i + 1] like 'V%') or (t[i] like 'V%' and t[i + 1] like 'N%') then 0.6 else 0.4 end else 0.2 end)::double)"
_MEANING = f"list_transform(range(1, len(w)), lambda i: ({_SEED('w[i]')} % 1000)::double / 1000)"
_SEGMENTS = "list_transform(range(1, len(w)), lambda i: (case when len(u)::double / len(w) > 1.5 then 0.6 when len(u)::double / len(w) < 0.7 then 0.2 else 0.4 end)::double)"
_SCORED = (
    f"with {_PAIRS}, w0 as (select conv_id, turn, tgt, {_words('src')} u, {_words('tgt')} w from p), w1 as (select *, {_TAG} t, len(u) n, len(w) total from w0), "
    f"w2 as (select *, {_MEANING} a, {_GRAMMAR} g, {_SEGMENTS} j from w1), "
    "w3 as (select *, list_transform(range(1, len(w)), lambda i: least(1.0::double, greatest(0.0::double, a[i] * 0.5::double + g[i] * 0.3::double + j[i] * 0.2::double))) s from w2)"
)


def _chosen(table: str, scores: str, need: str, total: str) -> str:
    """CTEs ending in `chosen`: table with bs, the boundaries by scores."""
    gaps = "list_filter(list_transform(range(1, len(e)), lambda i: {'g': e[i + 1] - e[i], 'm': e[i] + (e[i + 1] - e[i]) // 2}), lambda x: x.g > 2 and not list_contains(acc, x.m))"
    widest = gaps.replace("e[", "list_sort(list_concat([0, total], acc))[").replace("len(e)", "len(acc) + 2")
    steps = "list_filter(list_transform(range(1, need + 1), lambda k: (k * case when total <= need + 1 then 1 else total // (need + 1) end)::int), lambda p: p < total)"
    return (
        f"k0 as (select *, {scores} sc, ({need})::int need, ({total})::int total_ from {table}), k1 as (select * replace (total_::int as total) from (select * exclude (total), total_ total, total_ from k0)), "
        "k2 as (select *, list_transform(list_sort(list_filter(list_transform(range(1, len(sc) + 1), lambda i: {'s': sc[i], 'p': i}), lambda x: x.p < total), 'DESC'), lambda x: [x.p::int]) q, greatest(1, total // (need + 2))::int apart from k1), "
        "k3 as (select *, list_reduce(q, lambda acc, x: case when len(acc) < need and len(list_filter(acc, lambda o: abs(o - x[1]) < apart)) = 0 then list_append(acc, x[1]) else acc end, []::int[]) k from k2), "
        f"k4 as (select *, list_reduce(list_transform(range(0, greatest(need, 0)), lambda i: []::int[]), lambda acc, x: case when len(acc) >= need or len({widest}) = 0 then acc else list_append(acc, (list_max({widest})).m::int) end, k) bs0 from k3), "
        f"chosen as (select *, case when need <= 0 then []::int[] when len(sc) < need then {steps} else list_sort(bs0) end bs from k4)"
    )


def _seed(c):
    return F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")


def _seeded_meaning(units, words):
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda x: _seed(x) % 1000 / 1000)


def _seeded_tags(words):
    return F.transform(words, lambda x: F.get(F.array(*map(F.lit, _TAGS)), _seed(x) % len(_TAGS)))


def _worded(spark, sf_dir):
    own = pairs(spark, sf_dir).where(T.both_sides(F.col("src"), F.col("tgt")))
    return own.select(*KEYS, "src", "tgt", T.split_ws(F.col("src")).alias("u"), T.split_ws(F.col("tgt")).alias("w"))


@query(f"{_SCORED} select conv_id, turn, unnest(range(1, len(g) + 1))::int n, unnest(g) strength from w3")
def sa_grammar_strength(spark, sf_dir):
    return _explode(_worded(spark, sf_dir), KEYS, A.let_grammar(_seeded_tags(F.col("w"))), "strength")


@query(f"{_SCORED} select conv_id, turn, unnest(range(1, len(s) + 1))::int n, round(unnest(s), 9) score from w3")
def sa_combined_score(spark, sf_dir):
    scores = A.analysis(F.col("u"), F.col("w"), _seeded_meaning, _seeded_tags, lambda w: F.size("u"))
    return _explode(_worded(spark, sf_dir), KEYS, scores["combined"], "score").withColumn("score", F.round("score", 9))


@query(f"with {_PAIRS} select conv_id, turn, unnest(range(1, len(w)))::int n, (case when len(u) / len(w) > 1.5 then 0.6 when len(u) / len(w) < 0.7 then 0.2 else 0.4 end)::double score from (select conv_id, turn, {_words('src')} u, {_words('tgt')} w from p)")
def sa_segmenter_scores(spark, sf_dir):
    own = pairs(spark, sf_dir).where(T.both_sides(F.col("src"), F.col("tgt")))
    return _explode(own, KEYS, A.segmenter_scores(F.size(T.split_ws(F.col("src"))), F.size(T.split_ws(F.col("tgt")))), "score")


@query(f"{_SCORED}, {_chosen('w3', 'a', 'n - 1', 'len(w)')} select conv_id, turn, bs boundaries from chosen")
def sa_boundary_select(spark, sf_dir):
    own = _worded(spark, sf_dir)
    return own.select(*KEYS, A.chosen_boundaries(_seeded_meaning(None, F.col("w")), F.size("u") - 1, F.size("w")).alias("boundaries"))


@query(
    f"{_SCORED}, {_chosen('w3', 's', 'n - 1', 'len(w)')}, b as (select *, list_concat(list_concat([0], bs), [len(w)]) cs from chosen), "
    "c as (select *, list_transform(range(1, len(cs)), lambda k: array_to_string(w[cs[k] + 1 : cs[k + 1]], ' ')) pieces from b), "
    f"d as (select conv_id, turn, u, case when n = 1 then [tgt] when len(w) <= n then {_PAD.format('w', 'n')} when len(pieces) <= n then {_PAD.format('pieces', 'n')} else list_concat(pieces[1 : n - 1], [array_to_string(pieces[n : len(pieces)], ' ')]) end units from c) "
    + _rows("d", "conv_id, turn", {"src": "u", "tgt": "units"}, "phrase_id")
)
def sa_scored_align(spark, sf_dir):
    return A.align_phrases(pairs(spark, sf_dir), KEYS, semantic=_seeded_meaning, pos=_seeded_tags, segmenter=lambda w: F.size("_su"))


@query()
def sa_embedded_align(spark, sf_dir):
    """Cut by meaning with vectors of hashed character 3-grams; tests compare it with plain Python."""
    return A.align_phrases(pairs(spark, sf_dir), KEYS, semantic=E.embedded(E.get_embedder("hash")))


# ---------------------------------------------------------------- brackets


def _sql_brackets(table: str, key: str, text: str) -> tuple[str, str]:
    """Steps of protection, the last named b7; and the counts before each step."""
    steps, counts = [f"b0 as (select {key}, {text} x from {table})"], []
    hidden, shown = B.HIDDEN, B.STAND_INS
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    plain = "".join(c for c in hidden if c in " \n\t：()[]{}「」『』〈〉《》")
    stand = "".join(shown[hidden.index(c)] for c in plain)
    for k, (p, (_, _, name)) in enumerate(zip(B.PATTERNS, B.PAIRS, strict=True)):
        made = f"array_to_string(list_transform(list_zip(string_split_regex(x, {lit(p)}), regexp_extract_all(x, {lit(p)})), lambda z: z[1] || translate(coalesce(z[2], ''), {lit(plain)}, {lit(stand)})), '')"
        counts.append(f"len(regexp_extract_all(x, {lit(p)}))::int n_{name}")
        steps.append(f"b{k + 1} as (select * exclude (x), {counts[-1]}, {made} x from b{k})")
    return ", ".join(steps), ""


@query(f"with {_sql_brackets('pages', 'page_id', 'html')[0]} select page_id, n_parenthesis, n_square, n_curly, n_corner, n_double_corner, n_angle, n_double_angle from b7")
def sa_bracket_stats(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return own.select("page_id", *B.bracket_counts(F.col("html")))


@query(f"with {_sql_brackets('documents', 'doc_id', 'text')[0]} select doc_id, x protected from b7")
def sa_bracket_protect(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", B.protect(F.col("text")).alias("protected"))


def _sql_masks() -> str:
    """Steps of masking: the number of masks, and of those whose content holds a mask itself, so that no text has it."""
    hidden, shown = B.HIDDEN, B.STAND_INS
    plain = "".join(c for c in hidden if c in " \n\t：()[]{}「」『』〈〉《》")
    stand = "".join(shown[hidden.index(c)] for c in plain)
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    steps = ["z0 as (select doc_id, text, text x, 0 n, 0 lost from documents)"]
    for k, p in enumerate(B.PATTERNS):
        made = f"array_to_string(list_transform(list_zip(string_split_regex(x, {lit(p)}), regexp_extract_all(x, {lit(p)})), lambda z: z[1] || translate(coalesce(z[2], ''), {lit(plain)}, {lit(stand)})), '')"
        spans = f"regexp_extract_all(x, {lit(p)})"
        steps.append(f"z{k + 1} as (select doc_id, text, {made} x, n + len({spans}) n, lost + len(list_filter({spans}, lambda s: regexp_matches(s, '[{shown[0]}-{shown[-1]}]'))) lost from z{k})")
    return ", ".join(steps) + f" select doc_id, n::int n_masks, translate(x, {lit(stand)}, {lit(plain)}) = text same, lost::int n_lost from z{len(B.PATTERNS)}"


@query("with " + _sql_masks())
def sa_bracket_mask_roundtrip(spark, sf_dir):
    own = _docs(spark, sf_dir).select("doc_id", "text", B.masked(F.col("text")).alias("m"))
    back = own.select("doc_id", "text", F.size("m.masks").alias("n_masks"), F.col("m.masks").alias("masks"), B.restored(F.col("m.masked"), F.col("m.masks")).alias("back"))
    return back.select("doc_id", "n_masks", (F.col("back") == F.col("text")).alias("same"), B.lost_masks(F.col("back"), F.col("masks")).alias("n_lost"))


@query(_rows(rf"(select doc_id, flatten(list_transform(list_filter(list_transform(string_split_regex(text, '[.!?。！？；]'), lambda z: {_strip('z')}), lambda z: z <> ''), lambda s: case when length(s) <= 150 then [s] else list_filter(list_transform(string_split(s, ','), lambda z: {_strip('z')}), lambda z: z <> '') end)) q from documents)", "doc_id", {"piece": "q"}))
def sa_punct_split(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.punctuation_split(F.col("text")), "piece")


_PUNCT = rf"flatten(list_transform(list_filter(list_transform(string_split_regex(text, '[.!?。！？；]'), lambda z: {_strip('z')}), lambda z: z <> ''), lambda s: case when length(s) <= 150 then [s] else list_filter(list_transform(string_split(s, ','), lambda z: {_strip('z')}), lambda z: z <> '') end))"
_EVEN = "list_transform(range(0, len(q)), lambda k: substring(text, k * (length(text) // len(q)) + least(k, length(text) % len(q)) + 1, length(text) // len(q) + case when k < length(text) % len(q) then 1 else 0 end))"


@query(_rows(rf"""(select doc_id, case when len(q) = 0 then case when bare = '' then []::varchar[] else [text] end when whole = bare then q when whole || missing = bare then list_concat(q[1 : len(q) - 1], [q[len(q)] || missing]) else {_EVEN} end r
  from (select *, regexp_replace(text, '\s+', '', 'g') bare, regexp_extract(regexp_replace(text, '\s+', '', 'g'), '[.!?。！？；]+$') missing, regexp_replace(array_to_string(q, ''), '\s+', '', 'g') whole from (select doc_id, text, {_PUNCT} q from documents)))""", "doc_id", {"piece": "r"}))
def sa_safe_split(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.safe_punctuation_split(F.col("text")), "piece")


@query(_rows(f"(select doc_id, {_PUNCT} q from documents)", "doc_id", {"piece": "q"}))
def sa_model_split(spark, sf_dir):
    """Without an installed model: cut by punctuation."""
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.model_punctuation_split(F.col("text"), load=lambda chinese: None), "piece")


@query("select doc_id, text normalized, 0 n_quotes from documents")
def sa_quotes_and_punctuation(spark, sf_dir):
    """Both leave the text as it is."""
    own = _docs(spark, sf_dir).select("doc_id", T.quotes(T.normalized_punctuation(F.col("text"))).alias("q"))
    return own.select("doc_id", F.col("q.text").alias("normalized"), F.size("q.quotes").alias("n_quotes"))


@query(_rows("(select doc_id, list_transform(range(0, 4), lambda k: substring(text, k * (length(text) // 4) + least(k, length(text) % 4) + 1, length(text) // 4 + case when k < length(text) % 4 then 1 else 0 end)) q from documents)", "doc_id", {"piece": "q"}))
def equal_char_split(spark, sf_dir):
    return _explode(_docs(spark, sf_dir), ["doc_id"], T.equal_chars(F.col("text"), F.lit(4)), "piece")


# ---------------------------------------------------------------- integrity


@query(r"select doc_id, sha256(regexp_replace(text, '\s+', '', 'g')) checksum from documents")
def sa_sha256(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", I.sha(F.col("text")).alias("checksum"))


def _corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each pair's target, some without their last character, some doubled."""
    own = pairs(spark, sf_dir).where(T.both_sides(F.col("src"), F.col("tgt"))).select(*KEYS, "tgt", T.sentences(F.col("tgt")).alias("units"))
    spoil = lambda x, i: F.when((F.col("turn") + i) % 5 == 0, F.substring(x, 1, F.length(x) - 1)).when((F.col("turn") + i) % 7 == 0, F.concat(x, x)).otherwise(x)
    return own.withColumn("units", F.transform("units", spoil))


#: Sentences of the target, spoilt as by `_corrupted`; a list's places count from 1.
_SPOILT = f"with {_PAIRS}, q as (select conv_id, turn, src, tgt, list_transform({_sentences('tgt')}, lambda z, i: case when (turn + i - 1) % 5 = 0 then substring(z, 1, length(z) - 1) when (turn + i - 1) % 7 = 0 then z || z else z end) whole from p), w as (select *, case when conv_id % 11 = 0 then []::varchar[] else whole end units from q)"
_BARE = lambda x: rf"regexp_replace({x}, '\s+', '', 'g')"
_CHECKS = f"{_SPOILT}, v as (select conv_id, turn, ({_BARE("array_to_string(units, '')")} = {_BARE('tgt')}) valid, len(units) = 0 missing from w)"


@query(f"{_CHECKS} select conv_id, turn, valid, missing from v")
def sa_row_integrity(spark, sf_dir):
    """Of spoilt sentences, some rows without any, so that rows fail and are missing."""
    none = F.array().cast("array<string>")
    units = F.when(F.col("conv_id") % 11 == 0, none).otherwise(F.col("units"))
    spoilt = _corrupted(spark, sf_dir).select(*KEYS, F.lit("").alias("src"), "tgt", none.alias("src_units"), units.alias("tgt_units"))
    return I.row_checks(spoilt, KEYS)


@query(f"{_CHECKS} select case when missing then 'missing' when valid then 'ok' else 'failed' end status, count(*) n from v group by 1")
def sa_integrity_report(spark, sf_dir):
    return I.integrity_report(sa_row_integrity(spark, sf_dir))


@query(f"{_CHECKS} select (select sum(len(whole)) from q)::bigint n_rows, count(*) n_processed, count(*) filter (not valid and not missing) n_failed, count(*) filter (missing) n_missing from v")
def sa_totals(spark, sf_dir):
    rows = _corrupted(spark, sf_dir).select(F.explode("units").alias("unit"))
    return R.totals(rows, sa_row_integrity(spark, sf_dir))


def _digests(table: str) -> str:
    """Levels of digests over (i, t, n), the last named t5."""
    steps = [f"t0 as (select * from {table})"]
    for k in range(I.LEVELS):
        steps.append(f"t{k + 1} as (select i // {I.FANOUT} i, sha256(string_agg(t, '' order by i)) t, sum(n)::bigint n from t{k} group by 1)")
    return ", ".join(steps)


@query(rf"with {_PAIRS.split(' and trim(u.text')[0]}), t as (select row_number() over (order by conv_id, turn) - 1 i, regexp_replace(coalesce(tgt, ''), '\s+', '', 'g') t, length(regexp_replace(coalesce(tgt, ''), '\s+', '', 'g')) n from p), {_digests('t')} select t checksum, n n_chars from t{I.LEVELS}")
def sa_file_integrity(spark, sf_dir):
    return I.file_checksum(pairs(spark, sf_dir), "tgt", KEYS)


@query(f"{_SPOILT} select bool_and({_BARE("array_to_string(whole, '')")} = {_BARE('tgt')}) valid from q")
def sa_file_verification(spark, sf_dir):
    """Spoilt sentences of all rows against the texts they came from."""
    spoilt = _corrupted(spark, sf_dir)
    units = spoilt.select(*KEYS, F.posexplode("units").alias("i", "unit")).withColumnRenamed("unit", "tgt")
    return I.file_valid(spoilt, units, "tgt", KEYS, [*KEYS, "i"])


@query()
def sa_unit_repair(spark, sf_dir):
    return _corrupted(spark, sf_dir).select(*KEYS, I.repaired(F.col("tgt"), F.col("units")).alias("r")).select(*KEYS, F.col("r.units").alias("units"), F.col("r.ok").alias("ok"))


@query()
def pa_sentence_repair(spark, sf_dir):
    return _corrupted(spark, sf_dir).select(*KEYS, I.repaired_sentences(F.col("tgt"), F.col("units")).alias("units"))


@query()
def char_accuracy(spark, sf_dir):
    return _corrupted(spark, sf_dir).select(*KEYS, I.verification(F.col("tgt"), F.array_join("units", "")).alias("v")).select(*KEYS, "v.*")


@query()
def tolerance_check(spark, sf_dir):
    return _corrupted(spark, sf_dir).select(*KEYS, I.within_tolerance(F.col("tgt"), F.array_join("units", "")).alias("within"))


@query()
def sa_with_integrity(spark, sf_dir):
    return I.with_integrity(_corrupted(spark, sf_dir), "tgt", "units").select(*KEYS, "units", "restored", "valid")


# ---------------------------------------------------------------- rows


@query("select conv_id, turn, ((row_number() over (order by conv_id, turn) - 1) // 100)::bigint chunk_id from conversations")
def sa_chunks(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*KEYS)
    return A.chunk_ids(turns, KEYS).select(*KEYS, "chunk_id")


_FALL = f"select conv_id, turn, src, tgt, 'fallback_mode' split_method, 1.0::double similarity, len({_words('src')})::int src_tokens, len({_words('tgt')})::int tgt_tokens from p"


@query(f"with {_PAIRS} {_FALL}")
def sa_fallback_rows(spark, sf_dir):
    return A.fallback_rows(pairs(spark, sf_dir), KEYS)


@query(_HYBRID + " select case when w >= 0.8 then 'seq+sem+tok' else 'vice_versa_tokenized' end split_method, count(*) n from f group by 1")
def sa_method_counts(spark, sf_dir):
    return R.method_counts(pa_hybrid_align(spark, sf_dir))


@query(f"with {_PAIRS} select conv_id, turn, round(len(list_intersect(u, w))::double / len(list_distinct(list_concat(u, w))), 3) jaccard from (select conv_id, turn, {_words('src')} u, {_words('tgt')} w from p)")
def jaccard_similarity(spark, sf_dir):
    own = pairs(spark, sf_dir).where(T.both_sides(F.col("src"), F.col("tgt")))
    return own.select(*KEYS, T.jaccard(F.col("src"), F.col("tgt")).alias("jaccard"))
