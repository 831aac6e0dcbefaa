"""Queries over the real text of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.operators import search
from notemill.sources.scan import spread

QUERY = "nicht thing ention the"
SP = T.SPACE


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '{SP}+'), lambda w: w <> '')"


def _pre(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(regexp_replace(left({x}, 100000), '[\x{{A0}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g'), '\t+', ' ', 'g'), ' +', ' ', 'g')"
    return _strip(rf"regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _toks(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1 and t not in ({STOP}))"


def scan_docs(spark, sf):
    d = _docs(spark, sf)
    return d.where(F.length("text") > 0).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


def preprocess(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.preprocess(F.col("text"))).alias("md5"), F.length(T.preprocess(F.col("text"))).cast("bigint").alias("n"))


def normalize_whitespace(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("md5"))


def remove_extra_newlines(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.remove_extra_newlines(F.col("text"))).alias("md5"))


def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.clean(F.col("text"))).alias("md5"))


def sanitize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.sanitize(F.col("text"))).alias("md5"))


def content_hash_dedup(spark, sf):
    hashed = _docs(spark, sf).select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def cache_key(spark, sf):
    return _docs(spark, sf).select("doc_id", T.cache_key("ner", F.col("text")).alias("cache_key"))


def text_stats(spark, sf):
    return T.text_stats(_docs(spark, sf))


def segment_sentences(spark, sf):
    s = T.sentences(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "|")).alias("md5"))


def validate(spark, sf):
    v = T.validation(F.col("text"))
    return _docs(spark, sf).select("doc_id", v["is_valid"].alias("is_valid"), F.array_join(v["errors"], ",").alias("errors"), F.array_join(v["warnings"], ",").alias("warnings"))


def abbrev_simple(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.expand_abbreviations(T.clean(F.col("text")))).alias("md5"))


def feature_custom(spark, sf):
    return T.custom_features(_docs(spark, sf).select("doc_id", T.clean(F.col("text")).alias("text")))


def feature_pivot(spark, sf):
    d = _docs(spark, sf)
    words = d.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("tok")).where(F.col("tok").isin("nicht", "the", "les", "que"))
    counts = words.groupBy("doc_id").pivot("tok", ["les", "nicht", "que", "the"]).count()
    return d.select("doc_id").join(counts, "doc_id", "left").na.fill(0)


def tokenize(spark, sf):
    t = T.tokens(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("md5"))


def bow_topk(spark, sf):
    return search.bag_of_words(_docs(spark, sf), 1, 2, 200)


def bow_transform(spark, sf):
    d = _docs(spark, sf)
    return search.bag_counts(d, search.bag_of_words(d, 1, 1, 100))


def bm25_score(spark, sf):
    return search.bm25(_docs(spark, sf), QUERY).select("doc_id", F.round("bm25", 6).alias("bm25")).where("bm25 > 0").orderBy(F.desc("bm25"), "doc_id").limit(50)


def bm25_fit(spark, sf):
    d = _docs(spark, sf)
    df = search.postings(d).groupBy("tok").agg(F.count("*").alias("df"))
    n = d.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("tok", "df", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


def tfidf_matrix(spark, sf):
    return search.tfidf(_docs(spark, sf)).select("doc_id", "tok", F.round("w", 6).alias("w"))


def tfidf_cosine(spark, sf):
    return search.cosine(_docs(spark, sf), QUERY).select("doc_id", F.round("cosine", 6).alias("cosine"))


def hybrid_topk(spark, sf):
    return search.hybrid(_docs(spark, sf), QUERY, 0.5, 20)


def snippet(spark, sf):
    return _docs(spark, sf).select("doc_id", search.snippet(F.col("text"), "nicht ention").alias("snippet"))


D = "documents"
BM25_SQL = f"""
with t as (select doc_id, {_toks('text')} as toks from documents),
d as (select doc_id, len(toks) as dl, toks from t),
s as (select count(*) as n, avg(dl) as avgdl from d),
q as (select q, count(*) as qn from (select unnest(['nicht', 'thing', 'ention', 'the']) as q) group by q),
p as (select doc_id, dl, q, qn, len(list_filter(toks, lambda x: x = q)) as tf from d, q),
i as (select q, sum(case when tf > 0 then 1 else 0 end) as df from p group by q),
b as (select p.doc_id, sum(qn * case when df > 0 then ln((n - df + 0.5e0) / (df + 0.5e0) + 1) else 0 end * tf * 2.5e0 / greatest(tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1e-6::double)), 1e-9::double)) as bm25
  from p join i using (q), s group by p.doc_id)"""
TFIDF_SQL = f"""
t as (select doc_id, unnest({_toks('text')}) as tok from documents),
p as (select doc_id, tok, count(*) as tf from t group by all),
f as (select tok, count(*) as df from p group by tok),
r as (select doc_id, tok, (1 + ln(tf)) * (ln(((select count(*) from documents) + 1.0e0) / (df + 1.0e0)) + 1) as w from p join f using (tok)),
w as (select doc_id, tok, w / sqrt(sum(w * w) over (partition by doc_id)) as w from r)"""
COS_SQL = TFIDF_SQL + """,
qv as (select q, qn from (select q, count(*) as qn from (select unnest(['nicht', 'thing', 'ention', 'the']) as q) group by q) where q in (select tok from f)),
c as (select doc_id, sum(w * qn / (select sqrt(sum(qn * qn)) from qv)) as cosine from w join qv on tok = q group by doc_id)"""


def _abbreviated(x: str) -> str:
    for a, full in T.ABBREVIATIONS:
        x = rf"regexp_replace({x}, '(?i)\b{a.replace('.', '[.]')}\b', '{full}', 'g')"
    return x


CLEAN = r"regexp_replace(regexp_replace(text, '\x0C', ' ', 'g'), '[^\x09-\x0D\x20-\x7E]', '', 'g')"


def _sentences(x: str) -> str:
    x = rf"regexp_replace({x}, '([0-9]+)\.([0-9]+)', '\1__DECIMAL__\2', 'g')"
    # what stands before is written out, as a word boundary is ASCII here; twice, as it is taken along
    for word in ("([A-Z])", "([A-Z])", "((?i)dr|mr|mrs|ms|vs)"):
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){word}\.', '\1\2__ABBR__', 'g')"
    x = rf"string_split(regexp_replace({x}, '([.!?]){SP}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return rf"list_filter(list_transform({x}, lambda s: {_strip("replace(replace(s, '__DECIMAL__', '.'), '__ABBR__', '.')")}), lambda s: s <> '')"


def _features() -> str:
    n = f"len({_words('t')})"
    low = "lower(t)"
    out = [
        "length(t) as doc_length", f"{n} as word_count",
        f"case when {n} > 0 then round(coalesce(list_sum(list_transform({_words('t')}, lambda w: length(w))), 0)::double / {n}, 6) else 0 end as avg_word_length",
    ]
    for family, keys in T.KEYWORDS.items():
        hits = " + ".join(f"contains({low}, '{k}')::bigint" for k in keys)
        out += [f"{hits} as {family}_count", f"round(({hits})::double / greatest({n}, 1) * 100, 6) as {family}_ratio"]
    out.append(r"len(regexp_extract_all(t, '\b[0-9]+([.][0-9]+)?\b')) as number_count")
    out.append(" + ".join(rf"len(regexp_extract_all({low}, '{p}'))" for p in (r"\b[0-9]+\s*mg\b", r"\b[0-9]+\s*ml\b", r"\b[0-9]+\s*mcg\b", r"\b[0-9]+\s*units?\b", r"\b(daily|bid|tid|qid|prn|qhs|weekly)\b")) + " as medication_pattern_count")
    out += [f"length(t) - length(replace(t, {c}, '')) as {k}_count" for k, c in (("colon", "':'"), ("semicolon", "';'"), ("newline", "chr(10)"))]
    return ", ".join(out)


def _grams(n: int) -> str:
    return f"case when len(w) >= {n} then list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')) else [] end"


NOISE = r"[^\p{L}\p{N}_\s.,;:!?\-/()'']"
ORACLES = {
    "scan_docs": "select lang, count(*) as docs, sum(n_chars)::bigint as chars from documents where length(text) > 0 group by lang",
    "preprocess": f"select doc_id, md5({_pre('text')}) as md5, length({_pre('text')}) as n from documents",
    "normalize_whitespace": r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\x{A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '\t+', ' ', 'g'), ' +', ' ', 'g')) as md5 from documents",
    "remove_extra_newlines": r"select doc_id, md5(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as md5 from documents",
    "clean_text": f"select doc_id, md5({CLEAN}) as md5 from documents",
    "sanitize_text": r"select doc_id, md5(left(regexp_replace(text, '[\x00-\x08\x0B\x0E-\x1F\x{FEFF}]', '', 'g'), 500000)) as md5 from documents",
    "content_hash_dedup": f"select sha256({_pre('text')}) as hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "cache_key": rf"select doc_id, sha256('ner|' || lower(regexp_replace({_strip('text')}, '{SP}+', ' ', 'g')) || '|{{}}') as cache_key from documents",
    "text_stats": f"""with p as (select doc_id, {_pre('text')} as t from documents), q as (select doc_id, t, {_words('t')} as w, {_sentences('t')} as s from p)
select doc_id, length(t) as char_count, len(w) as word_count, len(s) as sentence_count,
 case when len(w) > 0 then round(list_sum(list_transform(w, lambda x: length(x)))::double / len(w), 6) else 0 end as avg_word_length,
 case when len(s) > 0 then round(len(w)::double / len(s), 6) else 0 end as avg_sentence_length from q""",
    "segment_sentences": f"select doc_id, len({_sentences('text')}) as n, md5(array_to_string({_sentences('text')}, '|')) as md5 from documents",
    "validate": rf"""with p as (select doc_id, text, {_strip('text')} as b from documents),
q as (select doc_id, case when octet_length(encode(text)) > 10485760 then 'too many bytes' when length(b) = 0 then 'empty' when length(b) < 20 then 'too short' end as e, contains(text, chr(0)) as z, b,
 case when length(b) > 0 then len(regexp_extract_all(b, '{NOISE}'))::double / length(b) else 0 end as noise from p)
select doc_id, e is null and not z as is_valid, coalesce(e, case when z then 'null bytes' else '' end) as errors,
 case when e is not null then '' else array_to_string(list_filter([case when length(b) > 100000 then 'long' end, case when noise > 0.3 then 'noise' end, case when len({_words('b')}) < 3 then 'few words' end], lambda x: x is not null), ',') end as warnings from q""",
    "abbrev_simple": f"select doc_id, md5({_abbreviated(CLEAN)}) as md5 from documents",
    "feature_custom": f"with c as (select doc_id, {CLEAN} as t from documents) select doc_id, {_features()} from c",
    "feature_pivot": f"""with t as (select doc_id, {_toks('text')} as k from documents) select doc_id, {", ".join(f"len(list_filter(k, lambda x: x = '{w}')) as {w}" for w in ("les", "nicht", "que", "the"))} from t""",
    "tokenize": f"select doc_id, len({_toks('text')}) as n, md5(array_to_string({_toks('text')}, ' ')) as md5 from documents",
    "bow_topk": f"with d as (select {_words('lower(text)')} as w from documents), g as (select unnest(list_concat({_grams(1)}, {_grams(2)})) as ngram from d) select ngram, count(*) as n from g group by ngram order by n desc, ngram limit 200",
    "bow_transform": f"with g as (select doc_id, unnest({_words('lower(text)')}) as ngram from documents), v as (select ngram from g group by ngram order by count(*) desc, ngram limit 100) select doc_id, ngram, count(*) as n from g where ngram in (select ngram from v) group by all",
    "bm25_score": BM25_SQL + " select doc_id, round(bm25, 6) as bm25 from b where round(bm25, 6) > 0 order by round(bm25, 6) desc, doc_id limit 50",
    "bm25_fit": f"with t as (select distinct doc_id, unnest({_toks('text')}) as tok from documents), n as (select count(*) as n from documents) select tok, count(*) as df, round(ln((any_value(n) - count(*) + 0.5e0) / (count(*) + 0.5e0) + 1), 6) as idf from t, n group by tok",
    "tfidf_matrix": "with " + TFIDF_SQL + " select doc_id, tok, round(w, 6) as w from w",
    "tfidf_cosine": "with " + COS_SQL + " select doc_id, round(cosine, 6) as cosine from c",
    "hybrid_topk": BM25_SQL + "," + COS_SQL.replace("\nt as", "\nt2 as").replace("from t group by all", "from t2 group by all").replace("\np as", "\np2 as").replace("from p group by tok", "from p2 group by tok").replace("from p join f", "from p2 join f") + """,
h as (select b.doc_id, 0.5e0 * case when m > 0 then bm25 / m else 0 end + 0.5e0 * coalesce(cosine, 0) as raw, case when m > 0 then bm25 / m else 0 end as x, coalesce(cosine, 0) as y from b left join c using (doc_id), (select max(bm25) as m from b))
select doc_id, round(raw, 4) as score, round(x, 4) as bm25_score, round(y, 4) as tfidf_score from h where raw >= 0 order by round(raw, 9) desc, doc_id limit 20""",
    "snippet": rf"""with l as (select doc_id, text, least(nullif(position('nicht' in lower(text)), 0), nullif(position('ention' in lower(text)), 0)) - 1 as pos from documents),
m as (select *, greatest(pos - 100, 0) as a, least(pos + 100, length(text)) as b from l)
select doc_id, case when pos is null then regexp_replace(left(text, 200), '{SP}+$', '') || case when length(text) > 200 then '…' else '' end
 else case when a > 0 then '…' else '' end || {_strip('substring(text, a + 1, b - a)')} || case when b < length(text) then '…' else '' end end as snippet from m""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
