"""Rules as data, the stored index and the fitted feature space over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.functions import nested
from notemill.functions import phrases as P
from notemill.operators import abbreviations, allergies, concepts, feature_space, medications, sections
from notemill.operators.inverted_index import Index
from notemill.plans.clinical_queries import NOTES
from notemill.plans.text_queries import BM25_SQL, COS_SQL, QUERY, _docs, _toks
from notemill.sources import notes as N
from notemill.streaming.windows import _folder

#: A user's own rules beside the dictionaries: a detector and triggers of two kinds.
OWN = {"workup": "order", "schedule": "order", "follow up": "order", "routine": "no urgency", "urgent": "urgency", "no known": "negation", "denies": "negation"}
SETS = {
    "drugs": medications.DRUGS,
    "allergens": {form: name for form, (name, _) in allergies.ALLERGENS.items()},
    "abbreviations": {k: e for k, (_, e, _) in abbreviations.entries().items()},
    "concepts": {n.lower(): term for _, term, aliases, *_ in concepts.CONCEPTS for n in (term, *aliases)},
    "sections": sections.CATEGORIES,
    "own": OWN,
}


def _rows() -> list[tuple[str, str, str]]:
    return [(name, p, e) for name, s in SETS.items() for p, e in (s.items() if isinstance(s, dict) else ((p, p) for p in s))]


def phrase_hits(spark, sf):
    """Every rule of every set over all notes, in one pass: rules, entry, hits, notes."""
    found = P.with_phrases(N.notes(spark, sf), P.rule_rows(spark, SETS)).select("note_id", F.inline("phrases"))
    return found.groupBy("rules", "entry").agg(F.count("*").alias("hits"), F.countDistinct("note_id").alias("notes"))


def phrase_leftmost(spark, sf):
    """The drugs and own rules of each note that count where matches may not overlap: note_id, rules, entry, start, end."""
    rules = P.rule_rows(spark, {k: SETS[k] for k in ("drugs", "own")})
    found = P.with_phrases(N.notes(spark, sf), rules)
    return found.select("note_id", F.inline(P.leftmost(F.col("phrases")))).select("note_id", "rules", "entry", "start", "end")


def _index(spark, sf) -> Index:
    """All documents in two batches by language, those of the first that the labels call toxic taken out again, all of one language sent again."""
    docs = _docs(spark, sf).select("doc_id", "text", "lang")
    index = Index(spark, _folder(spark), blocks=16)
    index.add(docs.where("lang in ('en', 'fr') or lang is null"))
    index.delete(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1"))
    index.add(docs.where("not lang in ('en', 'fr')"))
    index.add(docs.where("lang = 'fr'"))
    return index


def index_bm25(spark, sf):
    return _index(spark, sf).bm25(QUERY).select("doc_id", F.round("bm25", 6).alias("bm25"))


def index_cosine(spark, sf):
    return _index(spark, sf).cosine(QUERY).select("doc_id", F.round("cosine", 6).alias("cosine"))


def feature_fit(spark, sf):
    return feature_space.fit(_docs(spark, sf), min_df=5, max_df=0.5).select("tok", "df", F.round("idf", 6).alias("idf"), "column")


def feature_transform(spark, sf):
    """Fitted on the documents, used on the pages' texts: the words of a page that the space knows."""
    space = feature_space.fit(_docs(spark, sf), min_df=5, max_df=0.5)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = feature_space.transform(pages, space, "page_id", "html")
    return out.select("page_id", F.explode("vector").alias("column", "w")).select("page_id", "column", F.round("w", 6).alias("w"))


def feature_contributions(spark, sf):
    """A linear score whose weight is the words' idf with a sign by column: score and how many parts are for and against it."""
    space = feature_space.fit(_docs(spark, sf), min_df=5, max_df=0.5)
    weights = space.select("column", (F.col("idf") * F.when(F.col("column") % 2 == 0, 1).otherwise(-1)).alias("weight"))
    told = feature_space.contributions(feature_space.transform(_docs(spark, sf), space), weights)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x["part"]), 5)
    return told.select("doc_id", F.round("score", 5).alias("score"), total("for_it").alias("for_it"), total("against_it").alias("against_it"))


def sanitize_nested(spark, sf):
    """Documents as nested rows (a struct with an array of lines and a map), sanitised at every depth: doc_id and what each place hashes to."""
    lines = F.struct(F.split("text", "\n").alias("lines"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("whole"), F.col("text")).alias("about"), F.col("n_chars"))
    done = nested.sanitized(_docs(spark, sf).select("doc_id", F.struct(lines.alias("inner"), F.col("source")).alias("outer")))
    at = F.col("outer.inner")
    return done.select("doc_id", F.md5(F.array_join(at["lines"], "\n")).alias("lines"), F.md5(at["about"]["whole"]).alias("whole"), at["about"]["lang"].alias("lang"), F.col("outer.source").alias("source"), at["n_chars"].alias("n_chars"))


_LIVE = "select doc_id, text from documents where not (coalesce(lang = 'en', true) and doc_id in (select doc_id from labels where toxic = 1))"
_RULES = "r(rules, phrase, entry) as (values " + ", ".join("(" + ", ".join(f"'{x}'" for x in (n, p.lower(), e)) + ")" for n, p, e in sorted(set(_rows()))) + ")"
#: Each phrase by itself at the places where it stands between other characters than letters, digits and underscores; notes are ASCII.
_EDGE = "case when regexp_matches(phrase, '^\\w') then '\\b' else '' end || regexp_escape(phrase) || case when regexp_matches(phrase, '\\w$') then '\\b' else '' end"
_SPACE = f"""t as (select doc_id, unnest({_toks("coalesce(text, '')")}) as tok from documents), n as (select count(*) as n from documents),
v as (select tok, count(distinct doc_id) as df from t group by tok having count(distinct doc_id) >= 5 and count(distinct doc_id) <= 0.5e0 * (select n from n)),
s as (select tok, df, ln((1 + n) / (1.0e0 + df)) + 1 as idf, row_number() over (order by tok) - 1 as "column" from v, n)"""


def _vectors(name: str, table: str, key: str, text: str) -> str:
    return f"""{name}c as (select {key}, tok, count(*) as tf from (select {key}, unnest({_toks(f"coalesce({text}, '')")}) as tok from {table}) group by all),
{name}w as (select {key}, "column", idf, (1 + ln(tf)) * idf as w from {name}c join s using (tok)), {name} as (select {key}, "column", idf, w / sqrt(sum(w * w) over (partition by {key})) as w from {name}w)"""


_CLEAN = r"left(regexp_replace({}, '[\x00-\x08\x0B\x0E-\x1F\x{{FEFF}}]', '', 'g'), 500000)"
ORACLES = {
    "sanitize_nested": f"""select doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_CLEAN.format("x")}), chr(10))) as lines, md5({_CLEAN.format("text")}) as whole,
{_CLEAN.format("lang")} as lang, {_CLEAN.format("source")} as source, n_chars from documents""",
    "phrase_hits": f"""with {NOTES}, {_RULES}, p as (select distinct phrase, {_EDGE} as pattern from r),
h as (select note_id, phrase, len(regexp_extract_all(lower(text), pattern)) as n from notes join p on contains(lower(text), phrase))
select rules, entry, sum(n)::bigint as hits, count(distinct note_id) as notes from h join r using (phrase) where n > 0 group by rules, entry""",
    "index_bm25": BM25_SQL.replace("from documents", f"from ({_LIVE})") + " select doc_id, round(bm25, 6) as bm25 from b where bm25 > 0",
    "index_cosine": "with l as (" + _LIVE + ")," + COS_SQL.replace("from documents", "from l") + " select doc_id, round(cosine, 6) as cosine from c",
    "feature_fit": f'with {_SPACE} select tok, df, round(idf, 6) as idf, "column" from s',
    "feature_transform": f'with {_SPACE}, {_vectors("x", "pages", "page_id", "html")} select page_id, "column", round(w, 6) as w from x',
    "feature_contributions": f"""with {_SPACE}, {_vectors("x", "documents", "doc_id", "text")},
c as (select doc_id, "column", w * idf * case when "column" % 2 = 0 then 1 else -1 end as part from x),
k as (select *, row_number() over (partition by doc_id order by part desc, "column") as a, row_number() over (partition by doc_id order by part, "column" desc) as z from c),
g as (select doc_id, sum(part) as score, sum(part) filter (part > 0 and a <= 5) as f, sum(part) filter (part < 0 and z <= 5) as o from k group by doc_id)
select d.doc_id, round(coalesce(score, 0), 5) as score, round(coalesce(f, 0), 5) as for_it, round(coalesce(o, 0), 5) as against_it from documents d left join g using (doc_id)""",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "phrase_leftmost")}
