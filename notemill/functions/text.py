"""Text columns: cleaning, validation, statistics, tokens. Every function takes and returns a Column and stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the reference's strip and split see it.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same as characters, and those of them that are ASCII.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PLAIN_SPACE = r"[\x09-\x0D\x1C-\x20]"

#: The abbreviations that expand_abbreviations replaces, in this order.
ABBREVIATIONS = [
    ("pt", "patient"), ("pt.", "patient"), ("y/o", "year old"), ("yo", "year old"), ("m", "male"), ("f", "female"),
    ("h/o", "history of"), ("c/o", "complains of"), ("sob", "shortness of breath"), ("cp", "chest pain"),
    ("htn", "hypertension"), ("dm", "diabetes mellitus"), ("dm2", "diabetes mellitus type 2"),
    ("dm1", "diabetes mellitus type 1"), ("cad", "coronary artery disease"), ("chf", "congestive heart failure"),
    ("afib", "atrial fibrillation"), ("mi", "myocardial infarction"), ("cva", "cerebrovascular accident"),
    ("tia", "transient ischemic attack"), ("copd", "chronic obstructive pulmonary disease"),
    ("ckd", "chronic kidney disease"), ("esrd", "end stage renal disease"), ("djd", "degenerative joint disease"),
    ("oa", "osteoarthritis"), ("ra", "rheumatoid arthritis"), ("dvt", "deep vein thrombosis"),
    ("pe", "pulmonary embolism"), ("uti", "urinary tract infection"), ("n/v", "nausea and vomiting"),
    ("abd", "abdomen"), ("lmp", "last menstrual period"), ("fh", "family history"), ("sh", "social history"),
    ("pmh", "past medical history"), ("psh", "past surgical history"), ("ros", "review of systems"),
    ("wnl", "within normal limits"), ("nml", "normal"), ("abnl", "abnormal"), ("dx", "diagnosis"),
    ("tx", "treatment"), ("sx", "symptoms"), ("hx", "history"), ("rx", "prescription"), ("prn", "as needed"),
    ("bid", "twice daily"), ("tid", "three times daily"), ("qid", "four times daily"), ("qd", "once daily"),
    ("qhs", "at bedtime"), ("po", "by mouth"), ("iv", "intravenous"), ("im", "intramuscular"),
    ("sc", "subcutaneous"), ("stat", "immediately"), ("nkda", "no known drug allergies"),
    ("nka", "no known allergies"),
]

#: Words that search leaves out.
STOPWORDS = [
    "patient", "history", "examination", "assessment", "plan", "noted", "reviewed", "discussed", "performed", "ordered",
    "mg", "ml", "cm", "mm", "kg", "tab", "po", "iv", "bid", "tid", "qid", "prn", "qd", "hs", "ac", "pc", "qhs", "stat",
]

#: Keyword families of the custom features.
KEYWORDS = {
    "urgent_keywords": ["urgent", "emergent", "stat", "immediate", "emergency", "critical", "acute"],
    "negation_keywords": ["no", "not", "denies", "denied", "without", "negative", "absent", "none", "never"],
    "uncertainty_keywords": ["possible", "probable", "likely", "suspected", "concern for", "rule out", "consider", "may have", "might", "perhaps", "?"],
    "pain_keywords": ["pain", "ache", "tenderness", "discomfort", "hurt", "sore", "cramp", "spasm"],
}
MAX_CHARS, MAX_BYTES, MIN_CHARS = 100_000, 10 * 1024 * 1024, 20


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """What white space separates; none for an empty text."""
    plain = F.length(text) == F.octet_length(text)
    return F.filter(F.when(plain, F.split(text, rf"{PLAIN_SPACE}+")).otherwise(F.split(text, rf"{SPACE}+")), lambda w: w != "")


def normalize_whitespace(text: Column) -> Column:
    text = F.regexp_replace(text, r"[\x{A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}]", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\t+", " "), " +", " ")


def remove_extra_newlines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n{3,}", "\n\n")


def preprocess(text: Column, max_chars: int = MAX_CHARS) -> Column:
    return strip(remove_extra_newlines(normalize_whitespace(F.left(text, F.lit(max_chars)))))


def preprocess_clinical(text: Column) -> Column:
    """preprocess; null and blank texts become empty."""
    return F.coalesce(preprocess(text), F.lit(""))


def clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\x0C", " "), r"[^\x09-\x0D\x20-\x7E]", "")


def sanitize(text: Column, max_chars: int = 500_000) -> Column:
    return F.left(F.regexp_replace(text, r"[\x00-\x08\x0B\x0E-\x1F\x{FEFF}]", ""), F.lit(max_chars))


def content_hash(text: Column) -> Column:
    return F.sha2(preprocess(text), 256)


def cache_text(text: Column) -> Column:
    return F.lower(F.regexp_replace(strip(text), rf"{SPACE}+", " "))


def cache_key(model: str, text: Column, options: str = "{}") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), cache_text(text), F.lit(options)), 256)


def expand_abbreviations(text: Column) -> Column:
    """The replacements one after the other; a later one sees what an earlier one wrote."""
    return reduce(lambda t, a: F.regexp_replace(t, rf"(?i)\b{a[0].replace('.', '[.]')}\b", a[1]), ABBREVIATIONS, text)


def sentences(text: Column) -> Column:
    """Cut after . ! or ? before white space and a capital; decimals, single capitals and titles don't end a sentence."""
    mark = F.regexp_replace(text, r"(\d+)\.(\d+)", "$1__DECIMAL__$2")
    mark = F.regexp_replace(mark, r"\b([A-Z])\.", "$1__ABBR__")
    mark = F.regexp_replace(mark, r"(?i)\b(dr|mr|mrs|ms|vs)\.", "$1__ABBR__")
    parts = F.split(mark, rf"(?<=[.!?]){SPACE}+(?=[A-Z])")
    whole = F.transform(parts, lambda s: strip(F.replace(F.replace(s, F.lit("__DECIMAL__"), F.lit(".")), F.lit("__ABBR__"), F.lit("."))))
    return F.filter(whole, lambda s: s != "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def text_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, char_count, word_count, sentence_count, avg_word_length, avg_sentence_length of the preprocessed texts."""
    t = docs.select(F.col(key), preprocess(F.col(text)).alias("t"))
    t = t.select(key, "t", words(F.col("t")).alias("w"), F.size(sentences(F.col("t"))).cast("bigint").alias("s"))
    t = t.select(key, F.length("t").cast("bigint").alias("char_count"), F.size("w").cast("bigint").alias("word_count"), F.col("s").alias("sentence_count"), letters("w").alias("letters"))
    return t.select(key, "char_count", "word_count", "sentence_count", F.round(ratio(F.col("letters"), F.col("word_count")), 6).alias("avg_word_length"), F.round(ratio(F.col("word_count"), F.col("sentence_count")), 6).alias("avg_sentence_length"))


def letters(words: str) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))


def validation(text: Column) -> Column:
    """struct(is_valid, errors, warnings). Too many bytes, blank and too short each end the checks."""
    body = strip(text)
    noise = ratio(count_of(body, r"[^\p{L}\p{N}_\s.,;:!?\-/()']"), F.length(body))
    too_big, blank, short = F.octet_length(text) > MAX_BYTES, F.length(body) == 0, F.length(body) < MIN_CHARS
    nul = F.contains(text, F.lit("\x00"))
    early = F.when(too_big, "too many bytes").when(blank, "empty").when(short, "too short")
    errors = F.array_compact(F.array(F.coalesce(early, F.when(nul, F.lit("null bytes")))))
    warnings = F.array_compact(F.array(F.when(F.length(body) > MAX_CHARS, F.lit("long")), F.when(noise > 0.30, F.lit("noise")), F.when(F.size(words(body)) < 3, F.lit("few words"))))
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), F.when(early.isNotNull(), F.array().cast("array<string>")).otherwise(warnings).alias("warnings"))


def tokens(text: Column) -> Column:
    """Search tokens: runs of a-z and 0-9 of the lower-cased text, two characters or more, without STOPWORDS."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def custom_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the hand-made features of a note, without those of its sections."""
    t = docs.select(F.col(key), F.col(text).alias("t"))
    t = t.select(key, "t", F.lower("t").alias("low"), words(F.col("t")).alias("w"))
    hits = [reduce(lambda a, k: a + F.contains("low", F.lit(k)).cast("bigint"), keys, F.lit(0).cast("bigint")).alias(f"{family}_count") for family, keys in KEYWORDS.items()]
    doses = (r"\b[0-9]+\s*mg\b", r"\b[0-9]+\s*ml\b", r"\b[0-9]+\s*mcg\b", r"\b[0-9]+\s*units?\b", r"\b(daily|bid|tid|qid|prn|qhs|weekly)\b")
    found = sum((count_of(F.col("low"), p).cast("bigint") for p in doses), F.lit(0).cast("bigint"))
    marks = [count_of(F.col("t"), c).cast("bigint").alias(f"{name}_count") for name, c in (("colon", ":"), ("semicolon", ";"), ("newline", "\n"))]
    t = t.select(key, F.length("t").cast("bigint").alias("doc_length"), F.size("w").cast("bigint").alias("word_count"), letters("w").alias("letters"), *hits, count_of(F.col("t"), r"\b[0-9]+([.][0-9]+)?\b").cast("bigint").alias("number_count"), found.alias("medication_pattern_count"), *marks)
    ratios = {f"{family}_ratio": F.round(F.col(f"{family}_count") / F.greatest("word_count", F.lit(1)) * 100, 6) for family in KEYWORDS}
    return t.withColumns({"avg_word_length": F.round(ratio(F.col("letters"), F.col("word_count")), 6)} | ratios).drop("letters")
