"""Queries of normalisation, tokens, stems, similarity and counts over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import matching as m
from ..sources.fixtures import STOP
from ._register import query

_COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _replaced(*steps: tuple[str, str]) -> str:
    out = "lower(text)"
    for pattern, new in steps:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return _COLLAPSED.format(out)


_SQL = {
    "strip_markup": _replaced((r"<[^>]*>", " "), (r"https?://[^\s]+", " "), (r"[^\s@]+@[^\s@]+\.[^\s@]+", " "), (r"[a-zA-Z]:[\\/][^\s]*", " "), (r"/[a-zA-Z0-9_./\-]*", " "), (r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", " "), (r"[^a-z0-9\s\-._/]", " ")),
    "without_suffixes": _replaced((r"\.(js|ts)", ""), (r"[^\w\s]", " ")),
    "words_only": _replaced((r"[^\w\s]", " ")),
    "squeezed": _replaced((r"[^\w\s]", "")),
    "keep_hyphens": _replaced((r"[^\w\s-]", " ")),
    "keep_technical": _replaced((r"[^\w\s\-/+#.]", " ")),
    "protect_names": _replaced(*t.PROTECTED, (r"[^\w\s]", " ")).replace("\\\\", "\\"),
    "letters_of_any_script": _replaced((r"[^\p{L}\p{N}\s.\-/]", " ")),
    "keep_dots": _replaced((r"[^\w\s.-]", " ")),
    "no_separators": r"regexp_replace(lower(text), '[.\-_/\\]', '', 'g')",
    "comparable": _replaced(),
}
for _name, _expr in _SQL.items():

    def _normalised(v, f=t.NORMALISERS[_name]):
        out = f(F.col("text"))
        return v.resumes.select("resume_id", F.length(out).alias("n"), F.md5(out.cast("binary")).alias("digest"))

    query(f"normalise_{_name}", f"SELECT resume_id, length(x) AS n, md5(x) AS digest FROM (SELECT resume_id, {_expr} AS x FROM fx_resumes)", "fx_resumes")(_normalised)

_TOKENS = r"(SELECT resume_id, text, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS toks FROM fx_resumes)"


def _toks(v):
    return v.resumes.select("resume_id", "text", t.tokens(t.words_only(F.col("text"))).alias("toks"))


def _stop_sql() -> str:
    return "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query("token_counts", f"SELECT resume_id, len(toks) AS n_tokens, len(list_filter(toks, lambda x: length(x) >= 3 AND NOT list_contains({_stop_sql()}, x))) AS n_content, len(list_distinct(toks)) AS n_distinct FROM {_TOKENS}", "fx_resumes")
def token_counts(v):
    return _toks(v).select("resume_id", F.size("toks").alias("n_tokens"), F.size(t.without_stopwords(F.col("toks"), STOP)).alias("n_content"), F.size(F.array_distinct("toks")).alias("n_distinct"))


@query("bigram_counts", """
SELECT gram, count(*) AS n, count(DISTINCT resume_id) AS n_resumes FROM (
  SELECT resume_id, token || ' ' || lead(token) OVER (PARTITION BY resume_id ORDER BY pos) AS gram FROM fx_tokens) WHERE gram IS NOT NULL GROUP BY gram""", "fx_tokens")
def bigram_counts(v):
    """A résumé's pairs are sorted in its row, so that the first of each kind counts it; only rows that share an id are counted by ids."""
    rows = _toks(v).select("resume_id", F.sort_array(t.ngrams(F.col("toks"), 2)).alias("grams"))
    once, shared = m.by_repeated_key(rows, v.resumes.select("resume_id"), "resume_id")
    firsts = F.transform("grams", lambda g, i: F.struct(g.alias("gram"), F.when((i > 0) & (F.get("grams", i - 1) == g), 0).otherwise(1).alias("first")))
    grams = once.select(F.explode(firsts).alias("g")).groupBy("g.gram").agg(F.count(F.lit(1)).alias("n"), F.sum("g.first").alias("n_resumes"))
    if shared is None:
        return grams
    more = shared.select("resume_id", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("resume_id").alias("n_resumes"))
    return grams.unionByName(more).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_resumes").alias("n_resumes"))


@query("gram_candidates", f"SELECT resume_id, len(toks) + greatest(len(toks) - 1, 0) AS n_grams, coalesce(toks[1], '') AS first_gram FROM {_TOKENS}", "fx_resumes")
def gram_candidates(v):
    grams = t.grams_up_to_two(F.col("toks"))
    return _toks(v).select("resume_id", F.size(grams).alias("n_grams"), F.coalesce(F.try_element_at(grams, F.lit(1)), F.lit("")).alias("first_gram"))


@query("separated_term_counts", "SELECT resume_id, len(x) AS n_terms, array_to_string(list_sort(list_distinct(x)), ';') AS terms FROM (SELECT resume_id, list_filter(list_transform(string_split_regex(lower(text), '[/,|]'), lambda x: trim(x)), lambda x: length(x) > 1 AND length(x) < 50) AS x FROM fx_resumes)", "fx_resumes")
def separated_term_counts(v):
    terms = t.separated_terms(F.col("text"))
    return v.resumes.select("resume_id", F.size(terms).alias("n_terms"), F.array_join(F.array_sort(F.array_distinct(terms)), ";").alias("terms"))


@query("word_sets", r"SELECT resume_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[\s,;:.!?()|/]+'), lambda x: length(x) > 2))) AS n_words FROM fx_resumes", "fx_resumes")
def word_sets(v):
    return v.resumes.select("resume_id", F.size(t.word_set(F.col("text"))).alias("n_words"))


@query("first_words", f"SELECT resume_id, array_to_string(toks[1:3], ' ') AS opening, list_filter(toks, lambda x: NOT list_contains({_stop_sql()}, x))[1] AS first_meaningful FROM {_TOKENS}", "fx_resumes")
def first_words(v):
    return _toks(v).select("resume_id", t.first_words(F.col("toks"), 3).alias("opening"), t.first_meaningful(F.col("toks"), STOP).alias("first_meaningful"))


@query("sentence_counts", r"SELECT resume_id, len(s) AS n_sentences, len(s) - len(list_distinct(list_transform(s, lambda x: lower(x)))) AS n_repeated FROM (SELECT resume_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM fx_resumes)", "fx_resumes")
def sentence_counts(v):
    rows = v.resumes.select("resume_id", t.sentences(F.col("text")).alias("s"))
    return rows.select("resume_id", F.size("s").alias("n_sentences"), (F.size("s") - F.size(F.array_distinct(F.transform("s", F.lower)))).alias("n_repeated"))


@query("keyword_in_context", f"SELECT resume_id, array_to_string(toks[greatest(1, p - 2):p + 2], ' ') AS context FROM (SELECT *, list_position(toks, 'rest') AS p FROM {_TOKENS}) WHERE p > 0", "fx_resumes")
def keyword_in_context(v):
    return _toks(v).select("resume_id", t.context_words(F.col("toks"), "rest").alias("context")).where("context IS NOT NULL")


@query("character_context", "SELECT resume_id, len(c) AS n_finds, c[1] AS first_find FROM (SELECT resume_id, regexp_extract_all(text, '(.{0,50}rest.{0,50})', 1) AS c FROM fx_resumes) WHERE len(c) > 0", "fx_resumes")
def character_context(v):
    rows = v.resumes.select("resume_id", t.context_characters(F.col("text"), "rest").alias("c")).where(F.size("c") > 0)
    return rows.select("resume_id", F.size("c").alias("n_finds"), F.element_at("c", 1).alias("first_find"))


_STEM_STEPS = "token"
for _end, _new in (("ies", "i"), ("es", ""), ("s", ""), ("ing", ""), ("ed", ""), ("tion", "t"), ("ation", "t")):
    _STEM_STEPS = f"(CASE WHEN suffix({_STEM_STEPS}, '{_end}') THEN left({_STEM_STEPS}, length({_STEM_STEPS}) - {len(_end)}) || '{_new}' ELSE {_STEM_STEPS} END)"
# each step names the one before four times; a chain of selects keeps the text short
_STEM_SQL = "SELECT DISTINCT token, token AS s0 FROM fx_tokens"
for _k, (_end, _new) in enumerate((("ies", "i"), ("es", ""), ("s", ""), ("ing", ""), ("ed", ""), ("tion", "t"), ("ation", "t"))):
    _STEM_SQL = f"SELECT token, CASE WHEN suffix(s{_k}, '{_end}') THEN left(s{_k}, length(s{_k}) - {len(_end)}) || '{_new}' ELSE s{_k} END AS s{_k + 1} FROM ({_STEM_SQL})"
del _STEM_STEPS


@query("stems", f"SELECT token, s7 AS stem_steps, regexp_replace(regexp_replace(token, '(s|es|ed|ing|tion|ation)$', ''), 'y$', 'i') AS stem_once, regexp_replace(token, '(ing|tion|ment|al|ed|s|ly)$', '') AS stem_short FROM ({_STEM_SQL})", "fx_tokens")
def stems(v):
    words = _toks(v).select(F.explode("toks").alias("token")).distinct()
    return words.select("token", t.stem_steps(F.col("token")).alias("stem_steps"), t.stem_once(F.col("token")).alias("stem_once"), t.stem_short(F.col("token")).alias("stem_short"))


@query("term_frequencies", f"SELECT resume_id, token, least(count(*), 5) AS weight FROM fx_tokens WHERE length(token) > 2 AND NOT list_contains({_stop_sql()}, token) GROUP BY resume_id, token", "fx_tokens")
def term_frequencies(v):
    rows = _toks(v).select("resume_id", F.explode(t.without_stopwords(F.col("toks"), STOP)).alias("token"))
    return rows.groupBy("resume_id", "token").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("weight"))


@query("repeated_words", "SELECT resume_id, count_if(n > 4) AS repeated, max(n) AS most FROM (SELECT resume_id, token, count(*) AS n FROM fx_tokens WHERE length(token) > 3 GROUP BY 1, 2) GROUP BY resume_id", "fx_tokens")
def repeated_words(v):
    rows = _toks(v).select("resume_id", F.explode(F.filter("toks", lambda x: F.length(x) > 3)).alias("token"))
    return rows.groupBy("resume_id", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("resume_id").agg(F.count_if(F.col("n") > 4).alias("repeated"), F.max("n").alias("most"))


@query("word_occurrences", r"SELECT resume_id, len(regexp_extract_all(lower(text), '\brest\b')) AS rest, len(regexp_extract_all(lower(text), '\bthe\b')) AS the, len(regexp_extract_all(lower(text), '\bdes\b')) AS des FROM fx_resumes", "fx_resumes")
def word_occurrences(v):
    low = F.lower("text")
    return v.resumes.select("resume_id", *[t.count_word(low, w).alias(w) for w in ("rest", "the", "des")])


@query("title_similarity", """
SELECT a.role AS left_role, b.role AS right_role, levenshtein(a.r, b.r) AS distance, CAST((greatest(length(a.r), length(b.r)) - levenshtein(a.r, b.r)) * 1.0 / greatest(length(a.r), length(b.r)) AS DECIMAL(10,4)) AS similarity
FROM (SELECT DISTINCT role, regexp_replace(lower(role), '[^a-z0-9]', '', 'g') AS r FROM fx_library) a JOIN (SELECT DISTINCT role, regexp_replace(lower(role), '[^a-z0-9]', '', 'g') AS r FROM fx_library) b ON a.role < b.role""", "fx_library")
def title_similarity(v):
    """All pairs of distinct roles: the catalogue of roles is one array beside each of them, in blocks by hash."""
    roles = v.library.select("role").distinct()
    blocks = roles.groupBy(F.pmod(F.xxhash64("role"), F.lit(8)).alias("block")).agg(F.collect_list("role").alias("others"))
    each = roles.select(F.col("role").alias("left_role"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    pairs = each.join(blocks, F.col("b") == F.col("block")).select("left_role", F.explode("others").alias("right_role")).where("left_role < right_role")
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return pairs.select("left_role", "right_role", F.levenshtein(bare("left_role"), bare("right_role")).cast("long").alias("distance"), t.similarity(F.col("left_role"), F.col("right_role")).cast("decimal(10,4)").alias("similarity"))


@query("ascii_languages", "SELECT resume_id, CASE WHEN len(regexp_extract_all(text, '[\\x00-\\x7F]')) * 1.0 / nullif(length(text), 0) > 0.98 THEN 'en' ELSE 'other' END AS guess FROM fx_resumes", "fx_resumes")
def ascii_languages(v):
    return v.resumes.select("resume_id", F.when(t.ascii_share(F.col("text")) > 0.98, "en").otherwise("other").alias("guess"))


@query("density_scores", r"""
SELECT resume_id, least(15, len(regexp_extract_all(lower(text), '\bof the\b')) * 5) + CAST(floor((list_contains(toks, 'of')::INT + list_contains(toks, 'the')::INT) * 10 / 2.0 + 0.5) AS BIGINT) AS density
FROM """ + _TOKENS, "fx_resumes")
def density_scores(v):
    return v.resumes.select("resume_id", t.keyword_density(F.col("text"), "of the").alias("density"))


@query("title_hashes", """
SELECT resume_id, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS hash, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 7 AS choice
FROM (SELECT resume_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(title || ':' || resume_id, ''), lambda c: ascii(c)::BIGINT)), lambda s, c: (s * 31 + c) % 4294967296) AS h FROM fx_resumes)""", "fx_resumes")
def title_hashes(v):
    h = t.rolling_hash(F.concat("title", F.lit(":"), "resume_id"))
    return v.resumes.select("resume_id", h.alias("hash"), (h % 7).alias("choice"))


@query("file_names", r"SELECT user_id, regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g') || '_' || lower(role) || '_resume.pdf' AS file_name, upper(substr(lower(name), 1, 1)) || substr(lower(name), 2) AS display FROM fx_users", "fx_users")
def file_names(v):
    return v.users.select("user_id", F.concat_ws("_", F.regexp_replace("name", "[^A-Za-z0-9]+", "_"), F.lower("role"), F.lit("resume.pdf")).alias("file_name"), t.capitalised(F.lower("name")).alias("display"))


@query("month_texts", """
SELECT report_id, strftime(created_at, '%Y-%m') AS iso, strftime(created_at, '%Y-%m') AS from_slash, strftime(created_at, '%Y-%m') AS from_name, strftime(created_at, '%Y') || '-01' AS from_year, '' AS from_none FROM fx_reports""", "fx_reports")
def month_texts(v):
    from ..functions.dates import month_text

    at = F.col("created_at")
    texts = {"iso": F.date_format(at, "yyyy-MM-dd"), "from_slash": F.date_format(at, "MM/yyyy"), "from_name": F.date_format(at, "MMMM yyyy"), "from_year": F.date_format(at, "yyyy"), "from_none": F.lit("Present")}
    return v.reports.select("report_id", *[month_text(x).alias(k) for k, x in texts.items()])
