"""Queries of records: requirement and breakdown shapes, seeds, roles, vocabularies, keyword profiles, skills, narrative texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import dictionary_match as d, extraction as x, features as f, flows, matching as m, records as r
from ..operators.dashboards import top_k, without_keys
from ..sources import store
from ..sources.fixtures import ROLES, STOP, SYNONYMS, VERBS
from . import component_sql as sql
from ._register import query
from .keywords import _PHRASES
from .profiles import _COMPONENTS, _VIEWS, _components
from .scores import _keywords, _matches, _pairs, _tokens
from .suggestions import _SUGGESTED, _suggested
from .variants import BUCKETS, _bucket_sql

_SV = "fx_tokens fx_jd_keywords fx_bullets fx_lines fx_features fx_resumes"
_TOKS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
#: The fixed tables, and values for words of the given documents behind them.
GROUPS = (*r.VARIANT_GROUPS, ("than", "that", "then"), ("ther", "thether"), ("les", "lesle"))
PHRASES = (*r.TECHNICAL_PHRASES, ("the|in", "th\\w+|an\\w+"))
TOOLS = [*r.TOOLS, "the", "rest", "thation"]
ALIASES = {"nodejs": "node.js", "reactjs": "react", "vuejs": "vue", "mongo": "mongodb", "postgres": "postgresql", "restful": "rest", "than": "that", "there": "the"}
WHITELIST = ["node.js", "react", "vue", "mongodb", "postgresql", "rest", "docker", "kubernetes", "that", "with"]
ROLE_TERMS = {"backend": [("thation", 5), ("than", 2)], "frontend": [("rest", 3), ("in", 1)], "data": [("with", 2), ("elle", 4)]}
WANTED = [*r.TECH_TOKENS, *r.RESPONSIBILITY_VERBS, "that", "with", "there"]


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query("jd_engine_shape", f"""SELECT jd_id, CASE length(jd_text) % 3 WHEN 0 THEN w[1] WHEN 1 THEN w[2] ELSE '' END AS title, w[3] AS company, length(jd_text) AS n_description, array_to_string(w[1:3], ',') AS keywords
FROM (SELECT jd_id, jd_text, {_TOKS.format('jd_text')} AS w FROM fx_jds)""", "fx_jds")
def jd_engine_shape(v):
    """Requirements as JSON in two shapes, read into one."""
    n, w = F.length("jd_text"), t.tokens(t.words_only(F.col("jd_text")))
    word = lambda k: F.get("w", F.lit(k))
    rows = v.jds.withColumn("w", w)
    words = F.slice("w", 1, 3)
    keywords = F.when(n % 2 == 0, F.to_json(F.transform(words, lambda k: F.struct(k.alias("keyword"), F.lit(1).alias("frequency"))))).otherwise(F.to_json(words))
    doc = F.struct(F.when(n % 3 == 0, word(0)).alias("roleDetected"), F.when(n % 3 == 1, word(1)).otherwise("").alias("jobTitle"), F.when(n % 2 == 0, word(2)).alias("companyName"), word(2).alias("company"), F.col("jd_text").alias("jdText"))
    raw = F.to_json(doc)
    raw = F.concat(F.substring(raw, F.lit(1), F.length(raw) - 1), F.lit(",\"extractedKeywords\":"), keywords, F.lit("}"))
    parsed = store.parsed_requirements(rows.select("jd_id", raw.alias("value")))
    return parsed.select("jd_id", "title", "company", F.length("description").alias("n_description"), F.array_join("keywords", ",").alias("keywords"))


@query("seeded_roles", "SELECT role, count(DISTINCT library_id) AS n_libraries, count(*) AS n_terms FROM fx_library GROUP BY role", "fx_library")
def seeded_roles(v):
    """A dimension seeded twice over the same place: the second load stands."""
    roles = v.library.groupBy("role").agg(F.count_distinct("library_id").alias("n_libraries"), F.count(F.lit(1)).alias("n_terms"))
    path = store.fresh_path(v.spark, "seed-roles")
    store.seeded(roles.limit(1), path)
    return store.seeded(roles, path)


@query("roles_inserted", "SELECT role, count(DISTINCT library_id) AS n FROM fx_library GROUP BY role UNION ALL SELECT 'Brand#99', 0", "fx_library")
def roles_inserted(v):
    """Of two new roles one is there already and stays as it is."""
    roles = v.library.groupBy("role").agg(F.count_distinct("library_id").alias("n"))
    new = v.spark.createDataFrame([("Brand#11", 0), ("Brand#99", 0)], "role string, n long")
    return r.inserted_if_absent(roles, new, "role")


@query("roles_deleted", "SELECT role, count(DISTINCT library_id) AS n FROM fx_library WHERE role NOT IN ('Brand#11', 'Brand#98') GROUP BY role", "fx_library")
def roles_deleted(v):
    roles = v.library.groupBy("role").agg(F.count_distinct("library_id").alias("n"))
    return without_keys(roles, v.spark.createDataFrame([("Brand#11",), ("Brand#98",)], "role string"), "role")


@query("stored_breakdowns", "SELECT report_id, total_score::DOUBLE AS keyword_match, (total_score % 50)::DOUBLE AS completeness, CASE report_id % 4 WHEN 2 THEN 0 ELSE 7 END::DOUBLE AS formatting, CASE report_id % 4 WHEN 3 THEN NULL ELSE total_score END::DOUBLE AS total FROM fx_reports", "fx_reports")
def stored_breakdowns(v):
    """Breakdowns of four shapes (nested or flat, new or old names), read by one reader."""
    s, k, kind = F.col("total_score"), F.col("total_score") % 50, F.col("report_id") % 4
    score = lambda value: F.struct(value.alias("score"))
    shapes = (
        F.to_json(F.struct(score(s).alias("keywordMatch"), score(k).alias("completeness"), score(F.lit(7)).alias("formatting"), s.alias("totalScore"))),
        F.to_json(F.struct(s.alias("keywordMatch"), k.alias("completeness"), F.lit(7).alias("formatting"), s.alias("score"))),
        F.to_json(F.struct(score(s).alias("keywordMatchScore"), F.lit(0).alias("keywordMatch"), score(k).alias("sectionCompletenessScore"), F.struct(s.alias("totalScore")).alias("totalScore"))),
        F.to_json(F.struct(s.alias("keywordMatchScore"), k.alias("sectionCompletenessScore"), F.lit(7).alias("formattingScore"))),
    )
    rows = v.reports.select("report_id", F.when(kind == 0, shapes[0]).when(kind == 1, shapes[1]).when(kind == 2, shapes[2]).otherwise(shapes[3]).alias("record"))
    read = lambda *keys: r.drifting_score(F.col("record"), *keys)
    return rows.select("report_id", read("keywordMatch", "keywordMatchScore").alias("keyword_match"), read("completeness", "sectionCompletenessScore").alias("completeness"), read("formatting", "formattingScore").alias("formatting"), r.drifting_total(F.col("record")).alias("total"))


@query("keyword_enum_categories", "SELECT resume_id, CASE template WHEN 'classic' THEN 'skill' WHEN 'fresher' THEN 'tool' ELSE 'other' END AS category FROM fx_resumes", "fx_resumes")
def keyword_enum_categories(v):
    raw = F.when(F.col("template") == "classic", "language").when(F.col("template") == "fresher", "cloud").otherwise(F.col("template"))
    return v.resumes.select("resume_id", r.mapped(raw, r.CATEGORY_ENUM, "other").alias("category"))


_SKILLS = "list_distinct(list_filter(list_transform(string_split_regex(lower(coalesce(lines[2], '')), '[,•|/]'), lambda x: trim(x)), lambda x: x <> ''))"


@query("unique_skills", f"SELECT resume_id, len({_SKILLS}) AS n, least(20, len({_SKILLS})) AS n_capped FROM fx_lines", "fx_lines")
def unique_skills(v):
    n = F.size(_skills())
    return v.lines.select("resume_id", n.alias("n"), F.least(n, F.lit(20)).alias("n_capped"))


def _skills():
    return r.skill_items(F.coalesce(F.try_element_at("lines", F.lit(2)), F.lit("")))


@query("sentence_repeats", "SELECT resume_id, all_sentences, dup_sentences FROM fx_features", "fx_features")
def sentence_repeats(v):
    return f.resume_features(v.lines, VERBS["strong"], VERBS["weak"]).select("resume_id", "all_sentences", "dup_sentences")


@query("resume_vocabulary", rf"""SELECT resume_id, len(w) AS n, md5(array_to_string(w, ' | ')) AS digest FROM (SELECT resume_id, list_sort(list_distinct(list_concat(list_filter(list_append(list_transform({_SKILLS}, lambda x: trim(regexp_replace(regexp_replace(x, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))), trim(regexp_replace(lower(title), '[^\w\s]', ' ', 'g'))), lambda x: x <> ''),
list_filter({_TOKS.format("array_to_string(lines[2:], ' ')")}, lambda x: length(x) >= 4)))) AS w FROM fx_lines JOIN (SELECT resume_id, title FROM fx_resumes) USING (resume_id))""", "fx_lines fx_resumes")
def resume_vocabulary(v):
    rows = v.lines.join(v.resumes.select(F.col("resume_id").alias("__r"), "title"), F.col("resume_id") == F.col("__r"))
    words = r.vocabulary(_skills(), F.col("title"), F.slice("lines", 2, 2**31 - 2))
    return rows.select("resume_id", words.alias("w")).select("resume_id", F.size("w").alias("n"), F.md5(F.array_join("w", " | ").cast("binary")).alias("digest"))


_ALIASED = "CASE keyword " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in ALIASES.items()) + " ELSE keyword END"


@query("classic_keywords", f"""SELECT jd_id, keyword, points, place FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY points DESC, ord) AS place FROM (SELECT *, CASE WHEN list_contains({_sql_list(WHITELIST)}, keyword) THEN 100 ELSE 0 END + least(30, 10 * frequency) + len(string_split(keyword, ' ')) AS points FROM (
SELECT jd_id, {_ALIASED} AS keyword, sum(frequency)::BIGINT AS frequency, min(ord * 2 + CASE WHEN contains(keyword, ' ') THEN 1 ELSE 0 END) AS ord FROM ({_PHRASES}) GROUP BY 1, 2))) WHERE place <= 10""", "fx_jd_tokens")
def classic_keywords(v):
    """Words and pairs by their usual names; known ones first, then by frequency and number of words."""
    found = x.frequent_phrases(v.jds, "jd_id", "jd_text", STOP)
    names = F.create_map(*[F.lit(y) for pair in ALIASES.items() for y in pair])
    place = F.col("ord") * 2 + F.col("keyword").contains(" ").cast("int")
    named = found.withColumn("place_in", place).withColumn("keyword", F.coalesce(F.try_element_at(names, F.col("keyword")), F.col("keyword"))).groupBy("jd_id", "keyword").agg(F.sum("frequency").alias("frequency"), F.min("place_in").alias("ord"))
    points = F.when(F.col("keyword").isin(WHITELIST), 100).otherwise(0) + F.least(F.lit(30), F.col("frequency") * 10) + F.size(F.split("keyword", " "))
    return top_k(named.withColumn("points", points), "jd_id", [F.desc("points"), F.asc("ord")], 10, "place").select("jd_id", "keyword", "points", "place")


@query("tools_named", f"SELECT jd_id, concat_ws(',', " + ", ".join(rf"CASE WHEN regexp_matches(lower(jd_text), '\b{x_}\b') THEN '{x_}' END" for x_ in TOOLS) + ") AS tools FROM fx_jds", "fx_jds")
def tools_named(v):
    return v.jds.select("jd_id", F.array_join(r.tools_named(F.col("jd_text"), TOOLS), ",").alias("tools"))


_KNOWN = r"\b(" + "|".join(rf"({a})\s+({b})" for a, b in PHRASES) + r")\b"
_WORDS = r"list_filter(string_split_regex(lower(jd_text), '\s+'), lambda w: w <> '')"


@query("technical_phrases", f"""SELECT jd_id, len(p) AS n, array_to_string(p, '|') AS phrases FROM (SELECT jd_id, list_filter(list_transform(list_filter(list_transform(g, lambda x, i: {{'x': x, 'i': i}}), lambda s: list_position(g, s.x) = s.i), lambda s: s.x), lambda x: regexp_matches(x, '{_KNOWN}')) AS p FROM (
SELECT jd_id, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM (SELECT jd_id, {_WORDS} AS w FROM fx_jds)))""", "fx_jds")
def technical_phrases(v):
    found = r.technical_phrases(F.col("jd_text"), PHRASES)
    return v.jds.select("jd_id", found.alias("p")).select("jd_id", F.size("p").alias("n"), F.array_join("p", "|").alias("phrases"))


_GROUPS = "(VALUES " + ", ".join(f"({k}, '{form}')" for k, group in enumerate(GROUPS) for form in group) + ") g(grp, form)"


@query("variant_matches", f"""SELECT DISTINCT p.resume_id, k.keyword, t.token AS other FROM (SELECT resume_id, jd_id FROM fx_resumes WHERE jd_id IS NOT NULL) p JOIN fx_jd_keywords k USING (jd_id) JOIN {_GROUPS} ON g.form = k.keyword
JOIN (SELECT g2.grp, g2.form FROM {_GROUPS.replace('g(grp', 'g2(grp')}) h ON h.grp = g.grp AND h.form <> k.keyword JOIN (SELECT DISTINCT resume_id, token FROM fx_tokens) t ON t.resume_id = p.resume_id AND t.token = h.form""", "fx_resumes fx_jd_keywords fx_tokens")
def variant_matches(v):
    """Keywords that a résumé has under another name of the same technology: an equi-join on forms."""
    groups = v.spark.createDataFrame([(k, form) for k, group in enumerate(GROUPS) for form in group], "grp int, form string")
    names = m.with_synonyms(_keywords(v), groups, "jd_id").where("form <> keyword")
    wanted = _pairs(v).join(names.withColumnRenamed("jd_id", "__j"), F.col("jd_id") == F.col("__j")).select("resume_id", "keyword", "form")
    own = _tokens(v).select(F.col("resume_id").alias("__r"), F.col("token").alias("__t")).distinct()
    return wanted.join(own, (F.col("resume_id") == F.col("__r")) & (F.col("form") == F.col("__t"))).select("resume_id", "keyword", F.col("form").alias("other")).distinct()


_FORMS = "CASE " + " ".join(f"WHEN list_contains({_sql_list(forms)}, split_part(kw, ' ', 1)) THEN {_sql_list(forms)}" for forms in SYNONYMS.values()) + " ELSE [] END"


@query("hyphen_matches", rf"""SELECT resume_id, kw AS keyword, len(list_filter(list_append({_FORMS}, kw), lambda y: regexp_matches(low, '\b' || regexp_replace(y, '[-\s]+', '[\\s-]+', 'g') || '\b'))) > 0 AS matched FROM (SELECT resume_id, lower(text) AS low, kw FROM fx_resumes r
JOIN (SELECT jd_id, string_agg(token, ' ' ORDER BY pos) AS kw FROM fx_jd_tokens WHERE pos <= 2 GROUP BY jd_id) k ON k.jd_id = r.jd_id)""", "fx_resumes fx_jd_tokens")
def hyphen_matches(v):
    """The first two words of a requirement as a phrase, or other forms of the first, with spaces or hyphens between."""
    phrase = F.array_join(F.slice(t.tokens(t.words_only(F.col("jd_text"))), 1, 2), " ")
    rows = v.resumes.where("jd_id IS NOT NULL").select("resume_id", "jd_id", "text").join(v.jds.select(F.col("jd_id").alias("__j"), phrase.alias("keyword")), F.col("jd_id") == F.col("__j"))
    first = F.get(F.split("keyword", " "), F.lit(0))
    forms = F.array().cast("array<string>")
    for own in reversed(list(SYNONYMS.values())):
        forms = F.when(first.isin(own), F.array(*map(F.lit, own))).otherwise(forms)
    return rows.select("resume_id", "keyword", r.whole_phrase(F.col("text"), F.concat(forms, F.array("keyword"))).alias("matched"))


_TECH = "regexp_matches(keyword, 'tion|ing|th')"


@query("keyword_score_profiles", f"""SELECT r.resume_id, coalesce(half, 50) AS half_without, coalesce(half, 100) AS full_without, coalesce(CAST(floor(half * 0.4 + 0.5) AS BIGINT), 40) AS of_forty, coalesce(least(100, technical), 0) AS technical FROM fx_resumes r LEFT JOIN (
SELECT resume_id, CAST(floor(count_if(matched) * 100.0 / count(*) + 0.5) AS BIGINT) AS half, CAST(floor(sum(CASE WHEN matched THEN weight * CASE WHEN {_TECH} THEN 2 ELSE 1 END ELSE 0 END) * 100.0 / sum(weight * CASE WHEN {_TECH} THEN 2 ELSE 1 END) + 0.5) AS BIGINT) AS technical
FROM (SELECT p.resume_id, k.keyword, k.weight, t.token IS NOT NULL AS matched FROM (SELECT resume_id, jd_id FROM fx_resumes WHERE jd_id IS NOT NULL) p JOIN fx_jd_keywords k USING (jd_id) LEFT JOIN (SELECT DISTINCT resume_id, token FROM fx_tokens) t ON t.resume_id = p.resume_id AND t.token = k.keyword) GROUP BY 1) s USING (resume_id)""", "fx_resumes fx_jd_keywords fx_tokens")
def keyword_score_profiles(v):
    """Profiles that differ in what a résumé without a requirement gets, and one that counts technical keywords twice."""
    weight = F.col("weight") * F.when(F.col("keyword").rlike("tion|ing|th"), 2).otherwise(1)
    share = lambda a, b: t.rounded(a * 100 / b).cast("long")
    sums = _matches(v).groupBy(F.col("resume_id").alias("__r")).agg(share(F.count_if("matched"), F.count(F.lit(1))).alias("half"), share(F.sum(F.when(F.col("matched"), weight).otherwise(0)), F.sum(weight)).alias("technical"))
    rows = v.resumes.select("resume_id").join(sums, F.col("resume_id") == F.col("__r"), "left")
    return rows.select("resume_id", F.coalesce("half", F.lit(50)).alias("half_without"), F.coalesce("half", F.lit(100)).alias("full_without"), F.coalesce(t.rounded(F.col("half") * 0.4).cast("long"), F.lit(40)).alias("of_forty"), F.coalesce(F.least(F.lit(100), F.col("technical")), F.lit(0)).alias("technical"))


@query("intrinsic_quality", f"SELECT resume_id, CAST(floor((least(20, n) * 0.4 + CASE WHEN nb > 0 THEN strong_any_metric * 60.0 / nb ELSE 0 END) * 10 + 0.5) / 10 AS DECIMAL(10,1)) AS quality FROM (SELECT resume_id, len({_SKILLS}) AS n FROM fx_lines) JOIN fx_features USING (resume_id)", "fx_lines fx_features")
def intrinsic_quality(v):
    """Quality without a requirement: .4 of up to 20 skills and .6 of the share of strong bullets with a result."""
    skills = v.lines.select(F.col("resume_id").alias("__r"), F.least(F.size(_skills()), F.lit(20)).alias("n"))
    rows = f.resume_features(v.lines, VERBS["strong"], VERBS["weak"]).select("resume_id", "nb", "strong_any_metric").join(skills, F.col("resume_id") == F.col("__r"))
    quality = F.col("n") * 0.4 + F.when(F.col("nb") > 0, F.col("strong_any_metric") * 60 / F.col("nb")).otherwise(0)
    return rows.select("resume_id", (F.floor(quality * 10 + 0.5) / 10).cast("decimal(10,1)").alias("quality"))


@query("comprehensive_scores", f"""SELECT resume_id, jd_id, CAST(floor(count_if(hit) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent FROM (SELECT p.resume_id, p.jd_id, len(list_filter(p.w, lambda y: contains(y, k.keyword) OR contains(k.keyword, y))) > 0 AS hit
FROM (SELECT resume_id, jd_id, list_filter(list_distinct({_TOKS.format('text')}), lambda y: length(y) > 3) AS w FROM fx_resumes WHERE jd_id IS NOT NULL) p JOIN fx_jd_keywords k USING (jd_id)) GROUP BY 1, 2""", "fx_resumes fx_jd_keywords")
def comprehensive_scores(v):
    """Share of a requirement's keywords that contain a word of the résumé or are contained in one."""
    words = F.filter(F.array_distinct(t.tokens(t.words_only(F.col("text")))), lambda y: F.length(y) > 3)
    keywords = _keywords(v).groupBy(F.col("jd_id").alias("__j")).agg(F.collect_list("keyword").alias("ks"))
    rows = v.resumes.where("jd_id IS NOT NULL").select("resume_id", "jd_id", words.alias("w")).join(m.counted_broadcast(keywords), F.col("jd_id") == F.col("__j"))
    hits = F.filter("ks", lambda k: F.exists("w", lambda y: F.contains(y, k) | F.contains(k, y)))
    return rows.select("resume_id", "jd_id", t.rounded(F.size(hits) * 100 / F.size("ks")).cast("long").alias("percent"))


_NARRATED = f"""SELECT resume_id, k, a, CAST({sql.TOTALS["plain"]} AS BIGINT) AS total, strong_first AS s, nb - strong_first AS w, nb - metric AS m FROM ({_COMPONENTS}) JOIN (SELECT resume_id, nb, strong_first, metric FROM fx_features) USING (resume_id)"""


@query("narrative_feedback", f"""SELECT resume_id, coalesce(nullif(CASE WHEN k >= 80 THEN 'Strong keyword alignment (' || k || '%).' WHEN k >= 60 THEN 'Good keyword coverage (' || k || '%).' ELSE '' END || CASE WHEN a >= 80 THEN ' Most bullets (' || s || '/' || (s + w) || ') start with strong action verbs.' ELSE '' END, ''),
'Resume is ' || CASE WHEN total >= 75 THEN 'strong' WHEN total >= 60 THEN 'adequate' ELSE 'needs improvement' END || '.') AS strength,
concat_ws(' ', CASE WHEN k < 60 THEN 'Add key terms.' END, CASE WHEN a < 75 THEN 'Strengthen ' || w || ' bullets.' END, CASE WHEN m > s * 0.4 THEN 'Add metrics to ' || m || ' bullets.' END) AS improvement,
(k < 60)::INT + (a < 75)::INT + (m > s * 0.4)::INT AS n_steps FROM ({_NARRATED})""", _VIEWS)
def narrative_feedback(v):
    from ..operators.composites import TOTALS

    bullets = f.resume_features(v.lines, VERBS["strong"], VERBS["weak"]).select(F.col("resume_id").alias("__f"), F.col("strong_first").alias("s"), (F.col("nb") - F.col("strong_first")).alias("w"), (F.col("nb") - F.col("metric")).alias("m"))
    rows = _components(v).withColumn("total", F.expr(TOTALS["plain"]).cast("long")).join(bullets, F.col("resume_id") == F.col("__f"))
    return rows.select("resume_id", *[c.alias(n) for n, c in r.narrative("k", "a", "total", "s", "w", "m").items()])


_ROLE_POINTS = {name: " + ".join(rf"CASE WHEN regexp_matches(lower(jd_text), '\b{term}\b') THEN {n} * CASE WHEN regexp_matches(substr(lower(jd_text), 1, 200), '\b{term}\b') THEN 2 ELSE 1 END ELSE 0 END" for term, n in terms) for name, terms in ROLE_TERMS.items()}


@query("jd_roles", f"""SELECT jd_id, CASE {' '.join(f"WHEN {name}_n = most AND most > 0 THEN '{name}'" for name in ROLE_TERMS)} ELSE 'Software Engineer' END AS role, coalesce(voted, 'general') AS voted FROM (SELECT *, greatest({', '.join(f'{name}_n' for name in ROLE_TERMS)}) AS most FROM (SELECT jd_id, {', '.join(f'{e} AS {name}_n' for name, e in _ROLE_POINTS.items())} FROM fx_jds))
LEFT JOIN (SELECT jd_id, role AS voted FROM (SELECT jd_id, role, row_number() OVER (PARTITION BY jd_id ORDER BY count(*) DESC, ord) AS n FROM fx_jd_tokens JOIN fx_dict_roles ON token = term GROUP BY jd_id, role, ord) WHERE n = 1) USING (jd_id)""", "fx_jds fx_jd_tokens fx_dict_roles")
def jd_roles(v):
    """A requirement's role by weighted whole words, twice in its first 200 characters, and by votes of its words."""
    roles = v.spark.createDataFrame([(k, role, term) for k, (role, terms) in enumerate(ROLES.items(), 1) for term in terms], "ord int, role string, term string")
    voted = m.vote(m.token_rows(v.jds, "jd_id", "jd_text"), "jd_id", roles, "general").select(F.col("jd_id").alias("__j"), F.col("role").alias("voted"))
    rows = v.jds.select("jd_id", r.weighted_role(F.col("jd_text"), ROLE_TERMS, "Software Engineer").alias("role"))
    return rows.join(voted, F.col("jd_id") == F.col("__j"), "left").select("jd_id", "role", F.coalesce("voted", F.lit("general")).alias("voted"))


@query("jd_roles_by_keywords", """SELECT jd_id, CASE WHEN l[1].n = 0 OR l[1].n - l[2].n < 2 THEN 'Full Stack Developer' ELSE l[1].role END AS role FROM (SELECT jd_id, list_sort([{'n': a, 'k': 0, 'role': 'alpha'}, {'n': b, 'k': -1, 'role': 'beta'}, {'n': c, 'k': -2, 'role': 'gamma'}], 'DESC') AS l FROM (
SELECT jd_id, sum(CASE WHEN keyword IN ('that', 'rest', 'than') THEN weight ELSE 0 END) AS a, sum(CASE WHEN keyword IN ('elle', 'ment', 'with') THEN weight ELSE 0 END) AS b, sum(CASE WHEN keyword IN ('sich', 'keit', 'this') THEN weight ELSE 0 END) AS c FROM fx_jd_keywords GROUP BY jd_id))""", "fx_jd_keywords")
def jd_roles_by_keywords(v):
    roles = {"alpha": ["that", "rest", "than"], "beta": ["elle", "ment", "with"], "gamma": ["sich", "keit", "this"]}
    return r.role_by_margin(_keywords(v), "jd_id", roles, "Full Stack Developer")


@query("keywords_kept", rf"""SELECT jd_id, kept, min(ord) AS ord FROM (SELECT jd_id, ord, CASE WHEN len(list_filter(w, lambda y: list_contains({_sql_list(WANTED)}, y) OR regexp_matches(y, '[+#.]'))) > 0 THEN array_to_string(w, ' ') END AS kept FROM (
SELECT jd_id, ord, list_filter(list_transform(string_split_regex(regexp_replace(lower(keyword), '[^\w\s+#.]', ' ', 'g'), '\s+'), lambda y: regexp_replace(y, '[^\w+#.]', '', 'g')), lambda y: length(y) >= 3 AND NOT regexp_matches(y, '^\d+$') AND NOT list_contains({_sql_list(STOP)}, y)) AS w FROM ({_PHRASES}))) WHERE kept IS NOT NULL GROUP BY 1, 2""", "fx_jd_tokens")
def keywords_kept(v):
    """Keywords with their words that count, kept if technical or of a responsibility, each once."""
    found = x.frequent_phrases(v.jds, "jd_id", "jd_text", STOP).select("jd_id", "ord", r.meaningful(F.col("keyword"), STOP, WANTED).alias("kept")).where("kept IS NOT NULL")
    return found.groupBy("jd_id", "kept").agg(F.min("ord").alias("ord"))


@query("empty_requirements", f"SELECT jd_id, count_if(list_contains({_sql_list(WANTED)}, keyword)) > 0 AS accepted FROM fx_jd_keywords GROUP BY jd_id", "fx_jd_keywords")
def empty_requirements(v):
    """Requirements that leave no keyword after the filter are rejected."""
    return _keywords(v).groupBy("jd_id").agg((F.count(r.meaningful(F.col("keyword"), STOP, WANTED)) > 0).alias("accepted"))


_OWN = "string_split(lower(coalesce(lines[2], '')), ',')"


@query("optimised_skills", f"""SELECT resume_id, bucket AS category, string_agg(keyword, ',' ORDER BY rnk) AS items FROM (SELECT *, {_bucket_sql('keyword')} AS bucket FROM (SELECT l.resume_id, k.keyword, k.rnk, row_number() OVER (PARTITION BY l.resume_id ORDER BY k.rnk) AS n
FROM fx_lines l JOIN fx_jd_keywords k USING (jd_id) WHERE NOT contains(lower(coalesce(lines[2], '')), k.keyword)) WHERE n <= 10) GROUP BY 1, 2 UNION ALL SELECT resume_id, 'General', array_to_string(list_transform({_OWN}, lambda y: trim(y)), ',') FROM fx_lines WHERE jd_id IS NOT NULL""", "fx_lines fx_jd_keywords")
def optimised_skills(v):
    """A résumé's skills and up to ten missing keywords of its requirement, by category."""
    keywords = _keywords(v).groupBy(F.col("jd_id").alias("__j")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "keyword"))), lambda k: k["keyword"]).alias("ks"))
    own = F.lower(F.coalesce(F.try_element_at("lines", F.lit(2)), F.lit("")))
    skills = F.array(F.struct(F.lit("General").alias("category"), F.transform(F.split(own, ","), lambda y: F.trim(y)).alias("items")))
    rows = v.lines.where("jd_id IS NOT NULL").select("resume_id", "jd_id", own.alias("own"), skills.alias("skills")).join(m.counted_broadcast(keywords), F.col("jd_id") == F.col("__j"))
    missing = F.slice(F.filter("ks", lambda k: ~F.contains("own", k)), 1, 10)
    placed = F.transform(missing, lambda k: F.struct(k.alias("keyword"), d.bucket(k, BUCKETS, "other").alias("name")))
    groups = rows.withColumn("placed", placed).select("resume_id", F.explode(r.skills_with_missing(F.col("skills"), missing, F.col("placed"))).alias("g"))
    return groups.select("resume_id", "g.category", F.array_join("g.items", ",").alias("items"))


@query("achievement_texts", "SELECT resume_id, len(lines) > 0 AS has_any, CASE WHEN len(lines) > 0 THEN length(lines[1]) END AS n_first FROM fx_lines", "fx_lines")
def achievement_texts(v):
    """Achievements as JSON texts or objects: whether one holds text, and the first that does."""
    objects = F.to_json(F.transform("lines", lambda y: F.struct(F.lit("").alias("title"), y.alias("description"))))
    raw = F.when(F.size("lines") % 2 == 0, objects).otherwise(F.to_json(F.concat(F.array(F.lit(" ")), F.col("lines"))))
    found = store.achievement_list(raw)
    return v.lines.where(F.col("resume_id").isNotNull()).select("resume_id", F.col("lines"), found.alias("a")).select("resume_id", (F.size("a") > 0).alias("has_any"), F.length(F.get("a", F.lit(0))).alias("n_first"))


@query("date_presence", r"SELECT resume_id, count_if(regexp_matches(text, '\d{4}|\d{1,2}/\d{1,2}|\w+\s+\d{4}')) AS n_dated FROM fx_bullets GROUP BY resume_id", "fx_bullets")
def date_presence(v):
    return v.bullets.groupBy("resume_id").agg(F.count_if(F.col("text").rlike("\\d{4}|\\d{1,2}/\\d{1,2}|\\w+\\s+\\d{4}")).alias("n_dated"))


_ITEMS = "list_filter(list_transform(string_split(coalesce(lines[2], ''), ','), lambda y: trim(y)), lambda y: y <> '')"


@query("experience_from_sentences", rf"""SELECT resume_id, i - 1 AS place, 'experience' AS section, s[i] AS improved_text FROM (SELECT resume_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT resume_id, list_filter({_ITEMS}, lambda y: len(string_split_regex(trim(y), '\s+')) > 4 OR length(y) > 40 OR regexp_matches(y, '[.!?]$')) AS s FROM fx_lines))""", "fx_lines")
def experience_from_sentences(v):
    """Sentences that stand among the skills, as suggestions for the experience."""
    items = F.filter(F.transform(F.split(F.coalesce(F.try_element_at("lines", F.lit(2)), F.lit("")), ","), lambda y: F.trim(y)), lambda y: (y != "") & ~flows.is_skill(y))
    rows = v.lines.select("resume_id", F.posexplode(items).alias("place", "improved_text"))
    return rows.select("resume_id", F.col("place").cast("long").alias("place"), F.lit("experience").alias("section"), "improved_text")


@query("suggestion_view", f"""SELECT resume_id, rank, CASE type WHEN 'keyword' THEN 'Add "' || improved_text || '" keyword' WHEN 'experience' THEN 'Improve ' || section || ' section' WHEN 'formatting' THEN 'Add ' || section || ' section' ELSE 'Improve ' || section END AS title,
CASE impact WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS impact, coalesce(pos, -1) AS target_index FROM ({_SUGGESTED})""", _SV)
def suggestion_view(v):
    title = F.when(F.col("type") == "keyword", F.concat(F.lit('Add "'), "improved_text", F.lit('" keyword'))).when(F.col("type") == "experience", F.concat(F.lit("Improve "), "section", F.lit(" section"))).when(F.col("type") == "formatting", F.concat(F.lit("Add "), "section", F.lit(" section"))).otherwise(F.concat(F.lit("Improve "), "section"))
    impact = F.when(F.col("impact").isin("high", "critical"), "high").when(F.col("impact").isin("medium", "important"), "medium").otherwise("low")
    return _suggested(v).select("resume_id", "rank", title.alias("title"), impact.alias("impact"), F.coalesce("pos", F.lit(-1)).alias("target_index"))


@query("user_initials", r"SELECT user_id, user_id::VARCHAR AS id_text, array_to_string(list_transform(list_filter(string_split_regex(name, '[\s#]+'), lambda y: y <> ''), lambda y: upper(substr(y, 1, 1))), '') AS initials FROM fx_users", "fx_users")
def user_initials(v):
    words = F.filter(F.split("name", "[\\s#]+"), lambda y: y != "")
    return v.users.select("user_id", F.col("user_id").cast("string").alias("id_text"), F.array_join(F.transform(words, lambda y: F.upper(F.substring(y, 1, 1))), "").alias("initials"))


_VERB_LIST = _sql_list(VERBS["strong"])


@query("verbs_used", rf"""SELECT resume_id, coalesce(string_agg(DISTINCT verb, ',' ORDER BY verb), '') AS verbs, count(DISTINCT CASE WHEN item_index < 2 THEN pos END) FILTER (verb IS NOT NULL) AS n_experience, count(DISTINCT CASE WHEN item_index >= 2 THEN pos END) FILTER (verb IS NOT NULL) AS n_projects,
CAST(floor(count(DISTINCT CASE WHEN verb IS NOT NULL THEN pos END) * 100.0 / count(DISTINCT pos) + 0.5) AS BIGINT) AS percent FROM (SELECT b.resume_id, b.pos, b.item_index, w.verb FROM fx_bullets b LEFT JOIN (SELECT resume_id, pos, unnest(list_distinct({_TOKS.format('text')})) AS verb FROM fx_bullets) w ON w.resume_id = b.resume_id AND w.pos = b.pos AND list_contains({_VERB_LIST}, w.verb)) GROUP BY resume_id""", "fx_bullets")
def verbs_used(v):
    """Distinct strong verbs of a résumé in order, bullets with one by section (the first two entries are experience), and their share."""
    own = F.array_intersect(t.tokens(t.words_only(F.col("text"))), F.array(*map(F.lit, VERBS["strong"])))
    rows = v.bullets.select("resume_id", "item_index", own.alias("own")).withColumn("has", F.size("own") > 0)
    out = rows.groupBy("resume_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))), ",").alias("verbs"), F.count_if(F.col("has") & (F.col("item_index") < 2)).alias("n_experience"), F.count_if(F.col("has") & (F.col("item_index") >= 2)).alias("n_projects"), t.rounded(F.count_if("has") * 100 / F.count(F.lit(1))).cast("long").alias("percent"))
    return out
