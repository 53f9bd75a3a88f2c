"""Queries of suggestion lists by profile, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composites, features as f, matching as m, suggestion_lists as s, wording as w
from ..sources.fixtures import VERBS
from . import component_sql as sql
from ._register import query
from .profiles import _COMPONENTS, PARTS
from .scores import _keywords
from .suggestions import METRIC, OPENINGS, OTHER, TAILS, _opening_sql, _tail_sql
from .wording import CONTEXTS, EXPANSIONS, HINTS, PATTERNS, STRONG, WEAK_WORDS, _expanded_sql, _first_rule, _pattern_sql, _placed, _quoted

_VIEWS = "fx_lines fx_bullets fx_resumes fx_tokens fx_jd_keywords fx_features"
TEMPLATES = {"english": ["Led work on {} for the team.", "Built {} and the rest.", "Ran {}."], "general": ["Used {}.", "Made {} run."]}


def _rows(v, *fields: str):
    """The state of each résumé that the lists start from, one row each, made where the résumé is read; a list makes only what it asks for, and ``fields`` are what it asks of a bullet."""
    rows = m.with_missing(v.lined.where(F.col("resume_id").isNotNull()), _keywords(v))
    b = s.judged(F.slice("lines", 2, 2**31 - 2), OPENINGS, STRONG, METRIC, TAILS, OTHER, PATTERNS, HINTS, EXPANSIONS, fields=fields)
    rows = f.resume_features(rows, VERBS["strong"], VERBS["weak"], ("lines", "n_keywords", "missing"))
    percent = F.floor((F.col("n_keywords") - F.size("missing")) * 100 / F.col("n_keywords") + 0.5)
    scores = {k: F.expr(f.PROFILES[family][profile]).cast("long") for k, (family, profile) in PARTS.items()}
    rows = rows.withColumns({"summary": F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")), "b": b, "k": F.when(F.col("n_keywords") > 0, percent).otherwise(0), **scores})
    return rows.withColumn("total", F.expr(composites.TOTALS["plain"])).select("resume_id", "summary", "b", "missing", "k", "a", "c", "f", "r", "total", "n_skills", "n_projects", "n_education", "n_certifications")


def _has(column: str, words) -> str:
    return "(" + " + ".join(f"contains(lower({column}), {_quoted(x)})::INT" for x in words) + ")"


_JUDGED = rf"""SELECT resume_id, list({{'pos': pos::INT, 'text': text, 'n': length(text), 'words': len(string_split_regex(trim(text), '\s+')), 'strong': list_contains([{', '.join(map(_quoted, STRONG))}], regexp_replace(lower(string_split_regex(trim(text), '\s+')[1]), '[^a-z]', '', 'g')),
  'metric': regexp_matches(text, '{METRIC}'), 'verb': {_opening_sql('text', OPENINGS)}, 'tail': {_tail_sql('text')}, 'hinted': text || {_first_rule('lower(text)', HINTS, w.RESULT_HINT_ELSE)}, 'rewritten': new, 'expanded': {_expanded_sql('new')},
  'sure': CASE WHEN len(string_split_regex({_expanded_sql('new')}, '\s+')) > 20 THEN 'low' WHEN new <> trim(text) THEN 'high' ELSE 'medium' END,
  'open': {_has('text', s.IMPROVED)} = 0 AND {_has('text', s.EFFECTS)} <= 1, 'plain': {_has('text', s.EFFECTS)} = 0, 'sentences': len(regexp_extract_all(text, '[^.!?]+[.!?]+')) > 1}} ORDER BY pos) AS b FROM (SELECT *, coalesce({_pattern_sql('trim(text)')}, trim(text)) AS new FROM fx_bullets) GROUP BY resume_id"""
_MISSING = """SELECT r.resume_id, list({'rnk': k.rnk, 'keyword': k.keyword, 'weight': k.weight} ORDER BY k.rnk) AS missing FROM fx_resumes r JOIN fx_jd_keywords k USING (jd_id) ANTI JOIN (SELECT DISTINCT resume_id, token FROM fx_tokens) t ON t.resume_id = r.resume_id AND t.token = k.keyword GROUP BY 1"""
_STATE = f"""SELECT l.resume_id, coalesce(lines[1], '') AS summary, coalesce(b, []) AS b, coalesce(missing, []) AS missing, k, a, c, f, r, {sql.TOTALS["plain"]} AS total, n_skills, n_projects, n_education, n_certifications
FROM fx_lines l JOIN ({_COMPONENTS}) USING (resume_id) LEFT JOIN ({_JUDGED}) USING (resume_id) LEFT JOIN ({_MISSING}) USING (resume_id)"""
_WEAK, _BARE = "(x.verb IS NOT NULL AND x.verb <> x.text)", "(NOT x.metric AND x.tail <> x.text)"
_GATE = {"verb": "(x.open AND x.verb IS NOT NULL AND x.n >= 5)", "metrics": "(x.open AND NOT x.metric AND x.plain AND x.n > 20)", "bullet": "(x.open AND x.verb IS NOT NULL AND NOT x.metric AND x.n >= 8)"}
_FREE = "NOT coalesce(list_contains(list_transform(l, lambda y: y.pos), x.pos), false)"


def _e(kind: str, section: str, current: str, improved: str, impact: str, pos: str = "NULL") -> str:
    """An entry; current, improved and impact are SQL."""
    return f"{{'type': '{kind}', 'section': '{section}', 'pos': {pos}::INT, 'current': ({current})::VARCHAR, 'improved': ({improved})::VARCHAR, 'impact': {impact}}}"


def _if(test: str, *entries: str) -> str:
    return f"CASE WHEN {test} THEN [{', '.join(entries)}] ELSE [] END"


def _words(n: int, made: str | None = None, of: str = "missing") -> str:
    return f"list_transform({of}[1:{n}], lambda x: {made or _e('keyword', 'skills', _quoted('Skills section'), 'x.keyword', _quoted('high'))})"


def _of(test: str, made: str, most: str | None = None) -> str:
    return f"list_transform(list_filter(b, lambda x: {test}){'' if most is None else f'[1:{most}]'}, lambda x: {made})"


def _in_jobs(test: str, made: str) -> str:
    """The first that passes in each job of three."""
    return f"list_transform(list_filter(list_filter(b, lambda x: {test}), lambda x, i: i = 1 OR (x.pos - 1) // 3 <> (list_filter(b, lambda x: {test})[i - 1].pos - 1) // 3), lambda x: {made})"


def _room(part: str, n: int) -> str:
    return f"({part})[1:greatest(0, {n} - len(l))]"


def _chain(steps: list[str], state: str = _STATE) -> str:
    out = f"SELECT *, []::STRUCT(\"type\" VARCHAR, section VARCHAR, pos INT, current VARCHAR, improved VARCHAR, impact VARCHAR)[] AS l FROM ({state})"
    for step in steps:
        out = f"SELECT * REPLACE (list_concat(l, {step}) AS l) FROM ({out})"
    return out


def _listed(chain: str, final: str = "l") -> str:
    return f"SELECT resume_id, i AS rank, y[i].type AS type, y[i].section AS section, y[i].pos AS pos, md5(y[i].current) AS current, md5(y[i].improved) AS improved, y[i].impact AS impact FROM (SELECT resume_id, y, unnest(range(1, len(y) + 1)) AS i FROM (SELECT resume_id, {final} AS y FROM ({chain})))"


def _out(rows):
    """Entries with digests of their texts."""
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return s.exploded(rows).select("resume_id", "rank", "type", "section", "pos", digest("current"), digest("improved"), "impact")


_Q = _quoted
_KW = _words(5)
_VERB = _e("weak_verb", "experience", "x.text", "x.verb", _Q("medium"), "x.pos")
_TAIL = _e("metrics", "experience", "x.text", "x.tail", _Q("high"), "x.pos")
_PROJECTS = _e("projects", "projects", _Q("(No projects)"), _Q("Add a project."), _Q("medium"))
_NOT_SOFT = "list_filter(missing[1:3], lambda x: NOT list_contains(['communication', 'teamwork', 'leadership', 'soft skill'], lower(x.keyword)))"


@query("suggestions_rule_engine", _listed(_chain([
    _KW,
    f"({_of(f'(x.pos - 1) % 3 < 2 AND {_GATE['verb']} AND {_WEAK}', _e('weak_verb', 'experience', 'x.text', 'x.verb', _Q('high'), 'x.pos'))})[1:greatest(1, 5 - len(l))]",
    _if("length(summary) < 100", _e("weak_summary", "summary", "summary", _Q("Write what you deliver."), _Q("high"))),
])), _VIEWS)
def suggestions_rule_engine(v):
    return _out(s.rule_engine(_rows(v)))


@query("suggestions_by_severity", _listed(_chain([
    _words(5, of=f"list_filter(missing, lambda x: length(x.keyword) >= 3 AND NOT list_contains([{', '.join(map(_Q, s.FILLERS))}], x.keyword))"),
    _if("length(summary) < 100", _e("content", "summary", "summary", _Q("Write three or four sentences."), _Q("medium"))),
    _if("n_skills < 6", _e("content", "skills", "n_skills || ' skills'", _Q("Add skills."), _Q("medium"))),
    _of(f"NOT regexp_matches(x.text, '(?i)^add\\s+|corrupted|error|bug|test|temp') AND CASE WHEN x.strong THEN NOT x.metric ELSE {_WEAK} END", _e("bullet", "experience", "x.text", "CASE WHEN x.strong THEN x.hinted ELSE x.verb END", _Q("medium"), "x.pos")),
    *[_if(test, _e("structure", name, _Q(""), _Q(f"Add {name}."), _Q("high"))) for name, test in (("summary", "length(summary) < 50"), ("skills", "n_skills = 0"), ("experience", "len(b) = 0"), ("projects", "n_projects = 0"), ("education", "n_education = 0"))],
]), """list_transform(list_sort(list_transform(l, lambda x, i: {'a': CASE WHEN x.type = 'keyword' OR (x.type = 'bullet' AND NOT contains(x.improved, '(e.g.,')) THEN 0 ELSE 1 END, 's': CASE WHEN x.impact = 'high' THEN 0 ELSE 1 END, 'i': i, 'x': x})), lambda y: y.x)[1:12]"""), _VIEWS)
def suggestions_by_severity(v):
    return _out(s.by_severity(_rows(v)))


#: The given documents have no experience to lack: résumés of the fresher's template have their bullets under projects.
_FRESHER = "resume_id % 4 = 1"
_SAID = "CASE WHEN summary = '' THEN '(No summary)' ELSE summary END"
_BETTER_TAIL = _tail_sql("(CASE WHEN x.strong THEN x.text ELSE coalesce(x.verb, x.text) END)")


@query("suggestions_by_path", _listed(_chain([
    f"CASE WHEN k < 70 THEN {_words(2)} ELSE [] END",
    f"CASE WHEN fresher AND n_projects > 0 THEN {_of('NOT x.metric AND x.n >= 10 AND (x.strong OR x.verb IS NOT NULL OR regexp_matches(lower(x.text), $$^(con|per)$$))', _e('projects', 'projects', 'x.text', _BETTER_TAIL, _Q('high'), 'x.pos'), '1')} ELSE [] END",
    f"CASE WHEN NOT fresher AND a < 80 THEN {_of(f'{_WEAK} AND NOT x.strong', _e('action_verb', 'experience', 'x.text', 'x.verb', _Q('medium'), 'x.pos'), '3')} ELSE [] END",
    f"CASE WHEN NOT fresher THEN {_room(_of(f'NOT x.metric AND {_FREE}', _e('experience', 'experience', 'x.text', 'x.tail', _Q('high'), 'x.pos'), '1'), 6)} ELSE [] END",
    f"CASE WHEN len(l) >= 6 THEN [] WHEN fresher AND length(summary) < 80 THEN [{_e('summary', 'summary', _SAID, _Q('Say what you study and what you want to build.'), _Q('medium'))}] WHEN NOT fresher AND length(summary) < 100 THEN [{_e('summary', 'summary', _SAID, _Q('Say in two sentences what you do best.'), _Q('medium'))}] ELSE [] END",
    f"CASE WHEN len(l) >= 6 OR f >= 70 THEN [] WHEN length(trim(summary)) < 20 THEN [{_e('formatting', 'summary', _SAID, _Q('Write a summary of 50 words.'), _Q('medium'))}] WHEN n_education = 0 THEN [{_e('formatting', 'education', _Q('(No education)'), _Q('Name your degree.'), _Q('medium'))}] ELSE [] END",
    f"CASE WHEN fresher OR len(l) >= 2 THEN [] ELSE list_concat({_if('n_projects = 0', _PROJECTS)}, {_if('n_certifications = 0', _e('certifications', 'certifications', _Q('(No certifications)'), _Q('Add a certificate.'), _Q('low')))}) END",
], f"SELECT *, {_FRESHER} AS fresher FROM ({_STATE})")), _VIEWS)
def suggestions_by_path(v):
    return _out(s.live(_rows(v).withColumn("fresher", F.expr(_FRESHER)), TAILS, OTHER, ("con", "per")))


@query("suggestions_six_rules", _listed(_chain([
    f"CASE WHEN k < 70 THEN {_words(1)} ELSE [] END",
    _room(_in_jobs(_BARE, _TAIL), 6),
    f"CASE WHEN a < 70 THEN {_room(_in_jobs(f'{_WEAK} AND {_FREE}', _VERB), 6)} ELSE [] END",
    _if("len(l) < 6 AND length(summary) < 50", _e("summary", "summary", "summary", _Q("Write a summary."), _Q("medium"))),
    _if("len(l) < 6 AND n_projects = 0", _e("projects", "projects", _Q("(missing)"), _Q("Add a project."), _Q("medium"))),
])), _VIEWS)
def suggestions_six_rules(v):
    return _out(s.six_rules(_rows(v, "pos", "text", "metric", "verb", "tail")))


_BETTER = "CASE WHEN length(summary) > 0 AND n_skills > 0 THEN summary || ' Add what you build.' WHEN length(summary) < 30 THEN 'Write a summary.' ELSE summary END"
_TWO = f"({_NOT_SOFT})[1:2]"


@query("suggestions_refined", _listed(_chain([
    _if(f"k < 60 AND len({_TWO}) > 0", _e("skills", "skills", _Q("Skills section"), f"array_to_string(list_transform({_TWO}, lambda x: x.keyword), ', ')", _Q("high"))),
    _of(_BARE, _TAIL, "1"),
    f"CASE WHEN a < 70 THEN {_of(f'{_WEAK} AND {_FREE}', _VERB, '1')} ELSE [] END",
    _if(f"length(summary) < 50 AND {_BETTER} <> summary", _e("summary", "summary", "summary", _BETTER, _Q("medium"))),
    _if("c < 80 AND n_skills > 0", _e("skill_organization", "skills", _Q("Skills section"), _Q("Group the skills."), _Q("medium"))),
    f"CASE WHEN r < 75 THEN {_room(_of(f'x.n > 180 AND x.sentences AND {_FREE}', _e('readability', 'experience', 'x.text', _Q('Make two of it.'), _Q('low'), 'x.pos'), '1'), 6)} ELSE [] END",
    f"CASE WHEN len(l) < 3 THEN list_concat({_if('n_projects = 0', _PROJECTS)}, {_if('n_certifications = 0', _e('certifications', 'certifications', _Q('(No certifications)'), _Q('Add a certificate.'), _Q('low')))}) ELSE [] END",
]), "l[1:6]"), _VIEWS)
def suggestions_refined(v):
    return _out(s.refined(_rows(v)))


@query("suggestions_one_of_each", _listed(_chain([
    f"CASE WHEN k < 70 THEN {_words(1, of=f'({_NOT_SOFT})')} ELSE [] END",
    _of(f"{_BARE} AND x.n > 20", _TAIL, "1"),
    f"CASE WHEN a < 70 THEN {_of(_WEAK, _VERB, '1')} ELSE [] END",
    _if("length(summary) < 50 AND len(l) < 6", _e("summary", "summary", "summary", "CASE WHEN length(summary) < 30 THEN 'Tell of ' || least(20, ((len(b) + 2) // 3) * 3) || ' years.' ELSE summary || ' Add what you build.' END", _Q("medium"))),
    _if("n_projects = 0 AND len(l) < 6", _PROJECTS),
    _if("len(l) < 3", _e("readability", "education", _Q("(No certifications)"), _Q("Add a certificate."), _Q("low"))),
])), _VIEWS)
def suggestions_one_of_each(v):
    return _out(s.one_of_each(_rows(v)))


@query("suggestions_staged", _listed(_chain([
    _words(3),
    _if("length(summary) < 100", _e("summary", "summary", "summary", _Q("Write what you deliver."), _Q("high"))),
    _room(_of("x.strong AND NOT x.metric AND x.words >= 8", _e("metrics", "experience", "x.text", "x.text || ' (name the result)'", _Q("high"), "x.pos")), 8),
    _room(_of(_WEAK, _VERB), 10),
    _if("n_projects = 0 AND len(l) < 10", _e("section", "projects", _Q(""), _Q("Add projects."), _Q("medium"))),
    _if("n_education = 0 AND len(l) < 10", _e("section", "education", _Q(""), _Q("Add your degree."), _Q("medium"))),
    f"CASE WHEN len(l) = 0 OR total >= 90 THEN {_room('[' + ', '.join(_e('optimization', sec, _Q(''), _Q(text), _Q(impact)) for sec, text, impact in (('experience', 'Name results.', 'high'), ('skills', 'Match the skills.', 'high'), ('experience', 'Name tools.', 'medium'))) + ']', 5)} ELSE [] END",
])), _VIEWS)
def suggestions_staged(v):
    return _out(s.staged(_rows(v)))


_ADVICE = [
    "[" + _e("impact", "experience", _Q(""), _Q("Name results."), _Q("high")) + "]",
    _if("length(summary) < 100", _e("section", "summary", "summary", _Q("Write three or four sentences."), _Q("high"))),
    _if("length(summary) >= 100 AND c >= 80", _e("section", "summary", "summary", _Q("Name achievements in it."), _Q("medium"))),
    _if("len(missing) > 0", _e("keyword", "skills", _Q(""), "'Add ' || array_to_string(list_transform(missing[1:3], lambda x: x.keyword), ', ')", _Q("high"))),
    _if("len(list_filter(b, lambda x: x.verb IS NOT NULL)) > 0", _e("bullet", "experience", _Q(""), _Q("Use strong verbs."), _Q("medium"))),
    _if("c < 90", _e("content", "experience", _Q(""), _Q("Name tools."), _Q("medium"))),
]


@query("suggestions_advisory", _listed(_chain(_ADVICE)), _VIEWS)
def suggestions_advisory(v):
    return _out(s.advisory(_rows(v)))


_KEY = "concat_ws(chr(1), x.type, x.section, x.current, CASE WHEN x.type = 'keyword' THEN x.improved END)"
_OPTIMISED = _chain([
    f"list_transform(list_sort(list_transform(missing, lambda x: {{'w': -x.weight, 'r': x.rnk, 'keyword': x.keyword}}))[1:5], lambda x: {_e('keyword', 'skills', _Q(''), 'x.keyword', 'CASE WHEN x.w <= -3 THEN ' + _Q('high') + ' ELSE ' + _Q('medium') + ' END')})",
    _of(f"{_GATE['bullet']} AND x.rewritten <> trim(x.text) AND len(string_split_regex(x.rewritten, '\\s+')) >= 5", _e("bullet", "experience", "trim(x.text)", "x.expanded", "CASE WHEN x.sure = 'high' THEN 'high' ELSE 'medium' END", "x.pos")),
    _room(_of("x.words < 8 AND length(x.expanded) > greatest(x.n, 50)", _e("bullet", "experience", "trim(x.text)", "x.expanded", _Q("medium"), "x.pos")), 15),
    f"CASE WHEN a > 60 AND len(l) < 15 THEN {_of(_GATE['metrics'] + ' AND x.words >= 8', _e('impact', 'experience', 'x.text', 'x.hinted', _Q('high'), 'x.pos'))} ELSE [] END",
    _if("length(summary) < 50 AND len(l) < 15", _e("section", "summary", _Q(""), _Q("Write three or four sentences."), _Q("high"))),
    _if("c < 60 AND n_projects = 0 AND len(l) < 15", _e("section", "projects", _Q(""), _Q("Add projects."), _Q("high"))),
])
_ONCE = f"SELECT * EXCLUDE (l), list_filter(l, lambda x, i: list_position(list_transform(l, lambda x: {_KEY}), {_KEY}) = i)[1:20] AS once FROM ({_OPTIMISED})"


@query("suggestions_optimise", _listed(_chain(_ADVICE, _ONCE), "list_concat(once, l[1:greatest(0, 2 - len(once))])"), _VIEWS)
def suggestions_optimise(v):
    return _out(s.optimise(_rows(v)))


_FIRST_WEAK = "CASE" + "".join(rf" WHEN regexp_matches(x.text, '(?i)\b{a}\b') THEN regexp_replace(x.text, '(?i)\b{a}\b', '{b}')" for a, b in WEAK_WORDS.items()) + " ELSE x.text END"


@query("suggestions_guarded", _listed(_chain([
    _KW,
    _of(f"{_GATE['verb']} AND {_FIRST_WEAK} <> x.text", _e("verb", "experience", "x.text", _FIRST_WEAK, _Q("high"), "x.pos")),
    _room(_of(f"{_GATE['bullet']} AND x.words < 8 AND {_FREE}", _e("clarity", "experience", "x.text", "x.text || ' with significant impact.'", _Q("medium"), "x.pos")), 15),
    f"CASE WHEN len(l) < 15 THEN {_of(f'{_GATE['metrics']} AND x.words >= 8 AND {_FREE}', _TAIL)} ELSE [] END",
    _if("length(summary) < 50", _e("section", "summary", _Q(""), _Q("Write a summary."), _Q("high"))),
    *[_if(f"n_{name} = 0", _e("section", name, _Q(""), _Q(f"Add {name}."), _Q("high"))) for name in ("skills", "projects", "education")],
]), "l[1:15]"), _VIEWS)
def suggestions_guarded(v):
    return _out(s.guarded(_rows(v, "pos", "text", "n", "words", "metric", "verb", "tail", "open", "plain"), WEAK_WORDS))


_TRIED = _placed(f"SELECT resume_id, i, pos, trim(text) AS bare, trim(string_split_regex(trim(text), '[.•]')[1]) AS main, missing[i].keyword AS kw FROM (SELECT resume_id, missing, unnest(range(1, least(8, len(missing)) + 1)) AS i FROM ({_MISSING})) JOIN fx_bullets USING (resume_id)", "resume_id, i, pos")
_BEST = f"SELECT resume_id, list(y) AS placed FROM (SELECT resume_id, {{'i': i, 'pos': min(pos)::INT, 'text': arg_min(bare, pos), 't': arg_min(t, pos)}} AS y FROM (SELECT resume_id, i, pos, bare, trim(x.t) AS t FROM ({_TRIED}) WHERE NOT there AND x.t IS NOT NULL AND x.t <> main AND x.c <> 'low') GROUP BY resume_id, i) GROUP BY resume_id"


@query("suggestions_by_evaluation", _listed(_chain([
    _of(_WEAK, _e("verb", "experience", "x.text", "x.verb", _Q("high"), "x.pos")),
    _of("NOT x.metric", _e("metrics", "experience", "x.text", "NULL", _Q("high"), "x.pos")),
    "list_transform(missing[1:8], lambda q, i: CASE WHEN len(list_filter(placed, lambda y: y.i = i)) > 0 THEN "
    + _e("keyword-integration", "experience", "b[list_filter(placed, lambda y: y.i = i)[1].pos].text", "list_filter(placed, lambda y: y.i = i)[1].t", "CASE WHEN i <= 3 THEN 'high' ELSE 'medium' END", "list_filter(placed, lambda y: y.i = i)[1].pos")
    + " ELSE " + _e("keyword", "skills", "NULL", "q.keyword", "CASE WHEN i <= 3 THEN 'high' ELSE 'medium' END") + " END)",
    *[_if(test, _e("section", name, "NULL", "NULL", _Q("medium"))) for name, test in (("summary", "length(summary) < 50"), ("projects", "n_projects = 0"))],
], f"SELECT st.*, coalesce(placed, []) AS placed FROM ({_STATE}) st LEFT JOIN ({_BEST}) USING (resume_id)")), _VIEWS)
def suggestions_by_evaluation(v):
    return _out(s.by_evaluation(_rows(v, "pos", "text", "metric", "verb"), STRONG, CONTEXTS))


def _sentence(name: str) -> str:
    lines = TEMPLATES[name]
    return f"replace([{', '.join(map(_Q, lines))}][length(x.keyword) % {len(lines)} + 1], '{{}}', x.keyword)"


@query("suggestions_from_templates", _listed(_chain([_words(3, _e("keyword", "experience", _Q(""), f"CASE WHEN contains(lower(summary), 'the') THEN {_sentence('english')} ELSE {_sentence('general')} END", _Q("high")))])), _VIEWS)
def suggestions_from_templates(v):
    rows = _rows(v)
    domain = F.when(F.contains(F.lower("summary"), F.lit("the")), "english").otherwise("general")
    return _out(s.from_templates(rows, TEMPLATES, domain, "general"))


@query("suggestion_gates", f"SELECT resume_id, x.pos AS pos, {_GATE['verb']} AS weak_verb, {_GATE['metrics']} AS missing_metrics, {_GATE['bullet']} AS weak_bullet FROM (SELECT resume_id, unnest(b) AS x FROM ({_JUDGED}))", "fx_bullets")
def suggestion_gates(v):
    b = s.judged(F.slice("lines", 2, 2**31 - 2), OPENINGS, STRONG, METRIC, TAILS, OTHER, PATTERNS, HINTS, EXPANSIONS)
    rows = v.lines.select("resume_id", F.explode(b).alias("x"))
    return rows.select("resume_id", "x.pos", *[g.alias(n) for n, g in s.gates(F.col("x")).items()])
