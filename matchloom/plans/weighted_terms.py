"""Query of keywords by the weighted dictionary: the fixed terms, and words of the given texts behind them."""

from __future__ import annotations

from ..functions import dictionaries as d
from ..operators.weighted_terms import weighted_terms
from ._register import query

#: The given texts are invented prose: some of its words and pairs, with weights like those of the fixed terms.
OWN = [("of an", 4, "own"), ("of the", 4, "own"), ("of", 3, "own"), ("an", 3, "own"), ("the", 2, "own"), ("that", 2, "own"), ("and", 1, "own"), ("in", 1, "own")]
OWN_VERBS, OWN_STOP, OWN_REQUIRED, OWN_PREFERRED = ["is", "en", "the"], ["and"], ("erst",), ("ingen", "tion")

_LISTED = ", ".join(f"({k}, '{t}', {w}, '{r}')" for k, (t, w, r) in enumerate([*((t, w, r.split(",")[0]) for r, entries in d.WEIGHTED_TERMS.items() for t, _, w in (e.strip().rpartition(" ") for e in entries.split(","))), *OWN]))
_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
_WORD = r"'\b' || regexp_replace({0}, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g') || '\b'"
_BEHIND = "coalesce((SELECT substr(low, instr(low, cue), 800) FROM (SELECT unnest([{0}]) AS cue, unnest(range({1})) AS i) WHERE contains(low, cue) ORDER BY i LIMIT 1), '')"


@query("jd_weighted_terms", rf"""
WITH dict AS (SELECT term, weight, role, row_number() OVER (ORDER BY length(term) DESC, listed) AS ord FROM (VALUES {_LISTED}) v(listed, term, weight, role)),
texts AS (SELECT jd_id, low, trim(regexp_replace(regexp_replace(low, '[^\w\s/.+#-]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM (SELECT jd_id, lower(jd_text) AS low FROM fx_jds)),
parts AS (SELECT jd_id, term, min(i) AS i FROM (SELECT jd_id, trim(unnest(p)) AS term, unnest(range(len(p))) AS i FROM (SELECT jd_id, string_split_regex(norm, '/+') AS p FROM texts)) WHERE length(term) BETWEEN 2 AND 29 GROUP BY ALL),
slashed AS (SELECT jd_id, term, i, n FROM (SELECT p.jd_id, p.term, i, count(*) * any_value(len(regexp_extract_all(norm, {_WORD.format("p.term")}))) AS n FROM parts p JOIN texts USING (jd_id) JOIN dict ON contains(p.term, dict.term) OR contains(dict.term, p.term) GROUP BY ALL) WHERE n > 0),
matched AS (SELECT * FROM (SELECT jd_id, dict.*, len(regexp_extract_all(norm, {_WORD.format("term")})) AS n FROM texts CROSS JOIN dict) WHERE n > 0),
hiding AS (SELECT jd_id, term FROM slashed UNION ALL SELECT jd_id, term FROM matched),
kept AS (SELECT * FROM matched m WHERE NOT EXISTS (SELECT 1 FROM hiding h WHERE h.jd_id = m.jd_id AND contains(h.term, m.term) AND length(h.term) > length(m.term))),
found AS (SELECT coalesce(s.jd_id, k.jd_id) AS jd_id, coalesce(s.term, k.term) AS keyword, coalesce(s.n, 0) + coalesce(k.n, 0) AS n, coalesce(i, 1000000 + k.ord) AS seq FROM slashed s FULL JOIN kept k ON s.jd_id = k.jd_id AND s.term = k.term),
windows AS (SELECT jd_id, {_BEHIND.format(_QUOTED([*d.REQUIRED_CUES, *OWN_REQUIRED]), len(d.REQUIRED_CUES) + len(OWN_REQUIRED))} AS req, {_BEHIND.format(_QUOTED([*d.PREFERRED_CUES, *OWN_PREFERRED]), len(d.PREFERRED_CUES) + len(OWN_PREFERRED))} AS pre FROM texts),
scored AS (SELECT jd_id, keyword, coalesce(weight, 1)::DOUBLE * n * (CASE WHEN weight IS NOT NULL AND contains(req, keyword) THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN weight IS NOT NULL AND contains(pre, keyword) THEN 0.8::DOUBLE ELSE 1 END) AS score, coalesce(weight, 1) AS weight, n AS frequency, coalesce(role, 'general') AS role, seq FROM found JOIN windows USING (jd_id) LEFT JOIN dict ON dict.term = keyword),
acts AS (SELECT jd_id, verb AS keyword, n * 2::DOUBLE AS score, 2 AS weight, n AS frequency, 'responsibility' AS role, 2000000 + i AS seq FROM (SELECT jd_id, verb, i, len(regexp_extract_all(norm, '\b' || verb || '\b')) AS n FROM texts CROSS JOIN (SELECT unnest([{_QUOTED([*d.RESPONSIBILITY_VERBS, *OWN_VERBS])}]) AS verb, unnest(range({len(d.RESPONSIBILITY_VERBS) + len(OWN_VERBS)})) AS i)) a WHERE n > 0 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.jd_id = a.jd_id AND f.keyword = verb))
SELECT jd_id, rank::INT AS rank, keyword, score, weight::INT AS weight, frequency::INT AS frequency, role FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY score DESC, seq) AS rank FROM (SELECT * FROM scored UNION ALL SELECT * FROM acts) WHERE length(keyword) >= 2 AND keyword NOT IN ({_QUOTED([*d.NO_KEYWORDS, *OWN_STOP])})) WHERE rank <= 25""", "fx_jds")
def jd_weighted_terms(v):
    return weighted_terms(v.jds, "jd_id", "jd_text", [*d.weighted_terms(), *OWN], [*d.RESPONSIBILITY_VERBS, *OWN_VERBS], [*d.NO_KEYWORDS, *OWN_STOP], (*d.REQUIRED_CUES, *OWN_REQUIRED), (*d.PREFERRED_CUES, *OWN_PREFERRED))
