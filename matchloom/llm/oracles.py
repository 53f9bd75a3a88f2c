"""SQL that gives the same rows as those queries of this subpackage that SQL can express."""

from __future__ import annotations

from .licences import COPYRIGHT_LINE, KNOWN, SPELLINGS, full_texts
from .mixing import LEAST_SHARDS, MAX_BLOCKS, MAX_SHARDS, ROWS_PER_BLOCK, ROWS_PER_SHARD

OP1 = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s, length(coalesce(text, '')) AS n FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM g
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_lines(column: str) -> str:
    low = f"lower(coalesce({column}, ''))"
    about = " OR ".join(f"contains({low}, {_quoted(x)})" for x in ("copyright", "(c)", "©", "all rights reserved"))
    form = f"CASE WHEN {about} THEN regexp_replace({low}, {_quoted(COPYRIGHT_LINE)}, '', 'g') ELSE {low} END"
    form = f"' ' || replace(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    form = f"replace({form}, ' ', '  ')"
    for variant, canonical in SPELLINGS:
        form = f"replace({form}, ' {variant.replace(' ', '  ')} ', ' {canonical.replace(' ', '  ')} ')"
    return form


_VALUES = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in [*KNOWN, *full_texts()])
OP5 = rf"""
WITH known AS (
  SELECT digest, min(licence) AS licence
  FROM (SELECT licence, sha256(trim(regexp_replace({_canonical_lines("licence_text")}, '[ \n]+', ' ', 'g'))) AS digest FROM (VALUES {_VALUES}) v(licence, licence_text))
  GROUP BY digest
), forms AS (
  SELECT doc_id, {_canonical_lines("text")} AS form FROM documents
), lines AS (
  SELECT doc_id, sha256(trim(regexp_replace(line, ' +', ' ', 'g'))) AS digest
  FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS line FROM forms) WHERE trim(line) <> ''
), notices AS (
  SELECT doc_id, count(*) AS notice_lines, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM lines JOIN known USING (digest) GROUP BY doc_id
), whole AS (
  SELECT doc_id, sha256(trim(regexp_replace(form, '[ \n]+', ' ', 'g'))) AS text_digest FROM forms
)
SELECT doc_id, text_digest, licence, coalesce(notice_lines, 0) AS notice_lines, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON digest = text_digest LEFT JOIN notices USING (doc_id)
"""

_LEVELS = (MAX_SHARDS - 1).bit_length()
_TREE = ", ".join(
    rf"""t{k + 1} AS (
  SELECT source, e, r, CASE WHEN high - low > 1 AND ball > half THEN middle ELSE low END AS low, CASE WHEN high - low > 1 AND ball <= half THEN middle ELSE high END AS high
  FROM (SELECT *, (low + high) // 2 AS middle, count(*) OVER (PARTITION BY e, low, high) * ((low + high) // 2 - low) // (high - low) AS half,
               row_number() OVER (PARTITION BY e, low, high ORDER BY ('0x' || substr(md5('0:t:' || e || ':' || low || ':' || high || ':' || coalesce(source, '\N') || ':' || r), 1, 13))::BIGINT) AS ball FROM t{k}))"""
    for k in range(_LEVELS)
)
OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, count(*) AS n_rows FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM w WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target, greatest(1, least({MAX_BLOCKS}, ceil(n_rows / {ROWS_PER_BLOCK}.0)))::BIGINT AS n_blocks FROM l
), p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size)) END::BIGINT AS passes FROM t
), r AS (
  SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS quota,
         ('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT % n_blocks AS block
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), b AS (
  SELECT source, block, sum(size) AS words, ('0x' || substr(md5('0:b:' || coalesce(source, '\N') || ':' || block), 1, 13))::BIGINT AS h FROM r GROUP BY source, block
), o AS (
  SELECT source, block, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b
), e AS (
  SELECT r.*, o.before, before + words <= quota AND quota > 0 AS whole, NOT (before + words <= quota AND quota > 0) AND before < quota AS cut
  FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source AND r.block = o.block
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source, cut ORDER BY md5('0:r:' || doc_id) || ':' || doc_id ROWS UNBOUNDED PRECEDING) AS run FROM e
), taking AS (
  SELECT *, whole OR (cut AND before + run - size / 2.0 <= quota) AS more FROM c
), drawn AS (
  SELECT source, block, unnest(range(0, max(passes) + max(more::INT))) AS e FROM taking GROUP BY source, block
), draws AS (
  SELECT source, block, e, row_number() OVER (PARTITION BY source, e ORDER BY ('0x' || substr(md5('0:p:' || e || ':' || coalesce(source, '\N') || ':' || block), 1, 13))::BIGINT, block) - 1 AS r FROM drawn
), t0 AS (
  SELECT source, e, r, 0 AS low, (SELECT greatest({LEAST_SHARDS}, least({MAX_SHARDS}, ceil(count(*) / {ROWS_PER_SHARD}.0)))::BIGINT FROM documents) AS high FROM draws
), {_TREE}, places AS (
  SELECT source, e, low AS shard, row_number() OVER (PARTITION BY source, e ORDER BY low, r) - 1 AS place FROM t{_LEVELS}
), of_block AS (
  SELECT draws.source, block, list(shard ORDER BY draws.e) AS shards FROM draws JOIN places ON draws.source IS NOT DISTINCT FROM places.source AND draws.e = places.e AND r = place GROUP BY draws.source, block
), out AS (
  SELECT taking.*, coalesce(shards, [])[1:least(3, passes + more::INT)] AS own FROM taking LEFT JOIN of_block ON taking.source IS NOT DISTINCT FROM of_block.source AND taking.block = of_block.block
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * len(own))::BIGINT AS taken, source, block, array_to_string(own, ',') AS shards FROM out
"""

#: crc32 of ASCII text: a byte, then eight shifts.
_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split({0}, '')])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
#: Words that are equal and a possible period apart are met; neighbouring pairs of one period are a run.
OP11 = rf"""
WITH h AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_CRC32.format("doc_id::VARCHAR")} AS h FROM documents
), g AS (
  SELECT *, len(ws) AS n, h // 10 AS g FROM h
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g
), p AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a
), w AS MATERIALIZED (
  SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS period FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, min(i) AS start, count(*) + period AS length, period FROM islands GROUP BY doc_id, period, island HAVING count(*) + period >= greatest(6, 4 * period)
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(period) AS period FROM stretches GROUP BY doc_id, start, length
), told AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id
), ranked AS (
  SELECT r.*, NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period OR (o.length * r.period = r.length * o.period AND (o.start, o.period) < (r.start, r.period)))) AS best FROM runs r
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT h.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM h LEFT JOIN told USING (doc_id) LEFT JOIN (SELECT * FROM ranked WHERE best) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Every stretch of 1 to 4 words of every piece is counted; longer candidates are met by their own parts.
OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), ws AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws
), f AS MATERIALIZED (
  SELECT lang, phrase, count(*) AS f FROM (SELECT lang, w[i:i + k - 1] AS phrase FROM places, range(1, 5) t(k) WHERE i + k - 1 <= len(w)) GROUP BY lang, phrase HAVING count(*) >= 30
), c AS (
  SELECT lang, phrase, f AS a FROM f WHERE len(phrase) > 1
), cuts AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (2000000 * a::HUGEINT // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(phrase))) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = c.phrase[1:k] JOIN f y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1:]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase[i:j] AS phrase, max(a) AS most FROM c, range(1, 4) s(i), range(2, 5) e(j) WHERE i < j AND j <= len(phrase) AND j - i + 1 < len(phrase) GROUP BY lang, phrase[i:j]
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside m ON m.lang = b.lang AND m.phrase = b.phrase WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

ORACLES = {"op1_exact_dedup": OP1, "op5_licence_scan": OP5, "op6_mixing": OP6, "op11_periodic_runs": OP11, "op12_phrase_collocations": OP12}
