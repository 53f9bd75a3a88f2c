"""SQL of features and component scores, written apart from the operators that it checks."""

from __future__ import annotations

_HEADINGS = {
    "summary": "summary|professional summary|career summary|profile|overview|objective|about|professional profile",
    "skills": "skills|technical skills|core skills|competencies|expertise|technologies|tools",
    "experience": "experience|work experience|professional experience|employment|work history|career history",
    "projects": "projects|personal projects|portfolio|academic projects|side projects|notable projects",
    "education": "education|academic background|degrees|qualifications|courses|certifications",
}
#: Columns of fx_features behind the first ones; ``{strong}`` and ``{metric}`` are tests on a bullet x.
MORE_FEATURES = r"""has_email, has_phone, n_skills, n_projects, n_education, n_certifications, n_achievements, n_dated,
  n_skills > 0 AS has_skills, n_projects > 0 AS has_projects, n_education > 0 AS has_education, n_certifications > 0 AS has_certifications, n_achievements > 0 AS has_achievements, n_dated > 0 AS has_dates,
  {headings}, len(list_filter(lines, lambda x: regexp_matches(x, '^[-•*]'))) AS marked_lines,
  regexp_matches(whole, '(?i)!?\[.*\]\(.*\.(jpg|jpeg|png|gif|webp)\)|http.*\.(jpg|jpeg|png|gif|webp)') AS images, contains(whole, '<img') OR contains(whole, '[image]') AS image_tags,
  regexp_matches(whole, '(?i)<img|image:|icon|fa-|material-icons|emoji') AS icon_words, regexp_matches(whole, '(?i)table|grid-template-columns|column-count|two-column') AS table_words,
  regexp_matches(lower(whole), '\btable\b') AS table_word, regexp_matches(whole, '[\x{{1F300}}-\x{{1FAFF}}]') AS emoji, regexp_matches(whole, '[★☆]') AS stars, regexp_matches(whole, '[★☆⭐💫✓✔✕✗]') AS icons,
  len(regexp_extract_all(whole, '[™®©§¶]')) AS rare_signs,
  len(list_filter(range(0, CAST(ceil(len(bullets) / 3.0) AS BIGINT)), lambda i: len(list_filter(bullets[3 * i + 1:3 * i + 3], lambda x: {strong} AND {metric})) >= 3)) AS deep_jobs,
  len(list_filter(range(0, CAST(ceil(len(bullets) / 3.0) AS BIGINT)), lambda i: len(list_filter(bullets[3 * i + 1:3 * i + 3], lambda x: {strong} AND {metric})) = 2)) AS solid_jobs,
  len(list_filter(bullets, lambda x: regexp_matches(x, '(?i)^(responsible for|worked on|worked with|used|helped|handled|involved in|participated in|made)'))) AS weak_bullets,
  len(list_filter(bullets, lambda x: regexp_matches(lower(x), '\b({verbs})\b'))) AS bounded_verbs,
  len(list_filter(bullets, lambda x: regexp_matches(x, '(?i)[0-9]|x\s*faster|increased|decreased|reduced|improved|enhanced|optimized'))) AS counted_results,
  len(list_filter(bullets, lambda x: contains(x, '   '))) AS wide_gaps, regexp_matches(whole, '\s{{3,}}') AS any_wide_gap,
  len(string_split_regex(whole, '\s+')) AS whole_words, length(regexp_replace(whole, '\s+', '', 'g')) AS whole_letters, len(regexp_extract_all(whole, '[.!?]+')) AS whole_stops, regexp_matches(whole, '[,;:—]') AS inner_signs,
  len(list_filter(string_split_regex(whole, '[.!?]+'), lambda x: trim(x) <> '')) AS all_sentences,
  len(list_filter(string_split_regex(whole, '[.!?]+'), lambda x: trim(x) <> '')) - len(list_distinct(list_transform(list_filter(string_split_regex(whole, '[.!?]+'), lambda x: trim(x) <> ''), lambda x: trim(regexp_replace(regexp_replace(lower(x), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))))) AS dup_sentences,
  length(norm) AS norm_chars""".replace("{headings}", ", ".join(rf"regexp_matches(lower(whole), '\b({p})\b') AS heading_{name}" for name, p in _HEADINGS.items()))

#: Words that stand more than three times, in letters alone.
PLAIN_WORDS = r"""SELECT resume_id, count(*) AS repeated_plain FROM (SELECT resume_id, w, count(*) AS n FROM (
  SELECT resume_id, regexp_replace(unnest(string_split_regex(lower(array_to_string(lines, ' ')), '\s+')), '[^a-z]', '', 'g') AS w FROM fx_lines) WHERE length(w) > 3 GROUP BY 1, 2) WHERE n > 3 GROUP BY 1"""


def _sections(least: int, with_optional: bool) -> str:
    names = ["has_skills", "has_projects", "has_education"] + (["has_certifications", "has_achievements"] if with_optional else [])
    return f"(list_sum([(summary_len {'>' if with_optional else '>='} {least})::INT, (nb > 0)::INT, " + ", ".join(f"{n}::INT" for n in names) + "])::BIGINT)"


_7, _7LONG, _5, _5SHORT = _sections(10, True), _sections(20, True), _sections(50, False), _sections(20, False)
_ROUNDED = "floor(({}) + 0.5)"
_SHARE = "100.0 * {} / nb"
#: Family -> profile -> DuckDB expression over fx_features.
COMPONENTS: dict[str, dict[str, str]] = {
    "completeness": {
        "live": f"[0, 0, 0, 40, 60, 80, 90, 100][{_7} + 1]",
        "required_five": f"20 * {_5}",
        "production": f"[0, 40, 50, 60, 70, 80, 90, 100][{_7} + 1]",
        "short_summary": f"{_5SHORT} * 100 / 5",
        "weighted": "15 * (summary_len > 0)::INT + 20 * has_skills::INT + 10 * has_projects::INT + 25 * (nb > 0)::INT + 15 * has_education::INT + 8 * has_certifications::INT + 7 * has_achievements::INT",
        "even_weights": "15 * (has_email::INT + (summary_len > 50)::INT + has_skills::INT + (nb > 0)::INT + has_education::INT) + 5 * (has_projects::INT + has_certifications::INT + has_achievements::INT)",
        "engine": f"[0, 14, 29, 43, 57, 71, 86, 100][{_7LONG} + 1]",
        "simple": "15 * (summary_len > 0)::INT + 20 * has_skills::INT + 25 * (nb > 0)::INT + 15 * has_projects::INT + 10 * has_education::INT + 15 * (has_certifications OR has_achievements)::INT",
        "graded": """10 + 5 * has_email::INT + 5 * has_phone::INT + 10 * has_education::INT + 7 * has_projects::INT + 4 * has_certifications::INT + 4 * has_achievements::INT
          + 5 * ((summary_len > 0)::INT + (summary_len >= 60)::INT + (summary_len >= 150)::INT) + 5 * ((n_skills > 0)::INT + (n_skills >= 5)::INT + (n_skills >= 10)::INT)
          + CASE WHEN n_items = 0 THEN 0 WHEN nb < 3 THEN 8 WHEN n_items = 1 OR nb < 6 THEN 15 ELSE 25 END""",
        "deep": f"[0, 20, 40, 60, 70, 80, 90, 100][{_7} + 1]",
        "headings": "20 * ((heading_summary OR summary_len > 20)::INT + (heading_skills OR has_skills)::INT + (heading_experience OR nb > 0)::INT + (heading_projects OR has_projects)::INT + (heading_education OR has_education)::INT)",
        "with_depth": "least(75, 10 * (has_email::INT + (summary_len > 50)::INT + has_skills::INT + has_education::INT) + least(25, least(16, 8 * deep_jobs + 4 * solid_jobs) + CASE WHEN n_items > 2 THEN 5 ELSE 0 END) + 4 * has_projects::INT + 3 * has_certifications::INT + 3 * has_achievements::INT)",
        "three_sections": "CASE (summary_len > 0)::INT + (nb > 0)::INT + has_skills::INT WHEN 3 THEN 90 WHEN 2 THEN 60 WHEN 1 THEN 30 ELSE 0 END",
    },
    "formatting": {
        "live": "least(100, 20 + CASE WHEN nb > 0 THEN 25 ELSE 0 END + 15 * has_dates::INT + CASE WHEN abbreviations > 20 THEN 0 ELSE 20 END + CASE WHEN nb > 0 AND ok_len * 10 > 8 * nb THEN 20 ELSE 0 END)",
        "penalties": "greatest(0, 100 - 20 * pipes::INT - 20 * images::INT - 10 * (emoji OR stars)::INT - 10 * decoration5::INT - CASE WHEN summary_words > 150 OR words_over_150 > 0 THEN 10 ELSE 0 END - CASE WHEN (summary_len > 0)::INT + (nb > 0)::INT + has_skills::INT + has_education::INT < 3 THEN 10 ELSE 0 END)",
        "production": f"least(100, 50 + 5 * {_7} + CASE WHEN nb > 0 THEN 10 ELSE 0 END + CASE WHEN has_education THEN 10 ELSE 0 END)",
        "contact": "100 - 20 * table_words::INT - 15 * icon_words::INT - CASE WHEN (summary_len > 0)::INT + has_skills::INT + (nb > 0)::INT + has_education::INT < 3 THEN 15 ELSE 0 END - CASE WHEN has_email THEN 0 ELSE 8 END - CASE WHEN has_phone THEN 0 ELSE 6 END",
        "long_bullets": "greatest(30, 100 - CASE WHEN over_200 >= 5 THEN 25 ELSE 5 * over_200 END - CASE WHEN summary_signs > 10 THEN 10 ELSE 0 END - 8 * dup_bullets - 5 * long_block)",
        "simple": "100 - 20 * (decoration::INT + table_row::INT + emoji::INT)",
        "improved": "least(100, greatest(0, 100 - 20 * image_tags::INT - 20 * (table_words OR pipes)::INT - 15 * (rare_signs > 5)::INT - 10 * (whole_words > 200)::INT + 5 * (marked_lines > 10)::INT))",
        "bullet_curve": "least(95, floor(3.5 + 2 * (summary_len > 20)::INT + 2 * has_skills::INT + CASE WHEN nb = 0 THEN 0 WHEN nb > 25 THEN 93 ELSE 40 + 2.1 * nb END))",
        "third": "greatest(0, CASE WHEN nb >= 10 AND nb <= 30 THEN least(100, 105 - p) ELSE 100 - p END)".replace("p)", "({0}))").replace("- p ", "- ({0}) ").format("30 * pipe_pair::INT + 30 * icons::INT + 30 * emoji::INT + 20 * pipe_cell::INT + CASE WHEN special_signs > 20 THEN least(20, special_signs // 5) ELSE 0 END + CASE WHEN summary_len > 0 AND nb > 0 AND has_education THEN 0 ELSE 10 END"),
        "start_80": "greatest(35, 80 - 5 * over_200 - 8 * (summary_signs > 8)::INT - 5 * (summary_len > 500)::INT)",
        "capped": "greatest(0, 100 - 20 * decoration::INT - 15 * (table_row OR table_word)::INT - 10 * emoji::INT - 10 * (summary_words > 100)::INT - least(20, 5 * words_over_35) - least(15, 5 * tiny) - least(10, 2 * words_to_2))",
        "additive": "least(100, 50 + 20 * has_dates::INT + 20 * (abbreviations < 20)::INT + 10 * (nb > 5 AND nb < 50)::INT)",
        "bullet_bands": "CASE WHEN nb < 5 THEN 50 WHEN nb < 10 THEN 70 ELSE 85 END",
    },
    "verbs": {
        "live_percent": f"CASE WHEN nb > 0 THEN {_ROUNDED.format(_SHARE.format('any_token'))} ELSE 0 END",
        "first_word": f"CASE WHEN nb > 0 THEN {_ROUNDED.format(_SHARE.format('strong_first'))} ELSE 50 END",
        "first_word_or_none": f"CASE WHEN nb > 0 THEN {_ROUNDED.format(_SHARE.format('strong_first'))} ELSE 0 END",
        "points": f"CASE WHEN nb > 0 THEN greatest(10, least(100, {_ROUNDED.format('100.0 * (2 * strong_first - 2 * double_verb + strong_metric - weak_or_double + plain_long / 2.0) / nb - least(30, 30.0 * weak_or_double / nb)')})) ELSE 50 END",
        "share_other": f"CASE WHEN nb > 0 THEN {_ROUNDED.format('(65.0 * strong_first + 35 * nb) / nb')} ELSE 0 END",
        "less_weak": f"CASE WHEN nb > 0 THEN greatest(0, {_ROUNDED.format('(100.0 * strong_first - 15 * weak_first) / nb')}) ELSE 0 END",
        "less_weak_40": f"CASE WHEN nb > 0 THEN greatest(0, {_ROUNDED.format('100.0 * strong_first / nb - 40.0 * weak_first / nb')}) ELSE 0 END",
        "with_metrics": f"CASE WHEN nb > 0 THEN least(100, {_ROUNDED.format('(40.0 * strong_first + 50 * strong_any_metric) / nb')}) ELSE 0 END",
        "experience_quality": f"CASE WHEN nb > 0 THEN {_ROUNDED.format('(30.0 * strong_first + 40 * metric + 20 * strong_any_metric) / nb + CASE WHEN distinct_strong > 10 THEN 10 ELSE distinct_strong END')} ELSE 0 END",
        "bonus": f"CASE WHEN nb > 0 THEN least(100, {_ROUNDED.format(_SHARE.format('strong_first') + ' + CASE WHEN counted_results > 1 THEN 20 ELSE 10 * counted_results END')}) ELSE 0 END",
        "bounded_tenths": f"CASE WHEN nb > 0 THEN {_ROUNDED.format(_ROUNDED.format(_SHARE.format('bounded_verbs')) + ' / 10.0')} ELSE 0 END",
        "weak_count": "weak_bullets",
        "anywhere": f"CASE WHEN nb > 0 THEN {_ROUNDED.format(_SHARE.format('any_strong'))} ELSE 100 END",
    },
    "readability": {
        "live": "CASE WHEN norm_sentences = 0 OR norm_words = 0 THEN 50 WHEN m BETWEEN 10 AND 20 THEN 100 WHEN m < 10 THEN greatest(30, floor(50.5 + 5 * m)) ELSE greatest(30, floor(140.5 - 2 * m)) END".replace(" m ", " (norm_words / norm_sentences::DOUBLE) ").replace("* m)", "* (norm_words / norm_sentences::DOUBLE))"),
        "deductions": "CASE WHEN nb > 0 THEN greatest(0, 100 - 2 * words_over_20 - 5 * (repeated > 0)::INT - 10 * (summary_words > 150 OR words_over_150 > 0)::INT - CASE WHEN no_end > 3 THEN 3 ELSE no_end END) ELSE 50 END",
        "production": "50 + 10 * (summary_len > 100)::INT + 10 * has_skills::INT + 5 * has_certifications::INT + CASE WHEN nb > 0 THEN floor(0.5 + 10.0 * digit / nb) ELSE 0 END",
        "mean_words": "CASE WHEN nb > 0 THEN least(100, greatest(0, 100 - CASE WHEN 1.0 * sum_words / nb > 24 THEN least(35, floor(2.0 * sum_words / nb - 47.5)) WHEN 1.0 * sum_words / nb < 8 THEN 12 ELSE 0 END + least(12, floor(0.5 + 20.0 * metric / nb)) + least(8, floor(0.5 + 10.0 * alpha_first / nb)))) ELSE 45 END",
        "length_penalties": "CASE WHEN nb > 0 THEN greatest(25, 80 - 4 * over_180 - 2 * over_140 - 3 * under_30 - 3 * nb + 3 * strong_first - 2 * nb + 2 * metric - CASE WHEN sum_len BETWEEN 50 * nb AND 200 * nb THEN 0 ELSE 10 END - CASE WHEN summary_len > 800 THEN 15 WHEN summary_len > 500 THEN 5 ELSE 0 END) ELSE 40 END",
        "half_long": "CASE WHEN nb > 0 THEN floor(100.5 - 50.0 * words_over_20 / nb) ELSE 0 END",
        "third": "CASE WHEN nb > 0 THEN greatest(0, least(100, floor(100.5 - least(30, 5 * words_over_25) - least(20, 3 * words_under_5) - least(20, 2 * repeated_long) - least(15, 3 * weak_opening + 3 * wide_gaps) + 10.0 * structured / nb))) ELSE 0 END",
        "start_75": "CASE WHEN nb > 0 THEN least(85, greatest(20, 75 - 4 * over_180 - 3 * under_30 - 5 * nb + 3 * strong_first + 2 * metric - 15 * dup_bullets - CASE WHEN summary_len > 1000 THEN 23 WHEN summary_len > 500 THEN 8 ELSE 0 END)) ELSE 40 END",
        "length_and_metrics": "CASE WHEN nb > 0 THEN least(100, floor(0.5 + 18.0 * metric / nb + CASE WHEN l < 40 THEN 42 WHEN l < 60 THEN 68 WHEN l <= 160 THEN 82 ELSE 72 END)) ELSE 50 END".replace(" l ", " floor(0.5 + 1.0 * sum_len / nb) "),
        "simple": "CASE WHEN nb > 0 THEN 100 - CASE WHEN words_over_35 > 4 THEN 30 ELSE 7 * words_over_35 END ELSE 0 END",
        "capped": "greatest(0, 100 - least(25, 5 * words_over_35) - least(20, 3 * repeated_plain) - least(15, 5 * dup_sentences) - 10 * any_wide_gap::INT - 5 * (summary_words BETWEEN 1 AND 9)::INT)",
        "ratios_tenths": "CASE WHEN norm_sentences = 0 OR norm_words = 0 THEN 0 WHEN m BETWEEN 10 AND 20 THEN 100 WHEN m < 10 THEN greatest(50, floor(50.5 + 5 * m)) ELSE greatest(20, floor(120.5 - m)) END".replace(" m ", " (norm_words / norm_sentences::DOUBLE) ").replace(" m)", " (norm_words / norm_sentences::DOUBLE))"),
        "additive": "CASE WHEN whole_letters > 0 THEN least(100, CASE WHEN abs(5 - 1.0 * whole_letters / whole_words) < 2 THEN 40 ELSE 30 END + CASE WHEN whole_stops = 0 THEN 0 WHEN 1.0 * whole_words / whole_stops < 25 THEN 30 WHEN 1.0 * whole_words / whole_stops < 40 THEN 20 ELSE 0 END + 30 * inner_signs::INT) ELSE 0 END",
        "length_bands": "CASE WHEN nb = 0 THEN 50 WHEN 1.0 * sum_len / nb > 150 THEN 60 WHEN 1.0 * sum_len / nb >= 80 THEN 90 WHEN 1.0 * sum_len / nb >= 40 THEN 75 ELSE 50 END",
    },
}

#: The live verb curve over a percentage: five straight pieces, with jumps at 25, 50, 75 and 90.
VERB_CURVE = "CASE WHEN {0} < 25 THEN 0 WHEN {0} < 50 THEN 20 + ({0} - 25) * 0.4 WHEN {0} < 75 THEN 50 + ({0} - 50) * 0.4 WHEN {0} < 90 THEN 80 + ({0} - 75) * (2 / 3.0) ELSE 100 END"

_WITH, _WITHOUT = "(4 * k + 2 * f + 2 * c + a + r) / 10.0", "(3 * f + 3 * c + 2 * a + 2 * r) / 10.0"
_MODE = f"(CASE WHEN has_jd THEN {_WITH} ELSE {_WITHOUT} END)"
#: Profile -> DuckDB expression over k, f, c, a, r, has_jd.
TOTALS = {
    "plain": f"floor({_WITH} + 0.5)",
    "null_without_keywords": f"CASE WHEN NOT has_jd THEN NULL ELSE floor({_WITH} + 0.5) END",
    "equal_mean": "floor((k + f + c + a + r) * 0.2 + 0.5)",
    "production": f"CASE WHEN NOT has_jd THEN least(80, floor({_WITHOUT} + 0.5)) ELSE floor((40 * k + 25 * c + 15 * f + 10 * a + 10 * r) / 100.0 + 0.5) END",
    "lifted": f"CASE WHEN has_jd AND {_WITH} > 95 AND (f < 90 OR c < 90 OR a < 90 OR r < 90) THEN 90 WHEN has_jd THEN floor(CASE WHEN {_WITH} >= 30 THEN {_WITH} ELSE least(30, 1.2 * {_WITH}) END + 0.5) ELSE least(85, floor(CASE WHEN {_WITHOUT} >= 30 THEN {_WITHOUT} ELSE least(30, 1.2 * {_WITHOUT}) END + 0.5)) END",
    "soft_cap": f"CASE WHEN floor({_MODE} + 0.5) <= 90 THEN floor({_MODE} + 0.5) ELSE floor(90.5 + 0.35 * (floor({_MODE} + 0.5) - 90)) END",
}
TIER = "CASE WHEN k < 50 OR c < 40 THEN 'developing' WHEN k < 70 OR c < 55 THEN 'average' WHEN k < 85 OR c < 75 THEN 'strong' ELSE 'exceptional' END"
