"""Wording of bullets and keywords: contexts, expansions, keyword placement, wording of missing results.

Every rule table is an argument, so a caller's own list runs the same way as the fixed
ones here; a table becomes one ordered conditional expression on the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extraction import labelled
from .rewriting import first_rule, replace_pattern

# What a bullet is about, first match wins.
CONTEXTS = (
    ("analyz|query|database|data|sql|python|pandas|numpy", "data-analysis"),
    ("develop|build|implement|engineer|code|wrote", "development"),
    ("manage|lead|direct|oversee|coordinate", "management"),
    ("test|qa|automat|validate|verify", "testing"),
    ("design|architecture|architect", "design"),
    ("deploy|release|launch|production", "deployment"),
    ("optimize|improve|refactor|performance", "optimization"),
    ("document|write|technical", "documentation"),
)
# What a short bullet is expanded with, first match wins.
EXPANSIONS = (
    ("develop.*dashboard", "to support business reporting and analytics"),
    ("develop.*api", "to enable third-party integrations and data access"),
    ("develop.*database", "to support data persistence and retrieval"),
    ("develop.*feature", "to enhance user experience"),
    ("build.*system", "to streamline operations"),
    ("build.*tool", "to improve team productivity"),
    ("built.*api", "to facilitate seamless integrations"),
    ("manage.*team", "to ensure project success"),
    ("lead.*project", "from conception through deployment"),
    ("led.*initiative", "with measurable business impact"),
    ("optimized.*process", "to reduce operational overhead"),
    ("automated.*task", "to eliminate manual work"),
    ("implemented.*solution", "to address critical business needs"),
)
EXPANSION_ELSE = "with measurable impact"
# Which result a bullet without one may name, first match wins.
RESULT_HINTS = (
    ("deploy|pipeline|ci.?cd|infrastructure|devops|automation", " (e.g., reduced deployment time by X%, increased release frequency)"),
    ("design|architect|scal|distributed|system", " (e.g., supported N+ concurrent users with Y% uptime)"),
    ("optim|improv|enhanc|perform|efficiency", " (e.g., X% faster response times, Y% error reduction)"),
    ("build|develop|implement|create|deliver", " (e.g., delivered X weeks ahead, achieved Y% test coverage)"),
    ("integrat|api|service|connect|endpoint", " (e.g., processes N+ daily transactions, zero data loss)"),
    ("test|debug|resolv|fix|quality|bug", " (e.g., reduced production bugs by X%, improved uptime to Y%)"),
    ("collaborat|mentor|train|lead|manage|team", " (e.g., improved team velocity by X%, trained Y people)"),
)
RESULT_HINT_ELSE = " (e.g., achieved X% improvement in Y metric)"
# Stronger verbs for weak ones.
STRONGER = {
    "helped": ["facilitated", "enabled", "supported", "collaborated"],
    "worked": ["developed", "engineered", "built", "created"],
    "managed": ["led", "orchestrated", "directed", "coordinated"],
    "did": ["implemented", "executed", "delivered", "completed"],
    "responsible": ["owned", "spearheaded", "drove", "led"],
    "assisted": ["collaborated", "partnered", "supported"],
    "participated": ["contributed", "engaged", "involved"],
    "made": ["created", "built", "developed", "engineered"],
}
# Keywords that are charts, tools and ways of working; marks of wording that a person must fill in.
CHART_TOOLS = "(?i)tableau|power\\s*bi|looker|qlik|grafana|dashboard|visualization"
TOOLS = "^[A-Z]|(?i)^(?:python|javascript|java|c\\+\\+|c#|ruby|php|go|rust|kotlin|typescript|sql|mongodb|postgres|mysql|redis|elasticsearch|docker|kubernetes|aws|azure|gcp|jenkins|git|jira|slack|salesforce)"
METHODS = "(?i)agile|scrum|lean|devops|ci/cd|microservice|monolithic|rest|graphql|soap|api|design\\s+pattern"
PLACEHOLDERS = ("(e.g.,", "X%", "Y%", "Y metric", "N+")


def context(text: Column, rules=CONTEXTS) -> Column:
    """What the bullet is about, or null."""
    low = F.lower(text)
    return first_rule(text, [(low.rlike(p), label) for p, label in rules], F.lit)


def expanded(text: Column, rules=EXPANSIONS, other: str = EXPANSION_ELSE, least: int = 8) -> Column:
    """A bullet of fewer than ``least`` words with the ending of its first rule."""
    bare = F.trim(text)
    return F.when(F.size(F.split(bare, "\\s+")) >= least, bare).otherwise(F.concat(bare, F.lit(" "), labelled(F.lower(text), list(rules), other)))


def result_hint(text: Column, rules=RESULT_HINTS, other: str = RESULT_HINT_ELSE) -> Column:
    return labelled(F.lower(text), list(rules), other)


def stronger_verbs(verb: Column, verbs: dict[str, list[str]] = STRONGER) -> Column:
    """Stronger verbs for a weak one, an empty array for any other."""
    out = F.array().cast("array<string>")
    for weak, strong in verbs.items():
        out = F.when(F.lower(F.trim(verb)) == weak, F.array(*map(F.lit, strong))).otherwise(out)
    return out


def rewritten(text: Column, patterns, has_result: str, rules=EXPANSIONS) -> Column:
    """Struct of a bullet's rewriting: rewritten, expanded, has_result, confidence."""
    bare = F.trim(text)
    new = F.coalesce(replace_pattern(bare, patterns), bare)
    long = expanded(new, rules)
    confidence = F.when(F.size(F.split(long, "\\s+")) > 20, "low").when(new != bare, "high").otherwise("medium")
    return F.struct(new.alias("rewritten"), long.alias("expanded"), F.lower(long).rlike(has_result).alias("has_result"), confidence.alias("confidence"))


def first_weak_word(text: Column, verbs: dict[str, str]) -> Column:
    """The text with the first of ``verbs`` that stands in it replaced, at its first place; else unchanged."""
    out = text
    for weak, strong in reversed(list(verbs.items())):
        pattern = f"(?i)(?<![A-Za-z0-9_]){weak}(?![A-Za-z0-9_])"
        at = F.length(F.substring_index(F.regexp_replace(text, pattern, "\u0001"), "\u0001", 1))
        out = F.when(text.rlike(pattern), F.concat(F.substring(text, F.lit(1), at), F.lit(strong), F.substring(text, at + len(weak) + 1, F.length(text)))).otherwise(out)
    return out


def placing(text: Column, contexts=CONTEXTS) -> Column:
    """What :func:`integrated` finds in a bullet: struct (bare, low, main, about)."""
    bare = F.trim(text)
    main = F.trim(F.substring_index(F.substring_index(bare, ".", 1), "•", 1))
    return F.struct(bare.alias("bare"), F.lower(bare).alias("low"), main.alias("main"), context(main, contexts).alias("about"))


def integrated(text: Column, keyword: Column, strong: list[str], contexts=CONTEXTS, found: Column | None = None) -> Column:
    """Struct (improved, confidence, integrated): the keyword placed by the first way that suits the bullet.

    A chart tool goes to data work, any keyword to a list behind ``using`` or ``with``, a tool
    into its activity, a way of working behind the verb; else a tool, or a keyword of a
    bullet with a known context, goes to the end. A keyword that is there stays once.
    ``found`` is the bullet's :func:`placing`, where it is at hand.
    """
    found = placing(text, contexts) if found is None else found
    bare, low, main, about = (found[x] for x in ("bare", "low", "main", "about"))
    tool = keyword.rlike(TOOLS)
    group = lambda pattern, k: F.regexp_extract(main, pattern, k)
    rest = lambda pattern: F.substring(main, F.length(group(pattern, 0)) + 1, F.length(main))
    aim = "^(.+?using\\s+[^.]+?)\\s+to\\s+(.+)$"
    chart = (
        F.when(main.rlike(aim), F.concat(group(aim, 1), F.lit(" and built "), keyword, F.lit(" dashboards to visualize insights and support data-driven decision making.")))
        .when(main.contains("using"), F.concat(main, F.lit(" and built "), keyword, F.lit(" dashboards to visualize insights.")))
        .otherwise(F.concat(main, F.lit(" and visualized results with "), keyword))
    )
    stack = "(?i)^(.+?(?:using|with)\\s+)([^.]+?)(\\s+(?:to|for|,|\\.).*)?$"
    joint = F.when(group(stack, 2).contains(",") | group(stack, 2).rlike("(?i)\\s+and\\s+\\w+$"), ", ").otherwise(" and ")
    listed = F.when(main.rlike(stack), F.concat(group(stack, 1), F.trim(group(stack, 2)), joint, keyword, group(stack, 3))).otherwise(main)
    thing = "(?i)^([^.]+?)\\s+(system|service|platform|feature|app|application|api|solution|dashboard)"
    work = "(?i)^([^.]+?)\\s+(query|process|algorithm|workflow)"
    active = (
        F.when((about == "development") & main.rlike(thing), F.concat(group(thing, 1), F.lit(" "), keyword, F.lit("-powered "), group(thing, 2), rest(thing)))
        .when(about.isin("data-analysis", "optimization") & main.rlike(work), F.concat(group(work, 0), F.lit(" using "), keyword, rest(work)))
        .otherwise(F.concat(main, F.lit(" with "), keyword))
    )
    verb = "^(\\w+)"
    method = F.when(F.lower(group(verb, 1)).isin(strong), F.concat(group(verb, 1), F.lit(" using "), keyword, F.lit(" methodology"), rest(verb))).otherwise(F.concat(main, F.lit(" using "), keyword, F.lit(" principles")))
    last = F.concat(main, F.when(tool, F.lit(" leveraging ")).otherwise(F.lit(" with ")), keyword)
    there = F.contains(low, F.lower(keyword))
    in_list = low.contains("using ") | low.contains(" with ")
    data = low.contains("analyz") | low.contains("data")
    ways = ((data & keyword.rlike(CHART_TOOLS), chart, "high"), (in_list, listed, "high"), (about.isNotNull() & tool, active, "medium"), (keyword.rlike(METHODS), method, "medium"), (tool | about.isNotNull(), last, "low"))
    new, sure = F.lit(None).cast("string"), F.lit("low")
    for test, way, confidence in reversed(ways):
        new, sure = F.when(test, way).otherwise(new), F.when(test, confidence).otherwise(sure)
    done = ~there & new.isNotNull() & (new != main)
    done = F.coalesce(done, F.lit(False))
    return F.struct(F.when(done, F.trim(new)).otherwise(bare).alias("improved"), F.when(there, "high").when(done, sure).otherwise("low").alias("confidence"), done.alias("integrated"))


def placing_signs(text: Column) -> Column:
    """What :func:`integrated` asks of a bullet alone before it builds anything: struct (data, in_list)."""
    low = F.lower(text)
    return F.struct((low.contains("analyz") | low.contains("data")).alias("data"), (low.contains("using ") | low.contains(" with ")).alias("in_list"))


def keyword_kinds(keyword: Column) -> Column:
    """What :func:`integrated` asks of a keyword alone: struct (chart, tool, method)."""
    return F.struct(keyword.rlike(CHART_TOOLS).alias("chart"), keyword.rlike(TOOLS).alias("tool"), keyword.rlike(METHODS).alias("method"))


def may_be_placed(signs: Column, kinds: Column) -> Column:
    """False only where :func:`integrated` has no way but the last, whose confidence is low."""
    return signs["in_list"] | kinds["tool"] | kinds["method"] | signs["data"] & kinds["chart"]


def auto_applicable(kind: Column, improved: Column, advisory: Column) -> Column:
    """A keyword, or a rewriting without marks that a person must fill in, can be applied as it is."""
    open_ = F.lit(False)
    for mark in PLACEHOLDERS:
        open_ = open_ | improved.contains(mark)
    filled = F.coalesce(improved != "", F.lit(False))
    return filled & F.when(kind == "keyword", ~improved.contains(PLACEHOLDERS[0])).when(kind == "action_verb", ~advisory & ~open_).otherwise(F.lit(False))
