"""Records and vocabularies: drifting shapes, role rows, skill sets, keyword filters, narrative texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .features import bounded

# Keyword categories of the extraction and of the stored form.
CATEGORY_ENUM = {"language": "skill", "framework": "skill", "database": "skill", "cloud": "tool", "tool": "tool", "practice": "responsibility", "soft_skill": "qualification", "concept": "skill", "general": "other"}
# Words that a kept keyword has one of.
RESPONSIBILITY_VERBS = "design develop deploy implement optimize build maintain deliver architect integrate".split()
TECH_TOKENS = """javascript typescript python java golang go rust csharp cpp sql nosql react angular vue nodejs express nestjs nextjs django flask spring laravel
mongodb postgresql mysql redis elasticsearch kafka rabbitmq graphql rest api microservices docker kubernetes terraform jenkins github gitlab aws azure gcp
tableau powerbi spark hadoop machine learning nlp pandas numpy scikit""".split()
# Groups of names of one technology.
VARIANT_GROUPS = (
    ("react", "react-native", "reactjs", "react.js"), ("vue", "vue.js", "vuejs"), ("angular", "angularjs", "angular.js"), ("next", "nextjs", "next.js"), ("nuxt", "nuxtjs", "nuxt.js"),
    ("node", "nodejs", "node.js"), ("express", "express.js", "expressjs"), ("mongo", "mongodb", "mongo-db"), ("postgres", "postgresql", "postgres-sql"), ("mysql", "mysql-db"),
    ("aws", "amazon-web-services", "amazon web services"), ("azure", "microsoft-azure"), ("gcp", "google-cloud", "google cloud platform"), ("end-to-end", "e2e", "e2e-testing"),
    ("cpp", "c++", "c-plus-plus"), ("csharp", "c#", "c-sharp"), ("golang", "go", "go-lang"), ("ml", "machine-learning", "machine learning"), ("nlp", "natural-language-processing"),
)
# Two- and three-word phrases of the trade (first words, last words).
TECHNICAL_PHRASES = (
    ("web|mobile|cloud|data|software|system|network|database|front.?end|back.?end|full.?stack", "development|engineering|architecture|design|analysis|developer|engineer"),
    ("rest|restful|graphql|soap|grpc", "api|endpoint|service"),
    ("unit|integration|end.?to.?end|e2e|regression|smoke|load|stress|performance", "testing|test|tests"),
    ("machine|deep|reinforcement|supervised|unsupervised", "learning"),
    ("natural language|computer", "processing|vision"),
    ("neural|convolutional|recurrent", "network"),
    ("continuous|ci.?cd", "integration|deployment|delivery"),
    ("container|service", "orchestration"),
    ("infrastructure|configuration", "as code|management"),
    ("cloud|serverless|microservices", "architecture"),
    ("object.?oriented|functional|procedural|declarative", "programming"),
    ("responsive|adaptive|mobile.?first", "design"),
    ("user|customer", "experience|interface|research|testing"),
    ("agile|scrum|kanban|waterfall|lean", "methodology|development|framework"),
    ("data|business", "analytics|intelligence|visualization|warehouse|lake|pipeline|mining"),
    ("version|source", "control"),
    ("code|peer", "review"),
    ("horizontal|vertical", "scaling"),
)
# Tools that are listed by name.
TOOLS = "git github gitlab bitbucket jira confluence slack docker kubernetes jenkins travis circleci aws azure gcp heroku netlify vercel vscode intellij eclipse".split()


def mapped(column: Column, values: dict[str, str], other: str) -> Column:
    """The value of a small fixed map, ``other`` for what it lacks."""
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, column), F.lit(other))


def drifting_score(record: Column, *keys: str) -> Column:
    """A score under the first of ``keys`` that holds one other than 0, as ``{"score": n}`` or as n; 0 without any."""
    def value(key: str) -> Column:
        flat = F.get_json_object(record, f"$.{key}")
        return F.nullif(F.coalesce(F.get_json_object(record, f"$.{key}.score").try_cast("double"), flat.try_cast("double")), F.lit(0.0))

    return F.coalesce(*[value(k) for k in keys], F.lit(0.0))


def drifting_total(record: Column) -> Column:
    """A total as a number, or inside an object, under its new or old name; null without any."""
    paths = ("$.totalScore", "$.score", "$.totalScore.totalScore", "$.score.totalScore")
    return F.coalesce(*[F.get_json_object(record, p).try_cast("double") for p in paths])


def inserted_if_absent(snapshot: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``snapshot`` with those of ``rows`` whose key it lacks."""
    have = snapshot.select(F.col(key).alias("__have"))
    return snapshot.unionByName(rows.join(have, F.col(key) == F.col("__have"), "left_anti"))


def skill_items(text: Column) -> Column:
    """Distinct skills of a list that commas, dots, bars or slashes part, in lower case."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text), "[,•|/]"), lambda x: F.trim(x)), lambda x: x != ""))


def vocabulary(skills: Column, title: Column, bullets: Column) -> Column:
    """Sorted distinct words and phrases of a résumé: skills, title, and words of four letters or more."""
    words = F.filter(t.tokens(t.words_only(F.array_join(bullets, " "))), lambda x: F.length(x) >= 4)
    phrases = F.filter(F.concat(F.transform(skills, t.words_only), F.array(t.words_only(title))), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(phrases, words)))


def technical_phrases(text: Column, phrases=TECHNICAL_PHRASES) -> Column:
    """Distinct neighbouring two and three words that hold one of ``phrases``, in order."""
    words = F.filter(F.split(F.lower(text), "\\s+"), lambda x: x != "")
    known = "|".join(f"(?:{a})\\s+(?:{b})" for a, b in phrases)
    return F.array_distinct(F.filter(F.concat(t.ngrams(words, 2), t.ngrams(words, 3)), lambda x: x.rlike(bounded(known))))


def tools_named(text: Column, tools: list[str]) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(bounded(x)), x) for x in tools]))


def meaningful(keyword: Column, ignored: list[str], wanted: list[str]) -> Column:
    """The keyword's words that count, joined; null unless one is wanted or has a technical sign."""
    words = F.transform(F.split(F.regexp_replace(F.lower(keyword), "[^\\w\\s+#.]", " "), "\\s+"), lambda x: F.regexp_replace(x, "[^\\w+#.]", ""))
    words = F.filter(words, lambda x: (F.length(x) >= 3) & ~x.rlike("^\\d+$") & ~x.isin(ignored))
    return F.when(F.exists(words, lambda x: x.isin(wanted) | x.rlike("[+#.]")), F.array_join(words, " "))


def whole_phrase(text: Column, forms: Column) -> Column:
    """Whether some form stands in the text as whole words, with hyphens or spaces between."""
    signs = "([.*+?^${}()|\\[\\]\\\\])"
    pattern = lambda x: F.concat(F.lit("(?<![A-Za-z0-9_])"), F.regexp_replace(F.regexp_replace(x, signs, "\\\\$1"), "[-\\s]+", "[\\\\s-]+"), F.lit("(?![A-Za-z0-9_])"))
    return F.exists(forms, lambda x: F.rlike(F.lower(text), pattern(x)))


def narrative(keyword: str, verbs: str, total: str, strong: str, weak: str, bare: str) -> dict[str, Column]:
    """Strength and improvement texts, and the number of next steps, from columns of scores and bullet counts."""
    k, a, n, s, w, m = map(F.col, (keyword, verbs, total, strong, weak, bare))
    number = lambda x: x.cast("string")
    strength = F.concat(
        F.when(k >= 80, F.concat(F.lit("Strong keyword alignment ("), number(k), F.lit("%)."))).when(k >= 60, F.concat(F.lit("Good keyword coverage ("), number(k), F.lit("%)."))).otherwise(""),
        F.when(a >= 80, F.concat(F.lit(" Most bullets ("), number(s), F.lit("/"), number(s + w), F.lit(") start with strong action verbs."))).otherwise(""),
    )
    level = F.when(n >= 75, "strong").when(n >= 60, "adequate").otherwise("needs improvement")
    gaps = ((k < 60, F.lit("Add key terms.")), (a < 75, F.concat(F.lit("Strengthen "), number(w), F.lit(" bullets."))), (m > s * 0.4, F.concat(F.lit("Add metrics to "), number(m), F.lit(" bullets."))))
    return {
        "strength": F.when(strength == "", F.concat(F.lit("Resume is "), level, F.lit("."))).otherwise(strength),
        "improvement": F.concat_ws(" ", *[F.when(test, text) for test, text in gaps]),
        "n_steps": sum((test.cast("int") for test, _ in gaps), F.lit(0)),
    }


def weighted_role(text: Column, roles: dict[str, list[tuple[str, int]]], default: str, head: int = 200) -> Column:
    """The role with most weight of terms as whole words, twice the weight in the first ``head`` characters; the first among equals."""
    low = F.lower(text)
    top = F.substring(low, 1, head)
    points = [sum((F.when(low.rlike(bounded(term)), F.when(top.rlike(bounded(term)), 2 * n).otherwise(n)).otherwise(0) for term, n in terms), F.lit(0)) for terms in roles.values()]
    most, out = F.greatest(*points), F.lit(default)
    for name, n in reversed(list(zip(roles, points, strict=True))):
        out = F.when((n == most) & (most > 0), name).otherwise(out)
    return out


def role_by_margin(keywords: DataFrame, key: str, roles: dict[str, list[str]], default: str, margin: int = 2) -> DataFrame:
    """(key, role) from (key, keyword, weight): the role with most weight, unless another is nearer than ``margin``."""
    sums = [F.sum(F.when(F.col("keyword").isin(terms), F.col("weight")).otherwise(0)) for terms in roles.values()]
    rows = keywords.groupBy(key).agg(F.array(*[F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("role")) for k, (name, n) in enumerate(zip(roles, sums, strict=True))]).alias("s"))
    order = F.sort_array("s", asc=False)
    first, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    return rows.select(key, F.when((first["n"] == 0) | (first["n"] - second["n"] < margin), default).otherwise(first["role"]).alias("role"))


def skills_with_missing(skills: Column, missing: Column, category: Column) -> Column:
    """Skill groups and one for each category of the missing keywords, each once; ``category`` is of (keyword, name) structs."""
    return F.concat(skills, F.transform(F.array_distinct(F.transform(category, lambda c: c["name"])), lambda n: F.struct(n.alias("category"), F.transform(F.filter(category, lambda c: c["name"] == n), lambda c: c["keyword"]).alias("items"))))
