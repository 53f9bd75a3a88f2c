"""Suggestion lists by profile, made in the résumé's row.

A row holds the judged bullets of a résumé as one array, its missing keywords, its
component scores and what its sections hold. A profile is a chain of branches; each
branch is an array of entries, and later branches see which bullets are taken and how
much room is left. So a list costs no shuffle and no window, whatever its rules are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import wording as w
from .rewriting import first_rule, replace_opening, replace_pattern, with_metric_tail

ENTRY = "struct<type:string,section:string,pos:int,current:string,improved:string,impact:string>"

# Words of bullets that are improved already, and phrases that tell an effect.
IMPROVED = ("resulting in", "improved", "optimized", "developed", "implemented", "built", "engineered", "architected", "designed", "created", "deployed", "launched", "established", "transformed")
EFFECTS = ("resulting in", "by ", "improving", "reducing", "increasing", "enhancing", "supporting", "enabling")
# Keywords that no list proposes.
SOFT_SKILLS = ("communication", "teamwork", "leadership", "soft skill")
FILLERS = ("india", "united", "states", "california", "new", "york", "london", "bangalore", "remote", "about", "looking", "applications", "type", "employment", "understanding", "seeking", "interested", "passionate")


def nothing() -> Column:
    return F.array().cast(f"array<{ENTRY}>")


def entry(kind: str, section: str, pos, current, improved, impact) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("type"), F.lit(section).alias("section"), text(pos).cast("int").alias("pos"), text(current).cast("string").alias("current"), text(improved).cast("string").alias("improved"), text(impact).alias("impact"))


def judged(bullets: Column, openings, strong: list[str], metric: str, tails, other_tail: str, patterns, hints=w.RESULT_HINTS, expansions=w.EXPANSIONS, gerund_after: tuple[str, ...] = (), fields: tuple[str, ...] = ()) -> Column:
    """What the lists ask of a bullet, found once: array of structs in order, ``pos`` from 1; of the ``fields`` named, or of all.

    In steps, so that a step refers to what the one before has found and does not repeat it.
    """
    first = lambda x: F.regexp_replace(F.lower(F.get(F.split(F.trim(x), "\\s+"), F.lit(0))), "[^a-z]", "")
    has = lambda x, words: sum((F.contains(x, F.lit(y)).cast("int") for y in words), F.lit(0))
    hint = lambda low: F.coalesce(first_rule(low, [(t.has_pattern(low, p), label) for p, label in hints], F.lit), F.lit(w.RESULT_HINT_ELSE))
    steps = [
        {"text": lambda y: y["x"], "bare": lambda y: F.trim(y["x"]), "low": lambda y: F.lower(y["x"])},
        {"new": lambda y: F.coalesce(replace_pattern(y["bare"], patterns), y["bare"]), "done": lambda y: has(y["low"], IMPROVED), "effects": lambda y: has(y["low"], EFFECTS)},
        {"long": lambda y: w.expanded(y["new"], expansions)},
    ]
    out = {
        "pos": lambda y: y["pos"],
        "text": lambda y: y["text"],
        "n": lambda y: F.length(y["text"]),
        "words": lambda y: F.size(F.split(y["bare"], "\\s+")),
        "strong": lambda y: first(y["text"]).isin(strong),
        "metric": lambda y: y["text"].rlike(metric),
        "verb": lambda y: replace_opening(y["text"], openings, gerund_after),
        "tail": lambda y: with_metric_tail(y["text"], tails, other_tail),
        "hinted": lambda y: F.concat(y["text"], hint(y["low"])),
        "rewritten": lambda y: y["new"],
        "expanded": lambda y: y["long"],
        "sure": lambda y: F.when(F.size(F.split(y["long"], "\\s+")) > 20, "low").when(y["new"] != y["bare"], "high").otherwise("medium"),
        "open": lambda y: (y["done"] == 0) & (y["effects"] <= 1),
        "plain": lambda y: y["effects"] == 0,
        # a sentence is where a stop follows another sign; a pattern of the whole sentence takes the square of an open one's length
        "sentences": lambda y: F.regexp_count(y["text"], F.lit("[^.!?][.!?]")) > 1,
    }
    asks = {"words": ["bare"], "hinted": ["low"], "rewritten": ["new"], "expanded": ["long"], "sure": ["long"], "open": ["done", "effects"], "plain": ["effects"], "new": ["bare"], "done": ["low"], "effects": ["low"], "long": ["new"]}
    wanted, todo = {"text"}, [x for f in fields or out for x in asks.get(f, [])]
    while todo:
        x = todo.pop()
        wanted.add(x)
        todo += asks.get(x, [])
    rows, known = F.transform(bullets, lambda x, i: F.struct((i + 1).alias("pos"), x.alias("x"))), ["pos"]
    for step in steps:
        more = {k: make for k, make in step.items() if k in wanted}
        if more:
            rows = F.transform(rows, lambda y: F.struct(*[y[k].alias(k) for k in known], *[make(y).alias(k) for k, make in more.items()]))
            known += more
    return F.transform(rows, lambda y: F.struct(*[make(y).alias(k) for k, make in out.items() if not fields or k in fields]))


def gates(b: Column) -> dict[str, Column]:
    """Whether a judged bullet may get a suggestion of a kind: none that is improved already."""
    weak = b["verb"].isNotNull()
    return {
        "weak_verb": b["open"] & weak & (b["n"] >= 5),
        "missing_metrics": b["open"] & ~b["metric"] & b["plain"] & (b["n"] > 20),
        "weak_bullet": b["open"] & weak & ~b["metric"] & (b["n"] >= 8),
    }


class List:
    """A list that branches are added to, in the column ``l`` of ``df``; ``b`` are the judged bullets.

    Each branch is a projection of its own, so what it asks of the entries before it is a
    column and not the expression that made them.
    """

    def __init__(self, df: DataFrame):
        self.df, self.b, self.rows = df.withColumn("l", nothing()), F.col("b"), F.col("l")

    @property
    def size(self) -> Column:
        return F.size("l")

    def add(self, more: Column, when: Column | bool = True, room: int | None = None) -> List:
        """Entries behind the others, where ``when`` holds; with ``room`` no more than make so many in all."""
        if room is not None:
            more = F.slice(more, F.lit(1), F.greatest(F.lit(0), F.lit(room) - self.size))
        self.df = self.df.withColumn("l", F.concat("l", more if when is True else F.when(when, more).otherwise(nothing())))
        return self

    def one(self, made: Column, when: Column | bool = True, below: int | None = None) -> List:
        """One entry, if the list is shorter than ``below``."""
        test = F.lit(True) if when is True else when
        return self.add(F.array(made), test & (self.size < below) if below else test)

    def made(self, rows: Column) -> DataFrame:
        """The list as ``rows`` of it."""
        return self.df.withColumn("l", rows)

    def passing(self, test: Callable[[Column], Column], free: bool = False) -> Column:
        """The bullets that pass; with ``free`` only those no entry has."""
        if not free:
            return F.filter(self.b, test)
        taken = F.transform("l", lambda e: e["pos"])
        return t.bound(taken, lambda known: F.filter(self.b, lambda b: test(b) & ~F.coalesce(F.array_contains(known, b["pos"]), F.lit(False))))

    def bullets(self, test: Callable[[Column], Column], make: Callable[[Column], Column], most: int | None = None, free: bool = False) -> Column:
        """Entries of the bullets that pass, at most ``most``; with ``free`` only of those no entry has."""
        passed = self.passing(test, free)
        made = F.transform(passed if most is None else F.slice(passed, 1, most), make)
        return F.coalesce(made, nothing())

    def first_of_jobs(self, test: Callable[[Column], Column], make: Callable[[Column], Column], free: bool = False) -> Column:
        """Entries of the first bullet that passes in each job of three bullets."""
        job = lambda b: F.floor((b["pos"] - 1) / 3)
        first = lambda found: F.filter(found, lambda b, i: (i == 0) | (job(F.get(found, i - 1)) != job(b)))
        return F.coalesce(F.transform(t.bound(self.passing(test, free), first), make), nothing())

    def keywords(self, words: Column, most: int, make: Callable[[Column], Column]) -> Column:
        return F.transform(F.slice(words, 1, most), make)


def _word(x: Column) -> Column:
    return entry("keyword", "skills", None, "Skills section", x["keyword"], "high")


def _verb(kind: str, impact: str) -> Callable[[Column], Column]:
    return lambda b: entry(kind, "experience", b["pos"], b["text"], b["verb"], impact)


def _tail(b: Column) -> Column:
    return entry("metrics", "experience", b["pos"], b["text"], b["tail"], "high")


_WEAK = lambda b: b["verb"].isNotNull() & (b["verb"] != b["text"])
_BARE = lambda b: ~b["metric"] & (b["tail"] != b["text"])
_NO_SOFT = lambda words: F.filter(words, lambda x: ~F.lower(x["keyword"]).isin(*SOFT_SKILLS))


def _section(name: str, improved: str, impact: str = "high") -> Column:
    return entry("section", name, None, "", improved, impact)


def rule_engine(rows: DataFrame) -> DataFrame:
    """Five keywords; then weak verbs among the first two bullets of each job, to five in all but one at least; a short summary."""
    out = List(rows)
    out.add(out.keywords(F.col("missing"), 5, _word))
    verbs = out.bullets(lambda b: ((b["pos"] - 1) % 3 < 2) & gates(b)["weak_verb"] & _WEAK(b), _verb("weak_verb", "high"))
    out.add(F.slice(verbs, F.lit(1), F.greatest(F.lit(1), F.lit(5) - out.size)))
    return out.one(entry("weak_summary", "summary", None, F.col("summary"), "Write what you deliver.", "high"), F.length("summary") < 100).df


def by_severity(rows: DataFrame) -> DataFrame:
    """Keywords, summary, few skills, a verb or a result for every bullet, sections; what applies as it is comes first, then by severity; twelve."""
    out = List(rows)
    out.add(out.keywords(F.filter("missing", lambda x: (F.length(x["keyword"]) >= 3) & ~x["keyword"].isin(*FILLERS)), 5, _word))
    out.one(entry("content", "summary", None, F.col("summary"), "Write three or four sentences.", "medium"), F.length("summary") < 100)
    out.one(entry("content", "skills", None, F.concat(F.col("n_skills").cast("string"), F.lit(" skills")), "Add skills.", "medium"), F.col("n_skills") < 6)
    sound = lambda b: ~b["text"].rlike("(?i)^add\\s+|corrupted|error|bug|test|temp")
    out.add(out.bullets(lambda b: sound(b) & (b["strong"] & ~b["metric"] | ~b["strong"] & _WEAK(b)), lambda b: entry("bullet", "experience", b["pos"], b["text"], F.when(b["strong"], b["hinted"]).otherwise(b["verb"]), "medium")))
    for name, test in (("summary", F.length("summary") < 50), ("skills", F.col("n_skills") == 0), ("experience", F.size("b") == 0), ("projects", F.col("n_projects") == 0), ("education", F.col("n_education") == 0)):
        out.one(entry("structure", name, None, "", f"Add {name}.", "high"), test)
    applies = lambda e: (e["type"] == "keyword") | ((e["type"] == "bullet") & ~e["improved"].contains("(e.g.,"))
    keyed = F.transform(out.rows, lambda e, i: F.struct(F.when(applies(e), 0).otherwise(1).alias("a"), F.when(e["impact"] == "high", 0).otherwise(1).alias("s"), i.alias("i"), e.alias("e")))
    return out.made(F.slice(F.transform(F.array_sort(keyed), lambda x: x["e"]), 1, 12))


def live(rows: DataFrame, tails, other_tail: str, also_weak: tuple[str, ...] = ()) -> DataFrame:
    """The live list: two keywords below 70, then a branch for each path; six, and each bullet once.

    With experience: three weak verbs below 80, one result, a summary under 100 characters, what
    is missing of summary and education below 70, and what a list of one or none falls back on.
    Freshers (``fresher``), whose bullets are those of projects: the first bullet that may be
    improved, a summary under 80 characters, and the structure; nothing to fall back on. A
    bullet of a project is improved if it has no result yet and opens strong or weak;
    ``also_weak`` are openings that count as weak and have no other verb. A branch whose
    column is null adds nothing; a null ``fresher`` is a résumé with experience.
    """
    out = List(rows)
    fresher, summary = F.coalesce("fresher", F.lit(False)), F.col("summary")
    said = F.when(summary == "", "(No summary)").otherwise(summary)
    out.add(out.keywords(F.col("missing"), 2, _word), F.col("k") < 70)

    weak = lambda b: b["verb"].isNotNull() | F.lower(b["text"]).rlike("^(" + "|".join(also_weak or ("(?!)",)) + ")")
    better = lambda b: with_metric_tail(F.when(b["strong"], b["text"]).otherwise(F.coalesce(b["verb"], b["text"])), tails, other_tail)
    out.add(out.bullets(lambda b: ~b["metric"] & (b["n"] >= 10) & (b["strong"] | weak(b)), lambda b: entry("projects", "projects", b["pos"], b["text"], better(b), "high"), 1), fresher & (F.col("n_projects") > 0), room=6)
    out.add(out.bullets(lambda b: _WEAK(b) & ~b["strong"], _verb("action_verb", "medium"), 3), ~fresher & (F.col("a") < 80), room=6)
    out.add(out.bullets(lambda b: ~b["metric"], lambda b: entry("experience", "experience", b["pos"], b["text"], b["tail"], "high"), 1, free=True), ~fresher, room=6)
    advice = F.when(fresher, "Say what you study and what you want to build.").otherwise("Say in two sentences what you do best.")
    out.one(entry("summary", "summary", None, said, advice, "medium"), F.length(summary) < F.when(fresher, 80).otherwise(100), 6)
    out.one(
        F.when(F.length(F.trim(summary)) < 20, entry("formatting", "summary", None, said, "Write a summary of 50 words.", "medium")).otherwise(entry("formatting", "education", None, "(No education)", "Name your degree.", "medium")),
        (F.col("f") < 70) & ((F.length(F.trim(summary)) < 20) | (F.col("n_education") == 0)), 6,
    )
    lacking = F.filter(F.array(F.when(F.col("n_projects") == 0, entry("projects", "projects", None, "(No projects)", "Add a project.", "medium")), F.when(F.col("n_certifications") == 0, entry("certifications", "certifications", None, "(No certifications)", "Add a certificate.", "low"))), lambda e: e.isNotNull())
    return out.add(lacking, ~fresher & (out.size < 2)).df


def six_rules(rows: DataFrame) -> DataFrame:
    """One keyword row below 70, a result and a verb in each job, a summary, projects; six."""
    out = List(rows)
    out.add(out.keywords(F.col("missing"), 1, _word), F.col("k") < 70)
    out.add(out.first_of_jobs(_BARE, _tail), room=6)
    out.add(out.first_of_jobs(_WEAK, _verb("weak_verb", "medium"), free=True), F.col("a") < 70, room=6)
    out.one(entry("summary", "summary", None, F.col("summary"), "Write a summary.", "medium"), F.length("summary") < 50, 6)
    return out.one(entry("projects", "projects", None, "(missing)", "Add a project.", "medium"), F.col("n_projects") == 0, 6).df


def refined(rows: DataFrame) -> DataFrame:
    """One row of each kind at most, each bullet once, at least what the sections lack; six, by priority."""
    out = List(rows)
    words = F.slice(_NO_SOFT(F.slice("missing", 1, 3)), 1, 2)
    joined = F.array_join(F.transform(words, lambda x: x["keyword"]), ", ")
    out.one(entry("skills", "skills", None, "Skills section", joined, "high"), (F.col("k") < 60) & (F.size(words) > 0))
    out.add(out.bullets(_BARE, _tail, 1))
    out.add(out.bullets(_WEAK, _verb("weak_verb", "medium"), 1, free=True), F.col("a") < 70)
    summary = F.col("summary")
    better = F.when((F.length(summary) > 0) & (F.col("n_skills") > 0), F.concat(summary, F.lit(" Add what you build."))).when(F.length(summary) < 30, "Write a summary.").otherwise(summary)
    out.one(entry("summary", "summary", None, summary, better, "medium"), (F.length(summary) < 50) & (better != summary))
    out.one(entry("skill_organization", "skills", None, "Skills section", "Group the skills.", "medium"), (F.col("c") < 80) & (F.col("n_skills") > 0))
    long = out.bullets(lambda b: (b["n"] > 180) & b["sentences"], lambda b: entry("readability", "experience", b["pos"], b["text"], "Make two of it.", "low"), 1, free=True)
    out.add(long, F.col("r") < 75, room=6)
    lacking = F.filter(F.array(F.when(F.col("n_projects") == 0, entry("projects", "projects", None, "(No projects)", "Add a project.", "medium")), F.when(F.col("n_certifications") == 0, entry("certifications", "certifications", None, "(No certifications)", "Add a certificate.", "low"))), lambda e: e.isNotNull())
    out.add(lacking, out.size < 3)
    return out.made(F.slice("l", 1, 6))


def one_of_each(rows: DataFrame) -> DataFrame:
    """One keyword below 70, one result, one verb below 70, a summary, projects, and a filler if there are fewer than three; six."""
    out = List(rows)
    out.add(out.keywords(_NO_SOFT(F.slice("missing", 1, 3)), 1, _word), F.col("k") < 70)
    out.add(out.bullets(lambda b: _BARE(b) & (b["n"] > 20), _tail, 1))
    out.add(out.bullets(_WEAK, _verb("weak_verb", "medium"), 1), F.col("a") < 70)
    summary = F.col("summary")
    better = F.when(F.length(summary) < 30, F.concat(F.lit("Tell of "), F.least(F.ceil(F.size("b") / 3) * 3, F.lit(20)).cast("string"), F.lit(" years."))).otherwise(F.concat(summary, F.lit(" Add what you build.")))
    out.one(entry("summary", "summary", None, summary, better, "medium"), F.length(summary) < 50, 6)
    out.one(entry("projects", "projects", None, "(No projects)", "Add a project.", "medium"), F.col("n_projects") == 0, 6)
    return out.one(entry("readability", "education", None, "(No certifications)", "Add a certificate.", "low"), below=3).df


def staged(rows: DataFrame) -> DataFrame:
    """Three keywords, a summary, results for strong long bullets to eight in all, weak bullets and sections to ten, and general advice for what is left without any."""
    out = List(rows)
    out.add(out.keywords(F.col("missing"), 3, _word))
    out.one(entry("summary", "summary", None, F.col("summary"), "Write what you deliver.", "high"), F.length("summary") < 100)
    out.add(out.bullets(lambda b: b["strong"] & ~b["metric"] & (b["words"] >= 8), lambda b: entry("metrics", "experience", b["pos"], b["text"], F.concat(b["text"], F.lit(" (name the result)")), "high")), room=8)
    out.add(out.bullets(_WEAK, _verb("weak_verb", "medium")), room=10)
    out.one(_section("projects", "Add projects.", "medium"), F.col("n_projects") == 0, 10)
    out.one(_section("education", "Add your degree.", "medium"), F.col("n_education") == 0, 10)
    few = (out.size == 0) | (F.col("total") >= 90)
    advice = F.array(*[entry("optimization", s, None, "", text, impact) for s, text, impact in (("experience", "Name results.", "high"), ("skills", "Match the skills.", "high"), ("experience", "Name tools.", "medium"))])
    return out.add(advice, few, room=5).df


def advisory(rows: DataFrame) -> DataFrame:
    """General advice on results, summary, keywords, weak bullets and depth."""
    out = List(rows)
    out.one(entry("impact", "experience", None, "", "Name results.", "high"))
    out.one(entry("section", "summary", None, F.col("summary"), "Write three or four sentences.", "high"), F.length("summary") < 100)
    out.one(entry("section", "summary", None, F.col("summary"), "Name achievements in it.", "medium"), (F.length("summary") >= 100) & (F.col("c") >= 80))
    names = F.array_join(F.transform(F.slice("missing", 1, 3), lambda x: x["keyword"]), ", ")
    out.one(entry("keyword", "skills", None, "", F.concat(F.lit("Add "), names), "high"), F.size("missing") > 0)
    weak = F.size(F.filter("b", lambda b: b["verb"].isNotNull()))
    out.one(entry("bullet", "experience", None, "", "Use strong verbs.", "medium"), weak > 0)
    return out.one(entry("content", "experience", None, "", "Name tools.", "medium"), F.col("c") < 90).df


def optimise(rows: DataFrame) -> DataFrame:
    """Five keywords by weight, rewritten and longer bullets, results, summary and projects; each (kind, section, text) once, twenty; advice up to two."""
    out = List(rows)
    heavy = F.transform(F.array_sort(F.transform("missing", lambda x: F.struct((-x["weight"]).alias("w"), x["rnk"].alias("r"), x["keyword"].alias("keyword")))), lambda x: x)
    out.add(F.transform(F.slice(heavy, 1, 5), lambda x: entry("keyword", "skills", None, "", x["keyword"], F.when(x["w"] <= -3, "high").otherwise("medium"))))
    out.add(out.bullets(lambda b: gates(b)["weak_bullet"] & (b["rewritten"] != F.trim(b["text"])) & (F.size(F.split(b["rewritten"], "\\s+")) >= 5), lambda b: entry("bullet", "experience", b["pos"], F.trim(b["text"]), b["expanded"], F.when(b["sure"] == "high", "high").otherwise("medium"))))
    out.add(out.bullets(lambda b: (b["words"] < 8) & (F.length(b["expanded"]) > F.greatest(b["n"], F.lit(50))), lambda b: entry("bullet", "experience", b["pos"], F.trim(b["text"]), b["expanded"], "medium")), room=15)
    out.add(out.bullets(lambda b: gates(b)["missing_metrics"] & (b["words"] >= 8), lambda b: entry("impact", "experience", b["pos"], b["text"], b["hinted"], "high")), (F.col("a") > 60) & (out.size < 15))
    out.one(_section("summary", "Write three or four sentences."), F.length("summary") < 50, 15)
    out.one(_section("projects", "Add projects."), (F.col("c") < 60) & (F.col("n_projects") == 0), 15)
    key = lambda e: F.concat_ws("\u0001", e["type"], e["section"], e["current"], F.when(e["type"] == "keyword", e["improved"]))
    first = t.bound(F.transform("l", key), lambda keys: F.filter("l", lambda e, i: F.array_position(keys, F.get(keys, i)) == i + 1))
    once = out.made(F.slice(first, 1, 20)).withColumnRenamed("l", "once")
    return advisory(once).withColumn("l", F.concat("once", F.slice("l", F.lit(1), F.greatest(F.lit(0), F.lit(2) - F.size("once")))))


def guarded(rows: DataFrame, weak: dict[str, str]) -> DataFrame:
    """Five keywords, then a verb, length, or result for bullets that are not improved yet, each bullet once; summary and sections; fifteen."""
    out = List(rows)
    out.add(out.keywords(F.col("missing"), 5, _word))
    out.add(out.bullets(lambda b: gates(b)["weak_verb"] & (w.first_weak_word(b["text"], weak) != b["text"]), lambda b: entry("verb", "experience", b["pos"], b["text"], w.first_weak_word(b["text"], weak), "high")))
    out.add(out.bullets(lambda b: gates(b)["weak_bullet"] & (b["words"] < 8), lambda b: entry("clarity", "experience", b["pos"], b["text"], F.concat(b["text"], F.lit(" with significant impact.")), "medium"), free=True), room=15)
    out.add(out.bullets(lambda b: gates(b)["missing_metrics"] & (b["words"] >= 8), _tail, free=True), out.size < 15)
    out.one(_section("summary", "Write a summary."), F.length("summary") < 50)
    for name in ("skills", "projects", "education"):
        out.one(_section(name, f"Add {name}."), F.col(f"n_{name}") == 0)
    return out.made(F.slice("l", 1, 15))


def by_evaluation(rows: DataFrame, strong: list[str], contexts=w.CONTEXTS) -> DataFrame:
    """Every weak bullet and every bullet without a result; eight keywords, each in the first bullet that takes it well, else among the skills; sections.

    What placing asks of a bullet and of a keyword is found once for each; only where both allow
    it is a keyword tried, and no further than the first bullet that takes it.
    """
    missing = F.slice("missing", 1, 8)
    words = F.transform(missing, lambda m: F.struct(m["keyword"].alias("keyword"), w.keyword_kinds(m["keyword"]).alias("kinds")))
    bullets = F.transform("b", lambda b: F.struct(b["pos"].alias("pos"), b["text"].alias("text"), w.placing_signs(b["text"]).alias("signs")))
    none = F.lit(None).cast("struct<pos:int,text:string,improved:string>")

    def tried(x: Column, keyword: Column) -> Column:
        well = lambda y: F.when(y["integrated"] & (y["confidence"] != "low"), F.struct(x["pos"].alias("pos"), x["text"].alias("text"), y["improved"].alias("improved")))
        return t.bound(w.placing(x["text"], contexts), lambda found: t.bound(w.integrated(x["text"], keyword, strong, contexts, found), well))

    first = lambda bs, k: F.aggregate(bs, none, lambda found, x: F.when(found.isNotNull(), found).when(w.may_be_placed(x["signs"], k["kinds"]), tried(x, k["keyword"])))
    best = t.bound(bullets, lambda bs: F.transform(words, lambda k: first(bs, k)))
    out = List(rows.withColumn("placed", best))
    out.add(out.bullets(_WEAK, _verb("verb", "high")))
    out.add(out.bullets(lambda b: ~b["metric"], lambda b: entry("metrics", "experience", b["pos"], b["text"], None, "high")))

    def placed(x: Column, i: Column, best: Column) -> Column:
        impact = F.when(i < 3, "high").otherwise("medium")
        return F.when(best.isNotNull(), entry("keyword-integration", "experience", best["pos"], best["text"], best["improved"], impact)).otherwise(entry("keyword", "skills", None, None, x["keyword"], impact))

    out.add(t.bound(F.col("placed"), lambda known: F.transform(missing, lambda x, i: placed(x, i, F.get(known, i)))))
    for name, test in (("summary", F.length("summary") < 50), ("projects", F.col("n_projects") == 0)):
        out.one(entry("section", name, None, None, None, "medium"), test)
    return out.df


def from_templates(rows: DataFrame, templates: dict[str, list[str]], domain: Column, default: str) -> DataFrame:
    """Up to three missing keywords in a sentence of the résumé's domain; the keyword's length picks it."""
    def sentence(x: Column, lines: list[str]) -> Column:
        return F.get(F.array(*[F.replace(F.lit(y), F.lit("{}"), x["keyword"]) for y in lines]), F.length(x["keyword"]) % len(lines))

    def made(x: Column) -> Column:
        text = sentence(x, templates[default])
        for name, lines in templates.items():
            text = F.when(domain == name, sentence(x, lines)).otherwise(text)
        return entry("keyword", "experience", None, "", text, "high")

    return rows.withColumn("l", F.transform(F.slice("missing", 1, 3), made))


def exploded(rows: DataFrame) -> DataFrame:
    """(resume_id, rank, entry columns) of the lists in ``l``.

    Outer, as before an inner one Spark filters by the list's size, and that filter holds the
    whole chain put into one expression, which makes a branch anew for each bullet of the next.
    """
    places = rows.select("resume_id", F.posexplode_outer("l").alias("place", "e")).where("place IS NOT NULL")
    return places.select("resume_id", (F.col("place") + 1).alias("rank"), "e.*")
