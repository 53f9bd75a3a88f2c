"""Nested résumés as a whole: texts cleaned by a walk over the schema, and an edit log folded onto the document.

Both are expressions on a résumé's row. A schema walk builds one nested ``transform`` for
all text leaves, and drops what a rule leaves empty; edits of a résumé meet it once, as
one array in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rewriting import sanitised

# Advice that is no content of a résumé, and measured results that are.
SUGGESTIVE = "(?i)consider(?:ing)? adding|add measurable|add.*impact|target \\d+|^add |currently \\d+,\\s*target|this suggestion|requires manual"
MEASURED = "(?m)\\d+%$|\\d+x$|\\d+\\s*(?i:million|thousand|hundred|k|m)$|\\d+\\s*\\+?\\s*(?i:users|customers|employees)$"

#: Texts that are cleaned, arrays that lose their empty texts, and groups that go when this part of theirs is empty.
CLEANED = ("summary", "skills.items", "experience.bullets", "projects.bullets", "achievements", "education.degree", "education.institution", "education.field", "certifications.name", "certifications.issuer")
PRUNED = {"skills": "items"}


def without_advice(text: Column) -> Column:
    """The trimmed text; empty if it is advice without a measured result. Null stays null."""
    out = F.regexp_replace(text, "^\\s+|\\s+$", "")
    return F.when(out.rlike(SUGGESTIVE) & ~out.rlike(MEASURED), F.lit("")).otherwise(out)


def walked(column: Column, kind: T.DataType, path: str, cleaned: tuple[str, ...], clean, pruned: dict[str, str]) -> Column:
    """``column`` with ``clean`` applied to every text whose path (``experience.bullets``) is in ``cleaned``.

    Arrays of cleaned texts lose empty and null ones; elements of an array in ``pruned`` go
    when the named array of theirs is empty or null. Null structs and arrays stay null.
    """
    if isinstance(kind, T.StringType):
        return clean(column) if path in cleaned else column
    if isinstance(kind, T.StructType):
        fields = [walked(column[f.name], f.dataType, f"{path}.{f.name}", cleaned, clean, pruned).alias(f.name) for f in kind]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        if not any(x == path or x.startswith(f"{path}.") for x in cleaned):
            return column
        out = F.transform(column, lambda x: walked(x, kind.elementType, path, cleaned, clean, pruned))
        if isinstance(kind.elementType, T.StringType):
            return F.filter(out, lambda x: F.coalesce(x != "", F.lit(False)))
        if path in pruned:
            return F.filter(out, lambda x: F.coalesce(F.size(x[pruned[path]]) > 0, F.lit(False)))
        return out
    return column


def sanitised_resumes(resumes: DataFrame, cleaned: tuple[str, ...] = CLEANED, clean=without_advice, pruned: dict[str, str] = PRUNED) -> DataFrame:
    """``resumes`` with the texts of all nested columns cleaned; columns and types stay, other texts too."""
    return resumes.select(*[walked(F.col(f.name), f.dataType, f.name, cleaned, clean, pruned).alias(f.name) for f in resumes.schema])


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere: what edits build and what they keep then have one type."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind])
    return kind


#: The parts of a document that edits change.
PARTS = ("summary", "skills", "experience", "projects", "education", "certifications")


def _put(items: Column, index: Column, new) -> Column:
    return F.transform(items, lambda x, i: F.when(i == index, new(x)).otherwise(x))


def _bulleted(items: Column, edit: Column, text: Column) -> tuple[Column, Column]:
    """(items after an edit of a bullet, its outcome)."""
    at, item = edit["bullet_index"], F.get(items, edit["item_index"])
    bullets = F.coalesce(item["bullets"], F.array().cast("array<string>"))
    inside = F.coalesce((at >= 0) & (at < F.size(bullets)), F.lit(False))
    stale = inside & edit["current_text"].isNotNull() & (F.get(bullets, at) != edit["current_text"])
    outcome = F.when(item.isNull(), "invalid").when(stale, "stale").when(~inside & F.array_contains(bullets, text), "exists").otherwise("applied")
    new = F.when(inside, _put(bullets, at, lambda _: text)).otherwise(F.concat(bullets, F.array(text)))
    return F.when(outcome == "applied", _put(items, edit["item_index"], lambda x: x.withField("bullets", new))).otherwise(items), outcome


def with_edits(resumes: DataFrame, edits: DataFrame, key: str = "resume_id", clean=sanitised) -> DataFrame:
    """``resumes`` (key, PARTS, others) after ``edits`` (key, seq, section, item_index, bullet_index, current_text, improved_text).

    Edits are applied in the order of ``seq``; ``edit_log`` tells each one's outcome:
    ``applied``; ``stale``: the bullet is no longer ``current_text`` (null: any); ``exists``:
    what it adds is there; ``invalid``: no such item or section, or no text. A bullet is
    replaced if it has the index, else added to its item; skills go to the first group, or to a new
    one; a certificate without such an index is added. With ``current_text`` given, edits
    applied twice are the same as once. Null arrays count as empty.
    """
    kinds = {p: nullable(resumes.schema[p].dataType) for p in PARTS}
    empty = lambda p: F.lit("") if p == "summary" else F.array()
    first = F.struct(*[F.coalesce(F.col(p), empty(p).cast(kinds[p])).cast(kinds[p]).alias(p) for p in PARTS], F.array().cast("array<string>").cast(T.ArrayType(T.StringType(), True)).alias("log"))

    def step(doc: Column, edit: Column) -> Column:
        section, text = edit["section"], edit["improved_text"]
        filled = F.coalesce(text != "", F.lit(False))
        low = F.lower(text)
        listed = F.exists(F.flatten(F.transform(doc["skills"], lambda g: F.coalesce(g["items"], F.array().cast("array<string>")))), lambda i: F.contains(F.lower(i), low))
        group = kinds["skills"].elementType
        own = F.struct(*[{"category": F.lit("Technical Skills"), "items": F.array(text)}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in group])
        skills = F.when(F.size(doc["skills"]) > 0, _put(doc["skills"], F.lit(0), lambda g: g.withField("items", F.concat(F.coalesce(g["items"], F.array().cast("array<string>")), F.array(text))))).otherwise(F.array(own))
        jobs, of_job = _bulleted(doc["experience"], edit, clean(text))
        works, of_work = _bulleted(doc["projects"], edit, clean(text))
        school, named = F.get(doc["education"], edit["item_index"]), F.get(doc["certifications"], edit["item_index"])
        known = F.exists(doc["certifications"], lambda c: c["name"] == text)
        made = F.struct(*[{"name": text, "issuer": F.lit("")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds["certifications"].elementType])
        certified = F.when(named.isNotNull(), _put(doc["certifications"], edit["item_index"], lambda c: c.withField("name", text))).otherwise(F.concat(doc["certifications"], F.array(made)))
        outcome = (
            F.when(~filled, "invalid").when(section == "summary", "applied").when(section == "skills", F.when(listed, "exists").otherwise("applied"))
            .when(section == "experience", of_job).when(section == "projects", of_work).when(section == "education", F.when(school.isNull(), "invalid").otherwise("applied"))
            .when(section == "certifications", F.when(named.isNull() & known, "exists").otherwise("applied")).otherwise("invalid")
        )
        new = {"summary": text, "skills": skills, "experience": jobs, "projects": works, "education": _put(doc["education"], edit["item_index"], lambda x: x.withField("description", text)), "certifications": certified}
        changed = [F.when((outcome == "applied") & (section == p), new[p]).otherwise(doc[p]).cast(kinds[p]).alias(p) for p in PARTS]
        return F.struct(*changed, F.concat(doc["log"], F.array(outcome)).alias("log"))

    log = edits.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct("seq", "section", "item_index", "bullet_index", "current_text", "improved_text"))).alias("__edits"))
    met = resumes.join(log, F.col(key) == F.col("__key"), "left")
    folded = met.withColumn("__doc", F.aggregate(F.coalesce("__edits", F.array().cast(log.schema["__edits"].dataType)), first, step))
    return folded.select(*[F.col(f"__doc.{c}").alias(c) if c in PARTS else F.col(c) for c in resumes.columns], F.col("__doc.log").alias("edit_log"))
