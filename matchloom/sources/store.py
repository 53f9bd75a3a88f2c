"""Reading and writing the engine's own tables: nested documents, seeds, reports, snapshots."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in plain local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="matchloom-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/matchloom/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer splits than there are cores, else as it is.

    Large tables have many splits and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


RESUME = T.StructType([
    T.StructField("resumeId", T.LongType()),
    *_text("resumeTitle", "summary", "templateId"),
    T.StructField("personalInfo", T.StructType(_text("fullName", "email", "phone", "location"))),
    T.StructField("skills", T.StringType()),
    T.StructField("experience", T.ArrayType(T.StructType([*_text("company", "role", "startDate", "endDate"), T.StructField("bullets", T.ArrayType(T.StringType()))]))),
    T.StructField("projects", T.ArrayType(T.StructType([*_text("title", "name"), T.StructField("bullets", T.ArrayType(T.StringType()))]))),
    T.StructField("education", T.ArrayType(T.StructType(_text("institution", "school", "degree", "field")))),
    T.StructField("certifications", T.ArrayType(T.StructType(_text("name", "issuer")))),
    T.StructField("achievements", T.StringType()),
])


def parsed_resumes(rows: DataFrame, column: str = "value") -> DataFrame:
    """Résumés from JSON texts with defaults for what is absent; a text that is no JSON gives only defaults."""
    doc = F.from_json(F.col(column), RESUME)
    out = rows.select(doc.alias("d")).select("d.*")
    blank = lambda c, default: F.coalesce(F.when(F.trim(F.col(c)) != "", F.col(c)), F.lit(default))
    return out.withColumns({
        "resumeTitle": blank("resumeTitle", "Untitled Resume"),
        "templateId": blank("templateId", "classic"),
        "summary": F.coalesce("summary", F.lit("")),
        "fullName": F.coalesce("personalInfo.fullName", F.lit("Your Name")),
        "email": F.col("personalInfo.email"),
        "phone": F.col("personalInfo.phone"),
        "skills": skill_groups(F.col("skills")),
        "achievements": achievement_list(F.col("achievements")),
        "experience": F.filter(F.coalesce("experience", F.array()), lambda e: _filled(e["company"]) & _filled(e["role"]) & _filled(e["startDate"])),
        "projects": F.filter(F.transform(F.coalesce("projects", F.array()), lambda p: F.struct(F.coalesce(p["title"], p["name"]).alias("title"), F.coalesce(p["bullets"], F.array()).alias("bullets"))), lambda p: _filled(p["title"])),
        "education": F.filter(F.transform(F.coalesce("education", F.array()), lambda e: F.struct(F.coalesce(e["institution"], e["school"]).alias("institution"), e["degree"].alias("degree"))), lambda e: _filled(e["institution"]) & _filled(e["degree"])),
        "certifications": F.filter(F.coalesce("certifications", F.array()), lambda c: _filled(c["name"])),
    }).drop("personalInfo")


def _filled(value):
    return F.coalesce(F.length(F.trim(value)) > 0, F.lit(False))


GROUPS = "array<struct<category:string,items:array<string>>>"


def skill_groups(skills):
    """Groups from JSON groups, or one group ``General`` from a comma list (in JSON or plain); empty items go."""
    groups = F.from_json(skills, GROUPS)
    names = F.from_json(skills, "array<string>")
    listed = F.filter(F.transform(F.split(F.regexp_replace(skills, "^\"|\"$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    general = lambda items: F.array(F.struct(F.lit("General").alias("category"), items.alias("items")))
    empty = F.array().cast(GROUPS)
    kept = F.filter(groups, lambda g: F.size(g["items"]) > 0)
    return F.when(skills.isNull(), empty).when(skills.rlike("^\\s*\\[\\s*\\{"), F.coalesce(kept, empty)).when(skills.rlike("^\\s*\\["), general(F.coalesce(names, F.array().cast("array<string>")))).otherwise(F.when(F.size(listed) > 0, general(listed)).otherwise(empty))


def achievement_list(text):
    """Lines, or JSON strings and objects (``title: description``), without list marks, each once."""
    objects = F.from_json(text, "array<struct<title:string,description:string>>")
    named = F.transform(objects, lambda a: F.concat_ws(": ", F.nullif(F.trim(a["title"]), F.lit("")), F.nullif(F.trim(a["description"]), F.lit(""))))
    lines = F.when(text.rlike("^\\s*\\[\\s*\\{"), named).when(text.rlike("^\\s*\\["), F.from_json(text, "array<string>")).otherwise(F.split(text, "\n"))
    clean = F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, "^\\s*[-•*]+\\s*", "")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def bullets_of(resumes: DataFrame) -> DataFrame:
    """(resumeId, section, item_index, bullet_index, text) of experience and projects."""
    def part(section: str) -> DataFrame:
        items = resumes.select("resumeId", F.posexplode(section).alias("item_index", "item"))
        return items.select("resumeId", F.lit(section).alias("section"), "item_index", F.posexplode("item.bullets").alias("bullet_index", "text"))

    return part("experience").unionByName(part("projects"))


REQUIREMENT = T.StructType(_text("roleDetected", "jobTitle", "title", "companyName", "company", "jdText", "description", "content", "extractedKeywords"))


def parsed_requirements(rows: DataFrame, column: str = "value") -> DataFrame:
    """Requirements from JSON texts: title, company and description under the first filled name, keywords as plain texts."""
    rows = rows.withColumn("__d", F.from_json(F.col(column), REQUIREMENT))
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"__d.{n}"), F.lit("")) for n in names], F.lit(""))
    raw = F.col("__d.extractedKeywords")
    objects = F.transform(F.from_json(raw, "array<struct<keyword:string>>"), lambda k: k["keyword"])
    names = F.when(raw.rlike("^\\s*\\[\\s*\\{"), objects).otherwise(F.from_json(raw, "array<string>"))
    kept = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda k: F.coalesce(k != "", F.lit(False)))
    return rows.select(*[c for c in rows.columns if c not in (column, "__d")], first("roleDetected", "jobTitle", "title").alias("title"), first("companyName", "company").alias("company"), first("jdText", "description", "content").alias("description"), kept.alias("keywords"))


def seeded(rows: DataFrame, path: str) -> DataFrame:
    """A dimension written over whatever stands at ``path``, and read back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def resume_lines(resumes: DataFrame) -> DataFrame:
    """What ``features.resume_features`` takes, from parsed résumés: summary and bullets as lines, and what the sections hold."""
    bullets = F.flatten(F.transform(F.concat(F.transform("experience", lambda e: e["bullets"]), F.transform("projects", lambda p: p["bullets"])), lambda b: F.coalesce(b, F.array().cast("array<string>"))))
    return resumes.select(
        F.col("resumeId").alias("resume_id"),
        F.concat(F.array("summary"), F.filter(bullets, lambda b: _filled(b))).alias("lines"),
        _filled(F.col("email")).alias("has_email"),
        _filled(F.col("phone")).alias("has_phone"),
        F.size(F.flatten(F.transform("skills", lambda g: g["items"]))).alias("n_skills"),
        *[F.size(c).alias(f"n_{c}") for c in ("projects", "education", "certifications", "achievements")],
        F.size(F.filter("experience", lambda e: _filled(e["startDate"]) | _filled(e["endDate"]))).alias("n_dated"),
    )


def append_reports(reports: DataFrame, path: str) -> None:
    """New score reports behind the stored ones, by day."""
    reports.withColumn("created_date", F.to_date("created_at")).write.mode("append").partitionBy("created_date").parquet(path)
