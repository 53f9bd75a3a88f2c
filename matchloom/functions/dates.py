"""Dates that people type, as ``yyyy-MM``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_text(text: Column) -> Column:
    """ISO dates, MM/YYYY, month names with a year, and years (January); else empty."""
    low = F.lower(F.trim(text))
    name = F.substring(F.regexp_extract(low, "^([a-z]{3,9})\\.?,? +\\d{4}$", 1), 1, 3)
    number = F.lit(None).cast("string")
    for k, month in enumerate(MONTHS, 1):
        number = F.when(name == month, f"{k:02}").otherwise(number)
    year = F.regexp_extract(low, "(\\d{4})$", 1)
    slash = F.lpad(F.regexp_extract(low, "^(\\d{1,2})/\\d{4}$", 1), 2, "0")
    return (
        F.when(low.rlike("^\\d{4}-\\d{2}"), F.substring(low, 1, 7))
        .when(low.rlike("^\\d{1,2}/\\d{4}$"), F.concat_ws("-", year, slash))
        .when(number.isNotNull(), F.concat_ws("-", year, number))
        .when(low.rlike("^\\d{4}$"), F.concat(low, F.lit("-01")))
        .otherwise("")
    )
