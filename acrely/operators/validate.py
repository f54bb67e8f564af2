"""Intake checks: rows keep the list of rules they break, nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrely.functions.listing import listing_violations, request_violations


def check_listings(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", listing_violations())


def check_requests(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", request_violations())


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows without the rule list, and the quarantine with it."""
    broken = F.size("violations") > 0
    return checked.filter(~broken).drop("violations"), checked.filter(broken)


def check_signups(forms: DataFrame) -> DataFrame:
    """Normalise a signup form and name the first rule it breaks; null when it is acceptable."""
    first, last = F.trim("first_name"), F.trim("last_name")
    email = F.lower(F.trim("email"))
    problem = (
        F.when((F.coalesce(first, F.lit("")) == "") | (F.coalesce(last, F.lit("")) == ""), "name")
        .when(~F.coalesce(F.contains(email, F.lit("@")), F.lit(False)), "email")
        .when(F.coalesce(F.col("password_length"), F.lit(0)) < 6, "password")
    )
    return forms.select(
        "form_id", first.alias("first_name"), last.alias("last_name"), email.alias("email"), problem.alias("problem"))


def accept_signups(checked: DataFrame, known: DataFrame) -> DataFrame:
    """Acceptable forms whose address nobody has used, the first form per address.

    Addresses are made distinct on both sides first, so one that comes very often is one row.
    """
    good = checked.filter(F.col("problem").isNull()).drop("problem")
    rest = [c for c in good.columns if c not in ("email", "form_id")]
    first = good.groupBy("email").agg(F.min(F.struct("form_id", *rest)).alias("_first")).select("_first.*", "email")
    return first.join(known.select("email").distinct(), "email", "left_anti")
