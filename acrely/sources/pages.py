"""Listing records out of page markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _between(html: str, opening: str, tag: str) -> Column:
    return F.trim(F.regexp_extract(F.col(html), f"{opening}([^<]*)</{tag}>", 1))


def page_facts(pages: DataFrame) -> DataFrame:
    """Title, first heading and host of every page."""
    return pages.select(
        "page_id",
        _between("html", "<title>", "title").alias("title"),
        _between("html", "<h1>", "h1").alias("h1"),
        F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host"),
    )


def parse_cards(cards: DataFrame) -> DataFrame:
    """Parse result cards; `problem` names the first field that does not parse, else null.

    Prices may carry the currency sign and thousands commas. The area is the first word of its
    text and must be a plain whole number, so an area written with a comma is a bad record.
    """
    price_text = F.regexp_replace(_between("html", 'class="price">', "span"), "[,₹]", "")
    area_text = F.split(_between("html", 'class="area">', "span"), r"\s+")[0]
    parsed = cards.select(
        "card_id",
        _between("html", 'class="listing-title">', "h2").alias("title"),
        F.trim(price_text).try_cast("long").alias("price"),
        area_text.try_cast("int").alias("area_sqft"),
        _between("html", 'class="locality">', "span").alias("locality"),
    )
    problem = (
        F.when(F.col("title") == "", "title").when(F.col("price").isNull(), "price")
        .when(F.col("area_sqft").isNull(), "area").when(F.col("locality") == "", "locality")
    )
    return parsed.withColumn("problem", problem)


def split_cards(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records and quarantined ones."""
    return parsed.filter(F.col("problem").isNull()).drop("problem"), parsed.filter(F.col("problem").isNotNull())
