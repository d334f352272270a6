"""Catalogue of cards: faces as aliases, lookup, difference of two loads; announcements and releases."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FACE = "struct<name:string,mana_cost:string,type_line:string,oracle_text:string,colors:array<string>,power:string,toughness:string>"
SCHEMA = f"name string, mana_cost string, cmc double, type_line string, oracle_text string, layout string, colors array<string>, produced_mana array<string>, power string, toughness string, card_faces array<{_FACE}>"
# Layouts that are no cards of the game, and those whose faces have colours and types of their own.
NO_CARD = ("token", "double_faced_token", "emblem", "art_series", "scheme", "planar", "vanguard")
OWN_FACES = ("transform", "modal_dfc", "reversible_card")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Card documents of a JSON array or of JSON lines."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def _land(types: Column) -> Column:
    return F.coalesce(types.rlike(r"(?i)\bland\b"), F.lit(False))


def union_colors(card_colors: Column, faces: Column) -> Column:
    """Sorted colours of a card and all its faces."""
    of_faces = F.flatten(F.transform(F.coalesce(faces, F.array().cast(f"array<{_FACE}>")), lambda f: F.coalesce(f["colors"], F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(card_colors, F.array().cast("array<string>")), of_faces)))


def load_cards(cards: DataFrame) -> DataFrame:
    """(name, mana_cost, cmc, type_line, oracle_text, layout, colors, produced_mana, power, toughness, is_land, alias_of).

    Every face of a card with several is a name of its own that points to the card. Where faces are cards of their own
    sides, an alias has its face's colours and types; else the card's whole. A real card wins over an alias of the same
    name, of several aliases the first by card; repeated cards count once; cards that are none of the game are left out.
    """
    c = cards.where(F.col("name").isNotNull() & ~F.coalesce(F.col("layout").isin(*NO_CARD), F.lit(False)))
    whole = union_colors(F.col("colors"), F.col("card_faces"))
    text = F.coalesce("oracle_text", F.array_join(F.transform("card_faces", lambda f: f["oracle_text"]), "\n//\n"))
    base = c.select("name", "mana_cost", "cmc", "type_line", text.alias("oracle_text"), "layout", whole.alias("colors"), F.coalesce("produced_mana", F.array().cast("array<string>")).alias("produced_mana"), "power", "toughness", "card_faces")
    front = F.element_at(F.split("type_line", " // "), 1)
    real = base.withColumns({"is_land": _land(front), "alias_of": F.lit(None).cast("string")})
    f = base.where(F.size("card_faces") > 1).withColumn("f", F.explode("card_faces"))
    own = F.col("layout").isin(*OWN_FACES)
    pick = lambda n: F.coalesce(f"f.{n}", n)
    types = F.when(own, pick("type_line")).otherwise(F.col("type_line"))
    alias = f.select(
        F.col("f.name").alias("name"), pick("mana_cost").alias("mana_cost"), "cmc", pick("type_line").alias("type_line"), pick("oracle_text").alias("oracle_text"), "layout",
        F.when(own & F.col("f.colors").isNotNull(), F.array_sort("f.colors")).otherwise(F.col("colors")).alias("colors"), "produced_mana", pick("power").alias("power"), pick("toughness").alias("toughness"), "card_faces", _land(types).alias("is_land"), F.col("name").alias("alias_of"),
    ).where("name is not null and name <> alias_of")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.col("alias_of").asc_nulls_first(), "mana_cost", "oracle_text"))
    return real.unionByName(alias).withColumn("r", rank).where("r = 1").drop("r", "card_faces")


def lookup(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``names`` (.., name) with the catalogue's columns; unknown names stay with nulls."""
    return names.join(catalogue, "name", "left")


def load_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name): cards of the new load that the old one lacks."""
    return after.where("alias_of is null").select("name").join(before.select("name"), "name", "left_anti").distinct()


def write_diff(diff: DataFrame, updated_at: str, path: str) -> None:
    """The new names as one small JSON document."""
    names = F.array_sort(F.collect_set("name"))
    diff.agg(names.alias("added"), F.count(F.lit(1)).alias("n")).withColumn("updated_at", F.lit(updated_at)).coalesce(1).write.mode("overwrite").json(path)


def releases(sets: DataFrame, today: date, ahead: int = 30, back: int = 14) -> DataFrame:
    """(code, name, released, status): sets released within ``back`` days ('recent') or coming within ``ahead`` ('upcoming')."""
    d = F.date_diff(F.col("released"), F.lit(today))
    return sets.withColumn("status", F.when((d <= 0) & (d >= -back), "recent").when((d > 0) & (d <= ahead), "upcoming")).where("status is not null").select("code", "name", "released", "status")


def load_announcements(spark: SparkSession, text: str) -> DataFrame:
    """(date, card, reason) from JSON, in order; a missing field or a date that is none raises."""
    rows = []
    for e in json.loads(text):
        if not str(e.get("card", "")).strip():
            raise ValueError(f"announcement without a card: {e}")
        rows.append((date.fromisoformat(e["date"]), e["card"].strip(), e.get("reason", "")))
    return spark.createDataFrame(sorted(rows), "date date, card string, reason string")


def add_announcement(text: str, on: str, card: str, reason: str = "") -> str:
    """The JSON with one more announcement; one that is there already (date and card) changes nothing."""
    events = json.loads(text)
    date.fromisoformat(on)
    if not any(e["date"] == on and e["card"].strip().lower() == card.strip().lower() for e in events):
        events.append({"date": on, "card": card.strip(), "reason": reason})
    return json.dumps(sorted(events, key=lambda e: (e["date"], e["card"])), ensure_ascii=False, indent=1)


def announced_until(events: DataFrame, on: date) -> DataFrame:
    """(card) of all announcements up to a day."""
    return events.where(F.col("date") <= F.lit(on)).select("card").distinct()
