"""Inventory of extension manifests held as a table ``(repo_id, manifest)``.

Menus count in the order the file lists them, so they are read as maps, which keep it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _part(name: str):
    return F.get_json_object("manifest", f"$.contributes.{name}")


def _entries(listed: str, pos: str):
    """The entries of a JSON list one by one, so that a malformed one costs no other."""
    return F.expr(f"posexplode(try_variant_get(try_parse_json({listed}), '$', 'array<variant>'))").alias(pos, "entry")


def _text(field: str):
    """A field of an entry; null unless it is text."""
    kind = f"schema_of_variant(try_variant_get(entry, '$.{field}', 'variant'))"
    return F.expr(f"if({kind} = 'STRING', try_variant_get(entry, '$.{field}', 'string'), NULL)").alias(field)


def contributed_commands(manifests: DataFrame) -> DataFrame:
    """``(repo_id, pos, command, title)`` as contributed; entries that name no command are left out."""
    listed = manifests.select("repo_id", _part("commands").alias("listed"))
    rows = listed.select("repo_id", _entries("listed", "pos"))
    return rows.select("repo_id", "pos", _text("command"), _text("title")).filter("command IS NOT NULL")


def menu_contributions(manifests: DataFrame) -> DataFrame:
    """``(repo_id, menu_pos, type, location, items)``; items are JSON text."""
    menus = F.from_json(_part("menus"), "map<string,string>")
    rows = manifests.select("repo_id", F.posexplode(menus).alias("menu_pos", "location", "items"))
    return rows.select("repo_id", "menu_pos", F.lit("menu").alias("type"), "location", "items")


def menu_items(manifests: DataFrame) -> DataFrame:
    """Items that name a command, with their conditions."""
    menus = menu_contributions(manifests)
    rows = menus.select("repo_id", "menu_pos", "location", _entries("items", "item_pos"))
    named = rows.select("repo_id", "menu_pos", "item_pos", "location", *map(_text, ("command", "when", "group")))
    return named.filter("command IS NOT NULL")


def manifest_commands(manifests: DataFrame) -> DataFrame:
    """Commands with the conditions their menu items give them.

    The last menu item wins, also where it names no condition.  Of commands contributed
    twice the first is meant.  Items for a command nobody contributed add it, titled by
    its id, behind the others.
    """
    commands = contributed_commands(manifests)
    nth = F.row_number().over(Window.partitionBy("repo_id", "command").orderBy("pos"))
    commands = commands.withColumn("nth", nth)
    place = F.struct("menu_pos", "item_pos")
    last = menu_items(manifests).groupBy("repo_id", "command").agg(
        F.max_by(F.struct("when", "group"), place).alias("given"),
        F.min(place).alias("first_seen"),
    ).withColumn("nth", F.lit(1))
    merged = commands.join(last, ["repo_id", "command", "nth"], "full")
    return merged.select(
        "repo_id", "command",
        F.when(F.col("pos").isNull(), F.col("command")).otherwise(F.col("title")).alias("title"),
        F.col("given.when").alias("when"),
        F.col("given.group").alias("group"),
        F.col("pos").isNull().alias("added"),
        F.coalesce("pos", "first_seen.menu_pos").alias("place"),
        F.when(F.col("pos").isNull(), F.col("first_seen.item_pos")).alias("item_place"),
    )


def manifest_features(manifests: DataFrame, source_folder: str = "src") -> DataFrame:
    """Commands, menus and configuration as one list of features."""
    commands = manifest_commands(manifests).select(
        "repo_id", F.lit("command").alias("type"), F.col("command").alias("name"),
        F.col("title").alias("description"), F.array(F.lit(source_folder)).alias("files"),
    )
    nothing = F.array().cast("array<string>").alias("files")
    menus = menu_contributions(manifests).select(
        "repo_id", F.lit("menu").alias("type"),
        F.concat(F.lit("Menu: "), F.col("location")).alias("name"),
        F.concat(F.lit("Context menu contributions for "), F.col("location")).alias("description"),
        nothing,
    )
    setting = _part("configuration")
    present = setting.isNotNull() & ~setting.isin("", "0", "false", "null")
    settings = manifests.filter(present).select(
        "repo_id", F.lit("configuration").alias("type"),
        F.lit("Extension Configuration").alias("name"),
        F.lit("User-configurable settings").alias("description"), nothing,
    )
    return commands.unionByName(menus).unionByName(settings)
