"""Lists as text: reading and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line of a list: number, optional x, name.
LINE = r"^([0-9]{1,3})x? +([^0-9 ].*)$"


def parse_lists(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, board, copies, name): the list lines of each text; from a line 'Sideboard' on they are on the side.
    Other lines are passed over; null texts give no rows."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    d = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), lines.alias("l"))
    cut = F.array_min(F.transform(F.filter(F.transform("l", lambda x, i: F.named_struct(F.lit("i"), i, F.lit("x"), x)), lambda s: F.lower(s["x"]).rlike(r"^sideboard:?[\s\u00a0]*$")), lambda s: s["i"]))
    d = d.select("id", cut.alias("cut"), F.posexplode("l").alias("i", "line")).where(F.col("line").rlike(LINE))
    return d.select("id", F.when(F.col("i") > F.col("cut"), "side").otherwise("main").alias("board"), F.regexp_extract("line", LINE, 1).cast("int").alias("copies"), F.regexp_extract("line", LINE, 2).alias("name"))


def format_lists(df: DataFrame) -> DataFrame:
    """(id, text): lists from (id, board, name, copies), copies descending and names ascending, sideboard behind."""
    line = lambda x: F.concat_ws(" ", x["copies"].cast("string"), x["name"])

    def part(board: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("board") == board, F.struct((-F.col("copies")).alias("o"), "name", "copies"))))
        return F.array_join(F.transform(rows, line), "\n")

    g = df.groupBy("id").agg(part("main").alias("m"), part("side").alias("s"))
    return g.select("id", F.concat("m", F.when(F.length("s") > 0, F.concat(F.lit("\n\nSideboard\n"), "s")).otherwise("")).alias("text"))
