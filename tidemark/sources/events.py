"""Event documents (one JSON file each) to silver tables, with a ledger of what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import durable, exists

_CARD = "array<struct<Count:int,CardName:string>>"
SCHEMA = (
    "Tournament struct<Name:string,Date:string,Uri:string,Formats:string>,"
    f"Decks array<struct<Player:string,Result:string,AnchorUri:string,Mainboard:{_CARD},Sideboard:{_CARD}>>,"
    "Rounds array<struct<Player1:string,Player2:string,Result:string,RoundName:string,Matches:array<struct<Player1:string,Player2:string,Result:string>>>>,"
    "Standings array<struct<Rank:int,Player:string,Points:int,Wins:int,Losses:int,Draws:int>>,_corrupt_record string"
)
ONLINE, PAPER = ("mtgo", "online", "brightgate"), ("paper", "melee", "tablefour", "larkhall")


def provenance(source: Column, uri: Column) -> Column:
    """online, paper or unknown, by the source folder, else by the host."""
    host = F.lower(F.coalesce(F.regexp_extract(uri, r"^https?://([^/]+)", 1), F.lit("")))
    hit = lambda words: F.lower(source).rlike("|".join(words)) | host.rlike("|".join(words))
    return F.when(hit(ONLINE), "online").when(hit(PAPER), "paper").otherwise("unknown")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parsed events with path, content hash, source folder and stable id; unreadable files keep only _corrupt_record.

    The id is the URI, else source, name, date and a hash of the sorted players.
    """
    raw = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("path"))
    hashes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path).select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("content_hash"))
    src = F.coalesce(F.nullif(F.regexp_extract("path", r"Tournaments/([^/]+)/", 1), F.lit("")), F.lit("local"))
    players = F.array_sort(F.coalesce(F.transform("Decks", lambda d: F.coalesce(d["Player"], F.lit(""))), F.array().cast("array<string>")))
    t = F.col("Tournament")
    made = F.concat_ws(":", src, F.coalesce(t["Name"], F.lit("")), F.coalesce(t["Date"], F.lit("")), F.substring(F.sha1(F.array_join(players, "|")), 1, 8))
    return raw.join(hashes, "path", "left").select(
        "*", src.alias("source"), F.coalesce(F.nullif(t["Uri"], F.lit("")), made).alias("tournament_id"), provenance(src, F.coalesce(t["Uri"], F.lit(""))).alias("provenance")
    )


def silver(events: DataFrame) -> dict[str, DataFrame]:
    """tournaments, decks, deck_cards, rounds (flat or nested) and standings of readable events."""
    e = events.where("_corrupt_record is null and Tournament is not null")
    text = lambda c: F.coalesce(c, F.lit(""))
    decks = e.select("tournament_id", F.posexplode("Decks").alias("deck_idx", "d"))
    board = lambda b, c: decks.select("tournament_id", "deck_idx", F.lit(b).alias("board"), F.explode(f"d.{c}").alias("x"))
    cards = board("main", "Mainboard").union(board("side", "Sideboard"))
    flat = F.flatten(F.transform("Rounds", lambda r: F.when(r["Matches"].isNotNull(), r["Matches"]).otherwise(F.array(F.struct(r["Player1"].alias("Player1"), r["Player2"].alias("Player2"), r["Result"].alias("Result"))))))
    return {
        "tournaments": e.select(F.col("tournament_id").alias("id"), text(F.col("Tournament.Name")).alias("name"), F.col("Tournament.Date").alias("date"), F.col("Tournament.Uri").alias("uri"), one_format(F.col("Tournament.Formats")).alias("format"), "source", "provenance"),
        "decks": decks.select("tournament_id", "deck_idx", text(F.col("d.Player")).alias("player"), text(F.col("d.Result")).alias("result")),
        "deck_cards": cards.select("tournament_id", "deck_idx", "board", F.col("x.CardName").alias("name"), F.coalesce("x.Count", F.lit(1)).alias("count")),
        "rounds": e.select("tournament_id", F.posexplode(flat).alias("match_idx", "m")).select("tournament_id", "match_idx", text(F.col("m.Player1")).alias("player1"), text(F.col("m.Player2")).alias("player2"), text(F.col("m.Result")).alias("result")),
        "standings": e.select("tournament_id", F.explode("Standings").alias("s")).select(
            "tournament_id", F.coalesce("s.Rank", F.lit(0)).alias("rank"), text(F.col("s.Player")).alias("player"), *[F.coalesce(f"s.{c}", F.lit(0)).alias(c.lower()) for c in ("Points", "Wins", "Losses", "Draws")]
        ),
    }


def ingest(spark: SparkSession, path: str, warehouse: str, full: bool = False) -> dict[str, int]:
    """Read new and changed files into the warehouse and note them in the ledger; returns numbers by status.

    The files are parsed once. Tables carry the id of the run and are appended before the ledger, which is written last
    and in one piece: rows of a run that is not in the ledger are never read, so a run that fails in between leaves nothing
    behind that counts. The rows of a changed event replace the earlier ones (see read_silver). A file that cannot be
    parsed is noted as bad, is tried again each time, and never stops the run. Paths may be
    on any store that Spark can reach.
    """
    ledger_path = f"{warehouse}/ledger"
    known = spark.read.parquet(ledger_path) if exists(spark, ledger_path) else None
    ev = read_events(spark, path)
    bad = (F.col("_corrupt_record").isNotNull()) | F.col("Tournament").isNull()
    if known is not None and not full:
        latest = known.where("status <> 'bad'").groupBy("path").agg(F.max_by("content_hash", "batch").alias("old"))
        status = F.when(bad, "bad").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("content_hash"), "unchanged").otherwise("changed")
        ev = ev.join(latest, "path", "left").withColumn("status", status)
    else:
        ev = ev.withColumn("status", F.when(bad, "bad").otherwise("new"))
    ev = durable(ev)
    counts = {r["status"]: r["count"] for r in ev.groupBy("status").count().collect()}
    batch = 1 + ((known.agg(F.max("batch")).first()[0] or 0) if known is not None else 0)
    run = uuid.uuid4().hex
    fresh = ev.where("status in ('new', 'changed')")
    for name, df in silver(fresh).items():
        df.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{warehouse}/{name}")
    noted = ev.where("status <> 'unchanged'").select("path", "content_hash", "status", F.when(F.col("status") != "bad", F.col("tournament_id")).alias("tournament_id"), F.lit(batch).alias("batch"), F.lit(run).alias("run"))
    noted.coalesce(1).write.mode("append").parquet(ledger_path)
    return counts


def read_silver(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """A silver table with, of each event, only the rows of the last run in the ledger that read it."""
    df = spark.read.parquet(f"{warehouse}/{name}")
    key = "id" if name == "tournaments" else "tournament_id"
    done = spark.read.parquet(f"{warehouse}/ledger").where("tournament_id is not null")
    last = done.groupBy(F.col("tournament_id").alias(key)).agg(F.max_by("run", "batch").alias("run"))
    return df.join(last, [key, "run"]).drop("run")


def same_rows(stored_rows: DataFrame, parsed: DataFrame) -> bool:
    """Whether two tables hold the same rows, repetitions counted; used to seed a ledger over rows loaded before."""
    cols = sorted(parsed.columns)
    a, b = stored_rows.select(*cols), parsed.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def one_format(value: Column) -> Column:
    """Format of an event from a plain string or a JSON list: Legacy if the list names it, else its first item."""
    items = F.from_json(value, "array<string>")
    return F.when(value.rlike(r"^\s*\["), F.when(F.array_contains(items, "Legacy"), "Legacy").otherwise(F.get(items, F.lit(0)))).otherwise(value)
