"""Schemas of the inputs, and readers of their CSV and JSON files."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import flag, money

RESULTS = "date DATE, home_team STRING, away_team STRING, home_score INT, away_score INT, tournament STRING, city STRING, country STRING, neutral BOOLEAN"
FORMER_NAMES = "current STRING, former STRING, start_date DATE, end_date DATE"
# The markets of a fixtures file.
MARKET_COLUMNS = [
    "home_win",
    "draw",
    "away_win",
    "over_2.5",
    "under_2.5",
    "goals_0_1",
    "goals_2_3",
    "goals_4plus",
    "hcap_home_-1",
    "hcap_draw_-1",
    "hcap_away_+1",
    "hcap_home_+1",
    "hcap_draw_+1",
    "hcap_away_-1",
]

PAYLOAD = "list ARRAY<STRUCT<datum_mw: STRING, x: STRING, y: DOUBLE, mw: STRING>>"


def scratch(spark: SparkSession) -> str:
    """A folder for files that are written to be read again: the shared one named by ``spark.checkpoint.dir``. A session
    whose executors are threads of the driver may do without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matchloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/matchloom"


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by name; each reader below casts what it needs, so order and extras don't matter."""
    return spark.read.csv(path, header=True, inferSchema=False)


def need(df: DataFrame, *columns: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def day(c: str) -> Column:
    return F.to_date(F.col(c).try_cast("timestamp_ntz"))


def with_match_id(df: DataFrame) -> DataFrame:
    """A total order for rows without one: by date and then by all that a row says."""
    order = F.struct(*[c for c in ("home_team", "away_team", "tournament", "home_score", "away_score") if c in df.columns])
    return df.withColumn("match_id", F.xxhash64("date", order))


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Matches with a result. ``neutral`` must read as a Boolean; a row with another text there is an error."""
    raw = need(csv(spark, path), "date", "home_team", "away_team", "home_score", "away_score", "tournament", "neutral")
    known = raw.select(
        F.to_date("date").alias("date"),
        "home_team",
        "away_team",
        F.col("home_score").try_cast("double").cast("int").alias("home_score"),
        F.col("away_score").try_cast("double").cast("int").alias("away_score"),
        "tournament",
        F.col("neutral").cast("boolean").alias("neutral"),
        *(["country"] if "country" in raw.columns else []),
    )
    return with_match_id(known.dropna(subset=["home_score", "away_score"]))


def load_former_names(spark: SparkSession, path: str | None) -> DataFrame:
    """Renames; without a file there are none."""
    try:
        raw = csv(spark, path) if path else None
        return spark.createDataFrame([], FORMER_NAMES) if raw is None else raw.select("current", "former", day("start_date").alias("start_date"), day("end_date").alias("end_date"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], FORMER_NAMES)
        raise


def load_country_series(source: DataFrame | str | None, spark: SparkSession | None = None) -> DataFrame | None:
    """``country, date, mv_eur`` from a table or a CSV path; ``squad_value_eur`` is another name of the value."""
    if source is None:
        return None
    df = csv(spark, source) if isinstance(source, str) else source
    if "squad_value_eur" in df.columns:
        df = df.withColumnRenamed("squad_value_eur", "mv_eur")
    return df.select("country", F.to_date("date").alias("date"), F.col("mv_eur").cast("double").alias("mv_eur"))


def polymorphic_day(df: DataFrame, column: str) -> Column:
    """Dates of a column that holds ISO text, seconds or milliseconds; which, is decided for the column as a whole."""
    number = F.col(column).try_cast("double")
    seen = df.agg(
        F.count(column).alias("n"), F.count(number).alias("numbers"), F.avg((number > 1e11).cast("int")).alias("large")
    ).first()
    if seen["n"] and seen["numbers"] == seen["n"]:
        return F.to_date(F.timestamp_millis((number if seen["large"] > 0.5 else number * 1000).cast("long")))
    return day(column)


def load_market_values(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path)
    rows = raw.select(F.col("player_id").cast("long").alias("player_id"), polymorphic_day(raw, "date_unix").alias("date"), F.col("value").try_cast("double").alias("value_eur"))
    return rows.dropna(subset=["date", "value_eur"])


def load_national_pool(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path)
    kinds = {"player_id": "long", "team_id": "long", "career_state": "string"}
    kept = [F.col(c).try_cast(k).alias(c) for c, k in kinds.items() if c in raw.columns]
    return raw.select(*kept, *([day("debut").alias("debut")] if "debut" in raw.columns else []))


def load_injuries(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path)
    return raw.select(F.col("player_id").cast("long").alias("player_id"), day("from_date").alias("from_date"), day("end_date").alias("end_date")).dropna()


def load_transfers(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path)
    return raw.select(
        F.col("player_id").cast("long").alias("player_id"),
        day("transfer_date").alias("transfer_date"),
        F.col("to_team_id").try_cast("double").cast("long").alias("to_team_id"),
        "to_team_name",
    )


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path).select(F.col("player_id").cast("long").alias("player_id"), "player_name", first_citizenship(F.col("citizenship")).alias("country"))


def first_citizenship(c: Column) -> Column:
    """The first of several, which two spaces separate."""
    first = F.trim(F.split(c, "  ")[0])
    return F.when(~first.isin("", "nan"), first)


def load_value_history(spark: SparkSession, path: str) -> DataFrame:
    """Players' values over time from cached JSON payloads, a file for each player, named by the player's id."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long").alias("player_id"), F.from_json("value", PAYLOAD).alias("p")
    )
    return parse_value_history(raw.select("player_id", F.explode("p.list").alias("v")))


def parse_value_history(points: DataFrame) -> DataFrame:
    """``player_id, date, value_eur`` from ``player_id`` and payload points ``v``."""
    x = F.col("v.x").try_cast("double")
    date = F.coalesce(
        F.to_date(F.try_to_timestamp(F.col("v.datum_mw"), F.lit("MMM d, yyyy"))),
        F.to_date(F.timestamp_millis(x.cast("long"))),
        F.to_date(F.col("v.x").try_cast("timestamp_ntz")),
    )
    return points.select("player_id", date.alias("date"), F.coalesce(F.col("v.y"), money(F.col("v.mw"))).alias("value_eur")).dropna()


def load_fixtures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Fixtures with at least one price, and their prices over 1 as rows ``home, away, outcome, odds``."""
    raw = need(csv(spark, path), "home", "away")
    markets = [c for c in MARKET_COLUMNS if c in raw.columns]
    if not markets:
        raise ValueError("no odds column")
    named = raw.withColumn("match", F.concat_ws(" vs ", "home", "away"))
    odds = odds_long(named, ["match"], markets)
    blank = F.lit(None).cast("string")
    fixtures = named.join(odds.select("match").distinct(), "match", "left_semi").select(
        "match",
        "home",
        "away",
        flag(F.col("neutral") if "neutral" in raw.columns else blank, True).alias("neutral"),
        flag(F.col("wc") if "wc" in raw.columns else blank, False).alias("wc"),
    )
    return fixtures, odds


def odds_long(wide: DataFrame, ids: list[str], markets: list[str]) -> DataFrame:
    """Prices as rows; blanks and prices of 1 or less are none."""
    cast = wide.select(*ids, *[F.col(f"`{m}`").try_cast("double").alias(m) for m in markets])
    return cast.unpivot(ids, [F.col(f"`{m}`") for m in markets], "outcome", "odds").where("odds > 1")
