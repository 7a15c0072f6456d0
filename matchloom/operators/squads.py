"""Squad values: player values as of a day, gathered by country, match or roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import confederation, safe_log10
from .temporal import asof_join, month_grid, outside_intervals

STALENESS_DAYS, LIVENESS_DAYS = 550, 540

# results' spelling of a country to that of the players' profiles, where they differ.
NAME_ALIAS = {
    "Ivory Coast": "Cote d'Ivoire",
    "South Korea": "Korea, South",
    "North Korea": "Korea, North",
    "China PR": "China",
    "Bosnia and Herzegovina": "Bosnia-Herzegovina",
    "Curaçao": "Curacao",
    "Hong Kong": "Hongkong",
    "Turkey": "Türkiye",
    "Gambia": "The Gambia",
    "Republic of Ireland": "Ireland",
    "Taiwan": "Chinese Taipei",
    "New Caledonia": "Neukaledonien",
    "Saint Kitts and Nevis": "St. Kitts & Nevis",
    "Saint Martin": "Saint-Martin",
    "Saint Lucia": "St. Lucia",
    "Saint Vincent and the Grenadines": "St. Vincent & Grenadinen",
    "São Tomé and Príncipe": "Sao Tome and Principe",
    "South Sudan": "Southern Sudan",
}


def align_names(series: DataFrame, alias: dict[str, str] | None = None, column: str = "country") -> DataFrame:
    """Profiles' spelling back to the results' spelling; other names pass through."""
    alias = NAME_ALIAS if alias is None else alias
    pairs = [F.lit(x) for profile, result in sorted((v, k) for k, v in alias.items()) for x in (profile, result)]
    return series.withColumn(column, F.coalesce(F.create_map(*pairs)[F.col(column)], column)) if pairs else series


def attach_market_value(matches: DataFrame, series: DataFrame, max_staleness_days: int = STALENESS_DAYS) -> DataFrame:
    """Both sides' squad value as of the day before the match at the latest, with logs, difference and missing flag.

    One as-of join over the (match, side) rows serves both sides.
    """
    sides = matches.select("match_id", "date", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("country")) for s, c in ((0, "home_team"), (1, "away_team"))])))
    valued = asof_join(sides, series.select("country", "date", "mv_eur"), ["country"], "mv_eur", tolerance_days=max_staleness_days)
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("mv_eur")))
    wide = valued.groupBy("match_id").agg(pick(0).alias("mv_home"), pick(1).alias("mv_away"))
    return finalize(matches.join(wide, "match_id"))


def finalize(df: DataFrame) -> DataFrame:
    """Logs of ``mv_home`` and ``mv_away``, their difference, and whether it is missing."""
    out = df.withColumn("mv_log_home", safe_log10(F.col("mv_home"))).withColumn("mv_log_away", safe_log10(F.col("mv_away")))
    out = out.withColumn("mv_log_diff", F.col("mv_log_home") - F.col("mv_log_away"))
    return out.withColumn("mv_missing", F.col("mv_log_diff").isNull().cast("int"))


def player_values_asof(probes: DataFrame, values: DataFrame, tolerance_days: int | None = None) -> DataFrame:
    """``probes`` (player_id, date, ...) with each player's value on the day, facts of that day included."""
    return asof_join(probes, values, ["player_id"], "value_eur", strict=False, tolerance_days=tolerance_days)


def country_series(squads: DataFrame, values: DataFrame, dates: DataFrame) -> DataFrame:
    """``country, date, squad_value_eur``: sums of the squads' (country, player_id) values on ``dates``."""
    valued = player_values_asof(squads.crossJoin(F.broadcast(dates)), values)
    return valued.groupBy("country", "date").agg(F.sum("value_eur").alias("squad_value_eur")).where("squad_value_eur is not null")


def first_debuts(pool: DataFrame) -> DataFrame:
    """One row for each country and player: the earliest known debut."""
    return pool.groupBy("country", "player_id").agg(F.min("debut").alias("debut"))


def value_spans(values: DataFrame) -> DataFrame:
    """``player_id, date, until, value_eur``: each value with the last day before the next one, null if none comes."""
    points = values.where(F.col("value_eur").isNotNull()).groupBy("player_id", "date").agg(F.max("value_eur").alias("value_eur"))
    return points.withColumn("until", F.date_sub(F.lead("date").over(Window.partitionBy("player_id").orderBy("date")), 1))


def live_values(values: DataFrame, grid: DataFrame, liveness_days: int) -> DataFrame:
    """``player_id, date, value_eur`` on the days of ``grid`` on which a player has a value of at most that age: each
    value is carried forward to its own days, until the next one or its end, so days without any make no rows."""
    until = value_spans(values).withColumn("_until", F.least(F.date_add("date", liveness_days), "until"))
    days = F.broadcast(grid.agg(F.collect_set("date").alias("_days")))  # one row
    carried = F.filter("_days", lambda d: (d >= F.col("date")) & (d <= F.col("_until")))
    return until.crossJoin(days).select("player_id", F.explode(carried).alias("date"), "value_eur")


def available(pool: DataFrame, values: DataFrame, grid: DataFrame, injuries: DataFrame | None, liveness_days: int, debut_gate: bool = True) -> DataFrame:
    """Players' values on each day of ``grid``, a calendar (at most one row a month).

    Values are worked out for each player once, however many countries claim them.
    """
    players = first_debuts(pool)
    valued = live_values(values.join(players.select("player_id").distinct(), "player_id", "left_semi"), grid, liveness_days)
    if injuries is not None:
        valued = outside_intervals(valued, injuries, "player_id", "date", "from_date", "end_date")
    rows = players.join(valued, "player_id")
    return rows.where(F.col("debut").isNull() | (F.col("date") >= F.col("debut"))) if debut_gate else rows


def best(rows: DataFrame, top_n: int) -> DataFrame:
    rank = Window.partitionBy("country", "date").orderBy(F.desc("value_eur"), "player_id")
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top_n)


def squad_series(
    values: DataFrame,
    pool: DataFrame,
    injuries: DataFrame | None = None,
    agg: str = "top_n_mean",
    top_n: int = 30,
    liveness_days: int = LIVENESS_DAYS,
    grid: DataFrame | None = None,
) -> DataFrame:
    """``country, date, mv_eur`` by month: the mean of the ``top_n`` best values, or the sum of all."""
    rows = available(pool, values, month_grid(values) if grid is None else grid, injuries, liveness_days)
    if agg == "top_n_mean":
        out = best(rows, top_n).groupBy("country", "date").agg(F.avg("value_eur").alias("mv_eur"))
    elif agg == "sum":
        out = rows.groupBy("country", "date").agg(F.sum("value_eur").alias("mv_eur"))
    else:
        raise ValueError(f"unknown aggregate {agg}")
    return out.where("mv_eur > 0")


def squads_on(
    values: DataFrame, pool: DataFrame, dates: DataFrame, injuries: DataFrame | None = None, exclude: DataFrame | None = None, top_n: int = 30, liveness_days: int = LIVENESS_DAYS
) -> DataFrame:
    """The best ``top_n`` players of each country on the given days, without the excluded (country, player_id)."""
    rows = available(pool, values, dates, injuries, liveness_days, debut_gate=False)
    if exclude is not None:
        rows = rows.join(exclude, ["country", "player_id"], "left_anti")
    return best(rows, top_n).select("country", "date", "player_id", "value_eur", "rank")


def squad_value(squads: DataFrame) -> DataFrame:
    return squads.groupBy("country", "date").agg(F.avg("value_eur").alias("mv_eur"), F.count("*").alias("n_players"))


def resolve_players(asked: DataFrame, profiles: DataFrame, pool: DataFrame) -> DataFrame:
    """(country, player_id) of ``asked`` (country, who): ids, or names in any case, those of the country's pool if
    any of that name is in it."""
    by_id = asked.select("country", "who", F.col("who").try_cast("long").alias("player_id")).where("player_id is not null")
    named = profiles.select(F.lower(F.trim("player_name")).alias("name"), "player_id")
    by_name = asked.where(F.col("who").try_cast("long").isNull()).join(named, F.lower(F.trim("who")) == F.col("name")).drop("name")
    by_name = by_name.join(pool.select("country", "player_id", F.lit(1).alias("in_pool")).distinct(), ["country", "player_id"], "left")
    any_in = F.max(F.coalesce("in_pool", F.lit(0))).over(Window.partitionBy("country", "who"))
    by_name = by_name.withColumn("_any", any_in).where((F.col("_any") == 0) | (F.col("in_pool") == 1))
    return by_id.select("country", "player_id").unionByName(by_name.select("country", "player_id")).distinct()


def _on_match_days(matches: DataFrame, summed: DataFrame) -> DataFrame:
    """``matches`` with both sides' ``v`` of ``summed`` (date, team, v): one row for each day holds its teams' sums."""
    entry = F.struct("team", "v")
    days = summed.where("team is not null and v is not null").groupBy("date").agg(F.map_from_entries(F.collect_list(entry)).alias("_of"))
    joined = matches.join(days, "date", "left")
    return joined.withColumn("mv_home", F.col("_of")[F.col("home_team")]).withColumn("mv_away", F.col("_of")[F.col("away_team")]).drop("_of")


def value_from_editions(matches: DataFrame, editions: DataFrame, values: DataFrame) -> DataFrame:
    """Sums over players whose [start, end] spell with the team holds the match day; overlapping spells count twice.

    A team's sum on a day is the same for all its matches of the day, so spells are cut where values change, summed
    by team and day, and only then joined to matches. Days outside of the matches' first and last make no rows.
    """
    e = editions.select(F.col("country").alias("team"), F.col("start").alias("_a"), F.col("end").alias("_b"), "player_id")
    played = F.broadcast(matches.agg(F.min("date").alias("_first"), F.max("date").alias("_last")))  # one row
    cut = e.join(value_spans(values), "player_id").crossJoin(played).where("_first is not null and _a is not null and _b is not null")
    cut = cut.select("team", "value_eur", F.greatest("_a", "date", "_first").alias("_a"), F.least("_b", "until", "_last").alias("_b")).where("_a <= _b")
    lived = cut.select("team", "value_eur", F.explode(F.sequence("_a", "_b")).alias("date"))
    return _on_match_days(matches, lived.groupBy("date", "team").agg(F.sum("value_eur").alias("v")))


def value_from_lineups(matches: DataFrame, lineups: DataFrame, values: DataFrame) -> DataFrame:
    """Sums over the players of the team's lineup of the match day; a lineup is valued once for all its matches."""
    called = lineups.select("player_id", F.to_date("date").alias("date"), "team")
    summed = player_values_asof(called, values).groupBy("date", "team").agg(F.sum("value_eur").alias("v"))
    return _on_match_days(matches, summed)


def recent_caps(lineups: DataFrame, n_matches: int = 10) -> DataFrame:
    """``date, team, player_id``: who played in the team's last ``n_matches`` match days before each of them."""
    days = lineups.groupBy("team", F.to_date("date").alias("date")).agg(F.collect_set("player_id").alias("players"))
    prior = Window.partitionBy("team").orderBy("date").rowsBetween(-n_matches, -1)
    gathered = days.withColumn("_seen", F.array_distinct(F.flatten(F.collect_list("players").over(prior))))
    return gathered.select("date", "team", F.explode("_seen").alias("player_id"))


def team_name_map(pool: DataFrame, profiles: DataFrame, min_purity: float = 0.6, min_players: int = 5) -> DataFrame:
    """``team_id, country``: a team's most common first citizenship, if it is common enough; ties by name."""
    counts = pool.select("player_id", "team_id").join(profiles.select("player_id", "country").dropna(), "player_id").groupBy("team_id", "country").count()
    named = counts.groupBy("team_id").agg(F.min(F.struct((-F.col("count")).alias("c"), "country")).alias("best"), F.sum("count").alias("n"))
    share = -F.col("best.c") / F.col("n")
    return named.where((F.col("n") >= min_players) & (share >= min_purity)).select("team_id", "best.country")


def coverage(matches: DataFrame, window: Column | None = None) -> DataFrame:
    """``confed, coverage, n``: the share of matches with market values, over the rows of ``window``."""
    scope = matches if window is None else matches.where(window)
    return scope.groupBy(confederation(F.col("tournament")).alias("confed")).agg(F.avg(1 - F.col("mv_missing")).alias("coverage"), F.count("*").alias("n"))


def keep_covered(matches: DataFrame, threshold: float = 0.5, window: Column | None = None) -> DataFrame:
    """Matches of confederations whose coverage reaches the threshold; there are nine labels at most."""
    kept = F.broadcast(coverage(matches, window).where(F.col("coverage") >= threshold).select(F.col("confed").alias("_confed")))
    return matches.join(kept, confederation(F.col("tournament")) == F.col("_confed"), "left_semi")


def latest_best(series: DataFrame, n: int = 10) -> DataFrame:
    """The countries with the ``n`` highest latest values."""
    last = series.groupBy("country").agg(F.max(F.struct("date", "mv_eur")).alias("l")).select("country", "l.date", "l.mv_eur")
    return last.orderBy(F.desc("mv_eur"), "country").limit(n)
