"""Every query of the library over the star-schema tables: name, plan, and the equivalent SQL where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import betting, chemistry, evaluate, features, markets, models, ratings, squads, temporal
from ..sources import schemas
from ..sources.adapters import load
from . import oracles as sql
from . import pipeline

CRUDE_DRAWS = 0.2
STALE, LIVE, TOP = 5, 25, 3  # small, so that the limits decide many rows
RHO = -0.05
BLEND = {"home_win": 0.487130713, "draw": 0.291716177, "away_win": 0.22115311}  # no edge lies on a threshold


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def over(*names: str):
    """A query over adapter tables."""

    def wrap(build: Callable[..., DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(*[load(spark, sf_dir, n) for n in names]))

        return query

    return wrap


@over("matches")
def labels(m):
    return features.add_labels(m).select("match_id", "date", "home_team", "away_team", "target", "is_neutral")


@over("matches")
def competitive_recent(m):
    last = m.agg(F.max("date").alias("_d"))
    return pipeline.competitive_only(m).crossJoin(F.broadcast(last)).where(F.col("date") >= F.add_months("_d", -12 * 3)).select("match_id", "date", "tournament")


@over("matches")
def time_split(m):
    n = m.groupBy("date").agg(F.count("*").alias("c"))  # a row for each day carries the order; days are few
    before = n.withColumn("_start", F.coalesce(F.sum("c").over(Window.partitionBy().orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = m.agg(F.count("*").alias("_n"))
    placed = m.join(F.broadcast(before.select("date", "_start")), "date").crossJoin(F.broadcast(total))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("date").orderBy("match_id"))
    return placed.select("match_id", F.when(place <= F.floor(F.col("_n") * 0.8), "train").otherwise("test").alias("part"))


@over("matches")
def tournament_rules(m):
    t = F.col("tournament")
    tagged = m.select(t, rules.k_factor(t).alias("k"), rules.confederation(t).alias("confed"), rules.match_type(t).alias("kind"), rules.is_competitive(t).alias("competitive"))
    return tagged.groupBy("tournament", "k", "confed", "kind", "competitive").agg(F.count("*").alias("n"))


@over("matches")
def form_last10(m):
    return features.add_form(m).select("match_id", *[f"{c}_{s}" for c in features.FORM for s in ("home", "away")])


@over("matches")
def head_to_head(m):
    return features.add_head_to_head(m).select("match_id", "h2h_home_winrate", "h2h_home_gd", "h2h_logn")


@over("matches")
def elo(m):
    return ratings.snapshots(m).select("match_id", "elo_home", "elo_away")


@over("matches")
def elo_final(m):
    return ratings.final_state(m).select("team", "elo")


@over("matches")
def glicko(m):
    return ratings.add_ratings(m).select("match_id", "glicko_diff", "glicko_unc", "glicko_exp")


@over("matches")
def glicko2(m):
    return ratings.add_ratings(m, glicko2=True).select("match_id", "glicko2_diff", "glicko2_unc", "glicko2_exp", "glicko2_vol")


@over("matches")
def feature_table(m):
    return pipeline.build_features(m, start=None).select("match_id", "date", *features.FEATURES, "target")


@over("matches")
def context_features(m):
    added = features.add_context(m, features.team_confederations(m))
    return added.select("match_id", *features.CONTEXT, *[f"{s}_conf_{c}" for s in ("home", "away") for c in rules.CONTINENTAL])


@over("matches")
def team_confederations(m):
    return features.team_confederations(m)


@over("matches", "former_names")
def former_names(m, f):
    return temporal.rename_teams(m, f)[0].select("match_id", "home_team", "away_team", "renamed")


@over("matches", "series")
def market_value_asof(m, s):
    return squads.attach_market_value(m, s, STALE).select("match_id", "mv_home", "mv_away", "mv_log_home", "mv_log_away", "mv_log_diff", "mv_missing")


@over("matches", "series")
def covered_confederations(m, s):
    kept = squads.keep_covered(squads.attach_market_value(m, s, STALE), 0.33)
    return kept.groupBy("tournament").agg(F.count("*").alias("n"), F.avg(1 - F.col("mv_missing")).alias("coverage"))


@over("series")
def latest_top10(s):
    return squads.latest_best(s)


@over("series")
def aligned_names(s):
    return squads.align_names(s, {"North": "T1", "South": "T2"}).groupBy("country").agg(F.count("*").alias("n"), F.max("mv_eur").alias("mv_eur"))


@over("pool", "player_values", "injuries")
def player_asof(p, v, i):
    del i
    grid = temporal.month_grid(v)
    probes = p.select("player_id").distinct().crossJoin(F.broadcast(grid))
    return squads.player_values_asof(probes, v, LIVE).where("value_eur is not null").select("player_id", "date", "value_eur")


@over("player_values", "injuries")
def uninjured_values(v, i):
    return temporal.outside_intervals(v, i, "player_id", "date", "from_date", "end_date")


@over("player_values", "pool", "injuries")
def squad_series(v, p, i):
    return squads.squad_series(v, p, i, top_n=TOP, liveness_days=LIVE)


@over("player_values", "pool")
def squad_sums(v, p):
    return squads.squad_series(v, p, agg="sum", liveness_days=LIVE)


@over("player_values", "pool", "injuries")
def squads_without(v, p, i):
    grid = temporal.month_grid(v).where("month(date) = 1")
    gone = p.where("player_id % 4 = 0").select("country", "player_id")
    return squads.squads_on(v, p, grid, i, gone, TOP, LIVE)


@over("player_values", "pool")
def country_series(v, p):
    return squads.country_series(p.select("country", "player_id"), v, temporal.month_grid(v))


@over("matches", "editions", "player_values")
def editions_value(m, e, v):
    return squads.finalize(squads.value_from_editions(m, e, v)).select("match_id", "mv_home", "mv_away", "mv_missing")


@over("matches", "lineups", "player_values")
def lineups_value(m, lu, v):
    return squads.finalize(squads.value_from_lineups(m, lu, v)).select("match_id", "mv_home", "mv_away", "mv_missing")


@over("lineups")
def recent_caps(lu):
    return squads.recent_caps(lu, 3).groupBy("date", "team").agg(F.count("*").alias("n"), F.sum("player_id").alias("ids"))


@over("profiles")
def team_names(p):
    named = p.select("player_id", schemas.first_citizenship(F.col("citizenship")).alias("country"))
    return squads.team_name_map(p.select("player_id", "team_id"), named)


@over("transfers")
def club_spells(t):
    return chemistry.club_spells(t)


@over("transfers")
def teammate_onset(t):
    return chemistry.teammate_onset(chemistry.club_spells(t))


@over("transfers", "player_values", "pool")
def squad_chemistry(t, v, p):
    grid = temporal.month_grid(v).where("month(date) in (1, 7)")
    chosen = squads.squads_on(v, p, grid, None, None, 12, 400)
    return chemistry.chemistry(chosen, chemistry.teammate_onset(chemistry.club_spells(t)), 3)


@over("matches")
def fold_sizes(m):
    labelled = features.add_labels(m)
    dealt = evaluate.assign_folds(labelled, evaluate.fold_table(m.sparkSession, m, 3, 2, 3), 100)
    return dealt.groupBy("fold").agg(
        F.min("b0").alias("b0"),
        F.min("b1").alias("b1"),
        F.sum((F.col("part") == "train").cast("int")).alias("n_train"),
        F.sum((F.col("part") == "test").cast("int")).alias("n_test"),
        F.avg(F.when(F.col("part") == "train", (F.col("target") == 1).cast("int"))).alias("draw_rate"),
    )


def _with_proba(lo: DataFrame) -> DataFrame:
    return lo.withColumn("proba", F.array("p_home", "p_draw", 1 - F.col("p_home") - F.col("p_draw")))


def _with_losses(lo: DataFrame) -> DataFrame:
    base = evaluate.elo_baseline(F.col("elo_home") - F.col("elo_away"), F.lit(0.25))
    rows = _with_proba(lo).withColumn("base", base)
    return rows.withColumn("ll_lr", evaluate.log_loss(F.col("proba"), F.col("target"))).withColumn("ll_dc", evaluate.log_loss(F.col("base"), F.col("target")))


@over("losses")
def prediction_metrics(lo):
    return evaluate.metrics(_with_proba(lo), by=["tournament"])


@over("losses")
def elo_baseline(lo):
    rows = _with_losses(lo)
    return rows.select("match_id", F.col("base")[0].alias("home"), F.col("base")[1].alias("draw"), F.col("base")[2].alias("away"), "ll_dc", "ll_lr")


@over("losses")
def loss_slices(lo):
    return evaluate.slices(_with_losses(lo))


@over("matches")
def decay_weights(m):
    last = m.agg(F.max("date").alias("_d"))
    rows = m.crossJoin(F.broadcast(last))
    return rows.select("match_id", evaluate.time_decay(F.col("date"), F.col("_d")).alias("w_lr"), evaluate.goals_decay(F.col("date"), F.col("_d")).alias("w_dc"))


@over("odds")
def odds_unpivoted(o):
    wide = o.groupBy("match_id").pivot("outcome", ["home_win", "draw", "away_win", "over_2.5"]).agg(F.max(F.round("odds", 2).cast("string")))
    return schemas.odds_long(wide, ["match_id"], ["home_win", "draw", "away_win", "over_2.5"])


@over("odds")
def fair_odds(o):
    return betting.fair_book(o)


@over("odds")
def fair_odds_multiplicative(o):
    return betting.fair_book(o, "multiplicative")


@over("rates")
def score_matrix(r):
    return markets.score_matrix(r, RHO)


@over("rates")
def derived_markets(r):
    m = markets.score_matrix(r, RHO, markets.CUP_SCALE)
    out = markets.one_x_two(m).join(markets.totals(m, (2.5,)).withColumnsRenamed({"over_2.5": "over_25", "under_2.5": "under_25"}), "match_id")
    return out.join(markets.expected_goals(m), "match_id").join(markets.handicap(m), "match_id")


def _priced(r: DataFrame, o: DataFrame) -> DataFrame:
    blend = r.select("match_id", *[F.lit(v).alias(k) for k, v in BLEND.items()])
    return markets.priced_tails(markets.reconciled_tails(r, RHO, blend), o)


@over("rates", "odds")
def reconciled_markets(r, o):
    return _priced(r, o)


@over("rates", "odds")
def value_bets(r, o):
    return betting.find_bets(_priced(r, o))


@over("rates", "odds")
def portfolio(r, o):
    return betting.build_portfolio(betting.find_bets(_priced(r, o), 0.5, 0.05)).select("match_id", "outcome", "edge", "stake", "stake_eur", "exp_profit_eur")


@over("rates", "odds")
def portfolio_totals(r, o):
    return betting.portfolio_totals(betting.build_portfolio(betting.find_bets(_priced(r, o), 0.5, 0.05)))


@over("losses")
def linear_scores(lo):
    p = F.array(*[F.lit(x) for x in (0.0, 0.5, 0.004, 0.3, 0.0, 0.1, -0.004, -0.2, 0.2, 0.0, -0.1)])
    proba = models.linear_proba(p, ["d", "glicko_exp"])
    return lo.withColumn("d", F.col("elo_home") - F.col("elo_away")).select("match_id", proba[0].alias("home"), proba[1].alias("draw"), proba[2].alias("away"))


@over("matches")
def money_values(m):
    shown = F.concat(F.lit("€"), (F.col("match_id") % 97).cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("k", "m", "th.", ",5 mio", "x", "")]), (F.col("match_id") % 6 + 1).cast("int")))
    value = rules.money(shown)
    return m.select("match_id", value.alias("value_eur"), rules.safe_log10(value).alias("log_value"))


@over("losses")
def crude_baseline(lo):
    """Elo expectancy with a fixed share of draws."""
    base = evaluate.elo_baseline(F.col("elo_home") - F.col("elo_away"), F.lit(CRUDE_DRAWS))
    rows = lo.withColumn("proba", base)
    return evaluate.metrics(rows)


@over("profiles", "pool")
def resolved_players(p, pool):
    """Some players asked for by id, the others by name, in another case."""
    named = p.withColumn("country", F.concat(F.lit("T"), F.col("team_id").cast("string")))
    asked = named.select("country", F.when(F.col("player_id") % 2 == 0, F.col("player_id").cast("string")).otherwise(F.upper("player_name")).alias("who"))
    return squads.resolve_players(asked, p.select("player_id", "player_name"), pool.select("country", "player_id").distinct())


@over("matches")
def flags(m):
    said = F.element_at(F.array(*[F.lit(x) for x in ("1", " Yes ", "no", "", "TRUE", "f", "1.0")]), (F.col("match_id") % 7 + 1).cast("int"))
    return m.select("match_id", rules.flag(said, True).alias("yes"), rules.flag(F.when(said != "no", said), False).alias("or_no"))


def read_back(read: Callable, name: str, *columns: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A query that writes an adapter table as a CSV file with a header and reads it with one of the readers."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{schemas.scratch(spark)}/{name}-{uuid.uuid4().hex}"
        load(spark, sf_dir, name).selectExpr(*columns).write.csv(path, header=True)
        return rounded(keep(read(spark, path)))

    return query


read_results = read_back(
    schemas.load_results,
    "matches",
    *("date", "home_team", "away_team", "if(match_id % 50 = 0, null, home_score) as home_score", "concat(away_score, '.0') as away_score"),
    *("tournament", "neutral", "match_id as city"),
    keep=lambda df: df.drop("match_id"),
)
read_former_names = read_back(schemas.load_former_names, "former_names", "current", "former", "start_date", "end_date")
read_country_series = read_back(lambda spark, path: schemas.load_country_series(path, spark), "series", "country", "date", "mv_eur as squad_value_eur")
read_market_values = read_back(schemas.load_market_values, "player_values", "player_id", "unix_date(date) * 86400L as date_unix", "if(player_id % 9 = 0, 'n/a', cast(value_eur as string)) as value")
read_injuries = read_back(schemas.load_injuries, "injuries", "player_id", "from_date", "concat(end_date, ' 00:00:00') as end_date")
read_pool = read_back(schemas.load_national_pool, "pool", "player_id", "substr(country, 2) as team_id", "debut")
read_transfers = read_back(schemas.load_transfers, "transfers", "player_id", "transfer_date", "concat(to_team_id, '.0') as to_team_id", "to_team_name")
read_profiles = read_back(schemas.load_profiles, "profiles", "player_id", "player_name", "citizenship")


def read_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of a fixtures file, with the flags of their fixture."""
    path = f"{schemas.scratch(spark)}/fixtures-{uuid.uuid4().hex}"
    quoted = ["home_win", "draw", "over_2.5"]
    wide = load(spark, sf_dir, "odds").groupBy("match_id").pivot("outcome", quoted).agg(F.max("odds"))
    wide = wide.select(F.concat(F.lit("H"), "match_id").alias("home"), F.concat(F.lit("A"), "match_id").alias("away"), *[F.col(f"`{q}`") for q in quoted], F.expr("if(match_id % 3 = 0, 'no', '') as neutral"), F.expr("if(match_id % 4 = 0, 'Y', null) as wc"))
    wide.write.csv(path, header=True)
    fixtures, odds = schemas.load_fixtures(spark, path)
    return rounded(odds.join(fixtures, "match").select("match", "outcome", "odds", "neutral", "wc"))


def value_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of cached payloads: dates in words, milliseconds or ISO text, values as numbers or in words."""
    v = load(spark, sf_dir, "player_values")
    kind = F.col("player_id") % 3
    point = F.struct(
        F.when(kind == 0, F.date_format("date", "MMM d, yyyy")).alias("datum_mw"),
        F.when(kind == 1, (F.unix_date("date").cast("long") * 86_400_000).cast("string")).when(kind == 2, F.col("date").cast("string")).alias("x"),
        F.when(F.col("player_id") % 2 == 0, F.col("value_eur").cast("double")).alias("y"),
        F.concat(F.lit("€"), (F.floor(F.col("value_eur") / 1000)).cast("string"), F.lit("k")).alias("mw"),
    )
    payload = v.select("player_id", F.to_json(F.struct(F.array(point).alias("list"))).alias("text"))
    read = payload.select("player_id", F.from_json("text", schemas.PAYLOAD).alias("p")).select("player_id", F.explode("p.list").alias("v"))
    return rounded(schemas.parse_value_history(read))


def backtest_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test match's losses by the goals model and the regression."""
    table = pipeline.build_features(load(spark, sf_dir, "matches"), start=None)
    return rounded(pipeline.backtest(table, train_years=3, least_train=100)[1])


def walk_forward_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pipeline.build_features(load(spark, sf_dir, "matches"), start=None)
    return rounded(pipeline.walk_forward(table, train_years=3, least_train=100).folds)


def backtest_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pipeline.build_features(load(spark, sf_dir, "matches"), start=None)
    return rounded(pipeline.backtest(table, train_years=3, least_train=100)[0])


def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pipeline.build_features(load(spark, sf_dir, "matches"), start=None)
    return rounded(pipeline.compare_models(table, ("hgb",), months=12, train_years=3, least_train=100))


def predicted_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = load(spark, sf_dir, "matches")
    predictor = pipeline.Predictor(history.where("date < date'2001-01-01'"), train_years=3)
    fixtures = history.where("date >= date'2001-01-01'").select("match_id", "date", "home_team", "away_team", "neutral", "tournament", (F.col("tournament") == "FIFA World Cup").alias("wc"))
    return rounded(predictor.markets(fixtures, load(spark, sf_dir, "odds")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "labels": labels,
    "competitive_recent": competitive_recent,
    "time_split": time_split,
    "tournament_rules": tournament_rules,
    "form_last10": form_last10,
    "head_to_head": head_to_head,
    "elo": elo,
    "elo_final": elo_final,
    "glicko": glicko,
    "glicko2": glicko2,
    "features": feature_table,
    "context_features": context_features,
    "team_confederations": team_confederations,
    "former_names": former_names,
    "market_value_asof": market_value_asof,
    "covered_confederations": covered_confederations,
    "latest_top10": latest_top10,
    "aligned_names": aligned_names,
    "player_asof": player_asof,
    "uninjured_values": uninjured_values,
    "squad_series": squad_series,
    "squad_sums": squad_sums,
    "squads_without": squads_without,
    "country_series": country_series,
    "editions_value": editions_value,
    "lineups_value": lineups_value,
    "recent_caps": recent_caps,
    "team_names": team_names,
    "club_spells": club_spells,
    "teammate_onset": teammate_onset,
    "squad_chemistry": squad_chemistry,
    "fold_sizes": fold_sizes,
    "prediction_metrics": prediction_metrics,
    "elo_baseline": elo_baseline,
    "loss_slices": loss_slices,
    "decay_weights": decay_weights,
    "odds_unpivoted": odds_unpivoted,
    "fair_odds": fair_odds,
    "fair_odds_multiplicative": fair_odds_multiplicative,
    "score_matrix": score_matrix,
    "derived_markets": derived_markets,
    "reconciled_markets": reconciled_markets,
    "value_bets": value_bets,
    "portfolio": portfolio,
    "portfolio_totals": portfolio_totals,
    "linear_scores": linear_scores,
    "money_values": money_values,
    "crude_baseline": crude_baseline,
    "resolved_players": resolved_players,
    "flags": flags,
    "read_results": read_results,
    "read_former_names": read_former_names,
    "read_country_series": read_country_series,
    "read_market_values": read_market_values,
    "read_injuries": read_injuries,
    "read_pool": read_pool,
    "read_transfers": read_transfers,
    "read_profiles": read_profiles,
    "read_fixtures": read_fixtures,
    "value_history": value_history,
    "walk_forward_lr": walk_forward_lr,
    "backtest_losses": backtest_losses,
    "backtest_blends": backtest_blends,
    "boosted_trees": boosted_trees,
    "predicted_markets": predicted_markets,
}


def oracles() -> dict[str, str]:
    return sql.all_oracles(STALE, LIVE, TOP, RHO, BLEND, CRUDE_DRAWS)
