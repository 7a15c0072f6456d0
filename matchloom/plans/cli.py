"""Command line: a backtest from a data folder, or a portfolio from a file of fixtures and odds."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.betting import build_portfolio, find_bets, portfolio_totals
from ..operators.squads import align_names, squad_series, team_name_map
from ..sources import schemas
from .pipeline import Predictor, build_features, compare_models, walk_forward


def series_from_folder(spark: SparkSession, folder: str, injuries: bool = False):
    """The country value series from a folder of player tables."""
    at = lambda name: f"{folder}/{name}/{name}.csv"
    values, pool = schemas.load_market_values(spark, at("player_market_value")), schemas.load_national_pool(spark, at("player_national_performances"))
    names = team_name_map(pool, schemas.load_profiles(spark, at("player_profiles")))
    debut = "debut" if "debut" in pool.columns else F.lit(None).cast("date").alias("debut")
    hurt = schemas.load_injuries(spark, at("player_injuries")) if injuries else None
    return align_names(squad_series(values, pool.join(names, "team_id").select("player_id", "country", debut), hurt))


def cached_series(spark: SparkSession, folder: str, path: str, rebuild: bool = False, injuries: bool = False):
    """The series from Parquet at ``path``, made first if it isn't there or ``rebuild`` is set."""
    try:
        if not rebuild:
            return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    series_from_folder(spark, folder, injuries).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="matchloom")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("backtest")
    run.add_argument("results")
    run.add_argument("--former-names")
    run.add_argument("--data-dir")
    run.add_argument("--cache", default="country_market_value.parquet")
    run.add_argument("--rebuild", action="store_true")
    run.add_argument("--no-mv", action="store_true")
    run.add_argument("--injuries", action="store_true")
    run.add_argument("--model", choices=["lr", "hgb", "both"], default="lr")
    bet = commands.add_parser("bet")
    bet.add_argument("fixtures")
    bet.add_argument("--results", required=True)
    bet.add_argument("--mv")
    bet.add_argument("--bankroll", type=float, default=1000.0)
    bet.add_argument("--kelly", type=float, default=0.25)
    bet.add_argument("--edge", type=float, default=0.03)
    bet.add_argument("--max-exposure", type=float, default=0.25)
    bet.add_argument("--max-per-bet", type=float, default=0.2)
    bet.add_argument("--devig", choices=["shin", "multiplicative"], default="shin")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("matchloom").getOrCreate()
    history = schemas.load_results(spark, args.results)
    if args.command == "backtest":
        features = build_features(history, schemas.load_former_names(spark, args.former_names)).persist()
        series = None if args.no_mv or not args.data_dir else cached_series(spark, args.data_dir, args.cache, args.rebuild, args.injuries)
        if args.model == "both":
            compare_models(features, series=series).show(truncate=False)
        else:
            result = walk_forward(features, series, args.model)
            result.folds.orderBy("fold").show(100, truncate=False)
            result.pooled.show()
        return
    fixtures, odds = schemas.load_fixtures(spark, args.fixtures)
    predictor = Predictor(history, series=schemas.load_country_series(args.mv, spark))
    day = F.date_add(F.lit(history.agg(F.max("date").alias("d")).first()["d"]), 1)
    named = fixtures.select(F.xxhash64("match").alias("match_id"), "match", day.alias("date"), F.col("home").alias("home_team"), F.col("away").alias("away_team"), "neutral", "wc", F.lit("FIFA World Cup").alias("tournament"))
    known = predictor.known_teams().select(F.col("team").alias("_t"))
    for r in named.select(F.explode(F.array("home_team", "away_team")).alias("t")).distinct().join(known, F.col("t") == F.col("_t"), "left_anti").limit(50).collect():
        print(f"unknown team, rated as average: {r['t']}")
    priced = predictor.markets(named, odds.withColumn("match_id", F.xxhash64("match")).drop("match"))
    bets = find_bets(priced, args.kelly, args.edge, args.devig).join(named.select("match_id", "match"), "match_id")
    portfolio = build_portfolio(bets, args.bankroll, args.max_per_bet, args.max_exposure).persist()
    portfolio.orderBy(F.desc("edge")).select("match", "outcome", "p_model", "fair_p", "odds", "vs_fair", "edge", "stake_eur", "exp_profit_eur").show(200, truncate=False)
    portfolio_totals(portfolio).show()


if __name__ == "__main__":
    main()
