"""Small cases worked out by hand, and properties, of the rules that are easy to get wrong."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.functions import rules
from matchloom.operators import betting, chemistry, evaluate, markets, models, ratings, squads, temporal
from matchloom.operators.features import FEATURES
from matchloom.plans import pipeline
from matchloom.sources import schemas

D = dt.date
MATCH = "match_id long, date date, home_team string, away_team string, home_score int, away_score int, tournament string, neutral boolean"


def matches(spark, rows):
    return spark.createDataFrame(rows, MATCH)


def some_matches(spark, n=60, teams=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        h, a = rng.choice(teams, 2, replace=False)
        rows.append((i, D(2005, 1, 1) + dt.timedelta(days=int(i * 5)), f"t{h}", f"t{a}", int(rng.integers(4)), int(rng.integers(3)), "Friendly" if i % 4 == 0 else "UEFA Euro", bool(i % 3 == 0)))
    return matches(spark, rows)


def test_rules_take_the_first_match(spark):
    names = ["FIFA World Cup qualification", "UEFA Euro qualification", "UEFA Nations League", "CONCACAF Nations League", "Friendly", "Superclásico de las Américas", None]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    t = F.col("t")
    got = df.select(rules.k_factor(t), rules.confederation(t), rules.match_type(t), rules.is_competitive(t)).collect()
    assert [tuple(r) for r in got] == [
        (75.0, "World Cup qualifiers", "Qualifier", True),
        (50.0, "UEFA", "Qualifier", True),
        (40.0, "UEFA", "Continental", True),
        (30.0, "CONCACAF", "Continental", True),
        (10.0, "Other/regional", "Other competitive", False),
        (30.0, "CONMEBOL", "Other competitive", True),
        (30.0, "Other/regional", "Other competitive", True),
    ]


def test_money_and_flags(spark):
    df = spark.createDataFrame([(x,) for x in ["€2.50m", "800k", "1,2 mio", "€300Th.", "2,50 Mio.", "", None, "-"]], "s string")
    assert [r[0] for r in df.select(rules.money(F.col("s"))).collect()] == [2.5e6, 8e5, 1.2e6, 3e5, None, None, None, None]
    flags = spark.createDataFrame([(x,) for x in ["1", "1.0", "Yes", "0", "no", "", None]], "s string")
    assert [r[0] for r in flags.select(rules.flag(F.col("s"), True)).collect()] == [True, True, True, False, False, True, True]


def test_asof_strict_tolerance_is_inclusive(spark):
    probes = spark.createDataFrame([(1, "a", D(2020, 1, 10)), (2, "a", D(2020, 1, 1)), (3, "a", D(2020, 1, 6)), (4, "b", D(2020, 1, 6))], "id int, k string, date date")
    facts = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 6), 2.0), ("a", D(2020, 1, 6), 3.0), ("a", D(2020, 1, 8), None)], "k string, date date, v double")
    at = lambda **how: {r["id"]: r["v"] for r in temporal.asof_join(probes, facts, ["k"], "v", **how).collect()}
    assert at(tolerance_days=4) == {1: 3.0, 2: None, 3: None, 4: None}
    assert at(tolerance_days=5) == {1: 3.0, 2: None, 3: 1.0, 4: None}
    assert at(strict=False) == {1: 3.0, 2: 1.0, 3: 3.0, 4: None}


def test_blocks_chain_clipped_days():
    blocks = temporal.month_blocks(D(2000, 1, 1), D(2026, 3, 31), 6, 8)
    assert blocks[0] == (D(2018, 3, 31), D(2018, 9, 30)) and blocks[1][1] == D(2019, 3, 30)
    assert len(blocks) == 17 and blocks[-1] == (D(2026, 3, 30), D(2026, 9, 30))
    assert len(temporal.month_blocks(D(2000, 1, 1), D(2026, 3, 15), 6, 8)) == 16


def test_month_grid_begins_after_the_first_day(spark):
    df = spark.createDataFrame([(D(2020, 1, 2),), (D(2020, 3, 1),)], "date date")
    assert [r[0] for r in temporal.month_grid(df).orderBy("date").collect()] == [D(2020, 2, 1), D(2020, 3, 1)]
    assert temporal.month_grid(df.limit(0)).count() == 0


def test_renames_are_bounded_and_counted(spark):
    m = matches(spark, [(1, D(1990, 1, 1), "old", "x", 1, 0, "t", True), (2, D(1991, 1, 1), "x", "old", 1, 0, "t", True)])
    former = spark.createDataFrame([("new", "old", D(1980, 1, 1), D(1990, 1, 1))], schemas.FORMER_NAMES)
    out, n = temporal.rename_teams(m, former)
    assert {(r["match_id"], r["home_team"], r["away_team"]) for r in out.collect()} == {(1, "new", "x"), (2, "x", "old")}
    assert out.agg(n).first()[0] == 1


def test_elo_is_conserved_and_causal(spark):
    df = some_matches(spark)
    whole = {r["match_id"]: r for r in pipeline.build_features(df, start=None).collect()}
    early = {r["match_id"]: r for r in pipeline.build_features(df.where("match_id < 40"), start=None).collect()}
    for i, row in early.items():
        assert all(math.isclose(row[f], whole[i][f], abs_tol=1e-12) for f in FEATURES)
    assert math.isclose(ratings.final_state(df).agg(F.avg("elo")).first()[0], 1500.0, abs_tol=1e-9)


def test_ratings_continue_from_saved_state(spark):
    df = some_matches(spark)
    state = ratings.final_state(df.where("match_id < 40")).drop("pool").collect()
    after = {r["match_id"]: tuple(r) for r in ratings.snapshots(df.where("match_id >= 40"), saved=[tuple(r) for r in state]).collect()}
    whole = {r["match_id"]: tuple(r) for r in ratings.snapshots(df).collect()}
    assert all(np.allclose(after[i], whole[i]) for i in after) and len(after) == 20


def test_fixtures_do_not_see_each_other(spark):
    df = some_matches(spark)
    fx = spark.createDataFrame([(100, D(2006, 1, 1), "t0", "t1", True, "FIFA World Cup"), (101, D(2006, 1, 2), "t1", "t2", False, "Friendly"), (102, D(2006, 1, 3), "new", "t0", True, "Friendly")], "match_id long, date date, home_team string, away_team string, neutral boolean, tournament string")
    batch = {r["match_id"]: r for r in pipeline.fixture_features(df, fx).collect()}
    for i in (100, 101, 102):
        one = pipeline.fixture_features(df, fx.where(f"match_id = {i}")).first()
        appended = df.unionByName(fx.where(f"match_id = {i}").withColumns({"home_score": F.lit(0), "away_score": F.lit(0)}))
        full = pipeline.build_features(appended, start=None).where(f"match_id = {i}").first()
        for f in FEATURES:
            assert math.isclose(batch[i][f], one[f], abs_tol=1e-12) and math.isclose(batch[i][f], full[f], abs_tol=1e-12)
    with pytest.raises(ValueError):
        pipeline.fixture_features(df, fx.withColumn("date", F.lit("2005-01-05").cast("date")))


def test_glicko2_matches_the_published_example():
    # Glickman's example for the rating system, one opponent at a time instead of one period, from 1500/200/0.06
    mu, phi, sigma = ratings.glicko2_result(0.0, 200 / ratings.G2_SCALE, 0.06, (1400 - 1500) / ratings.G2_SCALE, 30 / ratings.G2_SCALE, 1.0)
    assert 1500 + ratings.G2_SCALE * mu > 1550 and ratings.G2_SCALE * phi < 200 and abs(sigma - 0.06) < 1e-3
    for delta in (0.1, 3.0, 8.0):
        s = ratings.new_volatility(0.06, 1.1, 1.7, delta)
        x, a = math.log(s * s), math.log(0.06**2)
        e, spread = math.exp(x), 1.1**2 + 1.7
        assert abs(e * (delta**2 - spread - e) / (2 * (spread + e) ** 2) - (x - a) / 0.25) < 1e-4


def test_squads_prefer_ids_and_pool_names(spark):
    profiles = spark.createDataFrame([(1, "Ann"), (2, "ann "), (3, "Bea")], "player_id long, player_name string")
    pool = spark.createDataFrame([("A", 1), ("A", 3)], "country string, player_id long")
    asked = spark.createDataFrame([("A", "ANN"), ("A", "7"), ("B", "ann")], "country string, who string")
    got = {tuple(r) for r in squads.resolve_players(asked, profiles, pool).select("country", "player_id").collect()}
    assert got == {("A", 1), ("A", 7), ("B", 1), ("B", 2)}


def test_spell_ends_count_non_clubs(spark):
    t = spark.createDataFrame([(1, D(2000, 1, 1), 5, "C"), (1, D(2001, 1, 1), 9, "Retired"), (2, D(2000, 6, 1), 5, None)], "player_id long, transfer_date date, to_team_id long, to_team_name string")
    spells = chemistry.club_spells(t)
    assert {(r["player_id"], r["end"]) for r in spells.collect()} == {(1, D(2001, 1, 1)), (2, D(2100, 1, 1))}
    assert [tuple(r) for r in chemistry.teammate_onset(spells).collect()] == [(1, 2, D(2000, 6, 1))]


def test_spells_of_one_day_and_id_have_one_order(spark):
    rows = [(1, D(2000, 1, 1), 5, "C"), (1, D(2000, 1, 1), 5, "Retired"), (1, D(2001, 1, 1), 9, "E"), (2, D(2000, 6, 1), 5, "Retired"), (2, D(2000, 6, 1), 5, None)]
    for given in (rows, rows[::-1]):
        spells = chemistry.club_spells(spark.createDataFrame(given, "player_id long, transfer_date date, to_team_id long, to_team_name string").coalesce(1))
        assert {(r["player_id"], r["club"], r["start"], r["end"]) for r in spells.collect()} == {
            (1, 5, D(2000, 1, 1), D(2001, 1, 1)), (1, 9, D(2001, 1, 1), D(2100, 1, 1)), (2, 5, D(2000, 6, 1), D(2100, 1, 1))
        }
        assert [tuple(r) for r in chemistry.teammate_onset(spells).collect()] == [(1, 2, D(2000, 6, 1))]


def test_chemistry_of_tied_spells(spark):
    rows = [(1, D(2000, 1, 1), 5, "C"), (1, D(2000, 1, 1), 5, "Retired"), (2, D(2000, 6, 1), 5, "C"), (3, D(2000, 6, 1), 6, "D")]
    squad = spark.createDataFrame([("A", D(2001, 1, 1), i) for i in (1, 2, 3)], "country string, date date, player_id long")
    for given in (rows, rows[::-1]):
        transfers = spark.createDataFrame(given, "player_id long, transfer_date date, to_team_id long, to_team_name string").coalesce(1)
        chem = chemistry.chemistry(squad, chemistry.teammate_onset(chemistry.club_spells(transfers)), 3)
        assert [round(r["chem"], 6) for r in chem.collect()] == [0.333333]


def test_onset_of_tied_spells(spark):
    rows = [(1, D(2000, 1, 1), 5, None), (1, D(2000, 1, 1), 5, "Ban"), (1, D(2000, 9, 1), 7, "E"), (2, D(2000, 3, 1), 5, "C"), (2, D(2000, 3, 1), 5, "---"), (2, D(2000, 4, 1), 6, "D")]
    for given in (rows, rows[::-1]):
        transfers = spark.createDataFrame(given, "player_id long, transfer_date date, to_team_id long, to_team_name string").coalesce(1)
        assert [tuple(r) for r in chemistry.teammate_onset(chemistry.club_spells(transfers)).collect()] == [(1, 2, D(2000, 3, 1))]


def test_form_defaults_and_window(spark):
    m = matches(spark, [(i, D(2020, 1, 1), "a", f"b{i}", i, 0, "t", True) for i in range(4)])
    from matchloom.operators.features import add_form

    got = {r["match_id"]: (r["form_gf_home"], r["form_gf_away"]) for r in add_form(m, 2).collect()}
    assert got == {0: (1.0, 1.0), 1: (0.0, 1.0), 2: (0.5, 1.0), 3: (1.5, 1.0)}


def test_markets_sum_to_one_and_reconcile(spark):
    rates = spark.createDataFrame([(1, 1.4, 1.1), (2, 0.3, 2.7)], "match_id long, lam double, mu double")
    m = markets.score_matrix(rates, -0.05)
    blend = spark.createDataFrame([(1, 0.5, 0.3, 0.2), (2, 0.1, 0.2, 0.7)], "match_id long, home_win double, draw double, away_win double")
    got = {r["match_id"]: r for r in markets.one_x_two(markets.reconcile(m, blend)).collect()}
    assert math.isclose(got[1]["home_win"], 0.5) and math.isclose(got[2]["away_win"], 0.7)
    h = markets.handicap(m, -1.0).first()
    assert math.isclose(h["home_cover"] + h["push"] + h["away_cover"], 1.0)
    odds = spark.createDataFrame([(1, "over_3", 2.0), (1, "over_2.5", 2.0), (1, "hcap_away_+1", 2.0), (1, "what_ever", 2.0)], "match_id long, outcome string, odds double")
    assert {r["outcome"] for r in markets.priced(m, blend, odds).collect()} == {"over_2.5", "hcap_away_+1"}


def test_devig_and_portfolio(spark):
    odds = spark.createDataFrame([(1, "home_win", 2.1), (1, "draw", 3.3), (1, "away_win", 4.2), (2, "draw", 3.0), (3, "home_win", 1.0), (4, "over_2.5", 5.0), (4, "under_2.5", 6.0)], "match_id long, outcome string, odds double")
    fair = betting.fair_book(odds).groupBy("match_id").agg(F.sum("fair_p").alias("s"), F.count("*").alias("n")).collect()
    assert {r["match_id"]: (round(r["s"], 9), r["n"]) for r in fair} == {1: (1.0, 3), 2: (1.0, 1), 4: (1.0, 2)}  # the book of 4 has no root
    priced = spark.createDataFrame([(i, "draw", 3.0, 0.6) for i in range(9)], "match_id long, outcome string, odds double, p double")
    folio = betting.build_portfolio(betting.find_bets(priced, 0.5, 0.05), 1000.0, 0.2, 0.7).collect()
    assert math.isclose(sum(r["stake"] for r in folio), 0.7) and folio[0]["stake_eur"] == 77.78
    half = spark.createDataFrame([(0.125,), (0.135,)], "x double").select(F.bround("x", 2)).collect()
    assert half[0][0] == 0.12
    push = betting.find_bets(spark.createDataFrame([(1, "draw", 2.0, 0.4, 0.3)], "match_id long, outcome string, odds double, p double, push double"), edge=0.0).first()
    assert math.isclose(push["edge"], 0.8 - 0.7)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4)], "x double")
    assert [r["bin"] for r in evaluate.quantile_bins(df, "x", 4).orderBy("x").collect()] == [0, 0, 1, 2, 3]
    cut = df.select(evaluate.cut(F.col("x"), [0, 1, 3], ["a", "b"])).collect()
    assert [r[0] for r in cut] == [None, "a", "b", "b", None]


def test_logit_is_optimal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = np.argmax(x @ np.array([[1.0, 0.2, -1], [0.5, 0, -0.5]]) + rng.gumbel(size=(400, 3)), axis=1)
    pdf = pd.DataFrame({"fold": 0, "part": "train", "target": y, "a": x[:, 0], "b": x[:, 1], "w": rng.uniform(0.2, 1, 400)})
    pdf.loc[::17, "a"] = np.nan
    pdf["empty"] = np.nan
    df = spark.createDataFrame(pdf.astype({"fold": "int32", "target": "int32"})).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("a", "empty")})
    model = models.fit_logit(df, ["a", "b", "empty"], F.col("w"))[0]
    assert model["converged"] and not model["use"][2]
    z = pdf[["a", "b"]].fillna(pdf[["a", "b"]].median()).to_numpy()
    z = np.hstack([(z - z.mean(0)) / z.std(0), np.zeros((400, 1))])
    sums = models.logit_sums(z, y, pdf["w"].to_numpy(), model["theta"])
    assert models.newton_step(sums, model["theta"])[1] < 1e-5
    proba = df.select(models.logit_proba({0: model}, ["a", "b", "empty"], F.lit(0)).alias("p")).toPandas()["p"]
    assert np.allclose(np.array(proba.to_list()), models.softmax(np.hstack([z, np.ones((400, 1))]) @ model["theta"].T))


def test_goals_model_recovers_strengths_and_is_optimal():
    rng = np.random.default_rng(2)
    n, att, dfn = 12, rng.normal(0, 0.3, 12), rng.normal(0, 0.3, 12)
    rows = []
    for _ in range(6000):
        h, a = rng.choice(n, 2, replace=False)
        rows.append((f"t{h:02d}", f"t{a:02d}", False, min(10, rng.poisson(np.exp(0.2 + att[h] - dfn[a] + 0.25))), min(10, rng.poisson(np.exp(0.2 + att[a] - dfn[h]))), 1.0))
    frame = pd.DataFrame(rows, columns=["home_team", "away_team", "neutral", "x", "y", "w"])
    out = models.fit_goals(frame)
    fitted = out[out.kind == "att"]["value"].to_numpy()
    scalars = dict(out[out.kind == "scalar"][["name", "value"]].to_numpy())
    assert np.corrcoef(fitted, att)[0, 1] > 0.97 and scalars["converged"] and abs(scalars["home"] - 0.25) < 0.06
    place = {f"t{i:02d}": i for i in range(n)}
    data = (frame.home_team.map(place).to_numpy(), frame.away_team.map(place).to_numpy(), frame.x.to_numpy(float), frame.y.to_numpy(float), np.ones(len(frame)), np.ones(len(frame)), n, 0.5)
    theta = np.r_[fitted, out[out.kind == "def"]["value"].to_numpy(), scalars["base"], scalars["home"], scalars["rho"]].astype(float)
    g, _ = models.goals_gradient(theta, *data)
    for i in (0, n + 1, 2 * n, 2 * n + 2):
        e = np.zeros(len(theta))
        e[i] = 1e-5
        slope = (models.goals_objective(theta + e, *data) - models.goals_objective(theta - e, *data)) / 2e-5
        assert abs(slope - g[i]) < 1e-2


def test_booster_beats_the_prior():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    x[::9, 1] = np.nan
    y = np.where(x[:, 0] > 0.5, 0, np.where(np.nan_to_num(x[:, 1]) > 0, 1, 2))
    model = models.Booster(rounds=120).fit(x, y, np.ones(3000))
    p = model.proba(x)
    assert np.allclose(p.sum(1), 1) and -np.log(p[np.arange(3000), y]).mean() < 0.75


def test_csv_readers(spark, tmp_path):
    (tmp_path / "results.csv").write_text("date,home_team,away_team,home_score,away_score,tournament,city,neutral\n2020-01-01,A,B,1,0,Friendly,X,TRUE\n2020-01-02,A,B,,,Friendly,X,FALSE\n")
    got = schemas.load_results(spark, str(tmp_path / "results.csv")).collect()
    assert len(got) == 1 and got[0]["neutral"] is True and got[0]["home_score"] == 1
    (tmp_path / "bad.csv").write_text("date,home_team\n2020-01-01,A\n")
    with pytest.raises(ValueError):
        schemas.load_results(spark, str(tmp_path / "bad.csv"))
    assert schemas.load_former_names(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "fx.csv").write_text("home,away,neutral,wc,home_win,draw,over_2.5\nA,B,,1,2.1,,1.0\nC,D,0,,,,\n")
    fixtures, odds = schemas.load_fixtures(spark, str(tmp_path / "fx.csv"))
    assert [(r["match"], r["neutral"], r["wc"]) for r in fixtures.collect()] == [("A vs B", True, True)]
    assert [(r["outcome"], r["odds"]) for r in odds.collect()] == [("home_win", 2.1)]
    (tmp_path / "mv.csv").write_text("player_id,date_unix,value\n1,1577836800,5\n2,1577923200,x\n")
    assert [tuple(r) for r in schemas.load_market_values(spark, str(tmp_path / "mv.csv")).collect()] == [(1, D(2020, 1, 1), 5.0)]
    (tmp_path / "p12.json").write_text('{"list":[{"datum_mw":"Jan 1, 2018","y":500000},{"x":1514764800000,"mw":"€1.5m"},{"datum_mw":"?"}]}')
    got = schemas.load_value_history(spark, str(tmp_path / "p12.json")).collect()
    assert sorted(tuple(r) for r in got) == [(12, D(2018, 1, 1), 5e5), (12, D(2018, 1, 1), 1.5e6)]


def test_streamed_elo_equals_batch(spark, tmp_path):
    from matchloom.streaming.ratings import stream_elo

    df = some_matches(spark, 30)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_elo(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("elo_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["match_id"]: (r["elo_home"], r["elo_away"]) for r in spark.table("elo_stream").collect()}
    want = {r["match_id"]: (r["elo_home"], r["elo_away"]) for r in ratings.snapshots(df).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in got)
