"""Rows that a plan makes on the way, where they must not grow with the square of a group."""

import datetime as dt
import math

from matchloom.operators import betting, markets, squads

D = dt.date


def most_rows(df):
    """The rows of ``df`` and the most rows that any operator of its executed plan put out."""
    execution = df._jdf.queryExecution()
    rows = execution.executedPlan().executeCollectPublic()
    most, open_ = 0, [execution.executedPlan()]
    while open_:
        node = open_.pop()
        counted = node.metrics().get("numOutputRows")
        most = max(most, counted.get().value() if counted.isDefined() else 0)
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            children = node.children()
            open_ += [children.apply(i) for i in range(children.size())]
    return len(rows), most


def one_day(spark):
    matches = spark.range(300).selectExpr("id as match_id", "date'2000-01-02' as date", "'A' as home_team", "concat('B', id % 3) as away_team")
    values = spark.range(200).selectExpr("id as player_id", "date'2000-01-01' as date", "cast(id as double) as value_eur")
    return matches, values


def test_lineups_are_valued_once_a_day(spark):
    matches, values = one_day(spark)
    lineups = spark.range(200).selectExpr("date'2000-01-02' as date", "if(id < 150, 'A', 'B1') as team", "id as player_id")
    out = squads.value_from_lineups(matches, lineups, values)
    assert {(r["match_id"] % 3, r["mv_home"], r["mv_away"]) for r in out.collect()} == {(0, 11175.0, None), (1, 11175.0, 8725.0), (2, 11175.0, None)}
    n, most = most_rows(out)
    assert n == 300 and most <= 1000  # 50,000 players of matches before


def test_editions_are_valued_once_a_day(spark):
    matches, values = one_day(spark)
    values = values.union(values.selectExpr("player_id", "date'2000-01-03'", "1e6D"))  # too late
    editions = spark.range(200).selectExpr("if(id < 150, 'A', 'B1') as country", "date'1999-06-01' as start", "date'2100-01-01' as end", "id as player_id")
    out = squads.value_from_editions(matches, editions.union(editions.where("player_id < 2")), values)
    assert {(r["match_id"] % 3, r["mv_home"], r["mv_away"]) for r in out.collect()} == {(0, 11176.0, None), (1, 11176.0, 8725.0), (2, 11176.0, None)}
    n, most = most_rows(out)
    assert n == 300 and most <= 1000
    assert squads.value_from_editions(matches.limit(0), editions, values).count() == 0


QUOTED = ["home_win", "draw", "away_win", "over_2.5", "under_2.5", "over_3.0", "under_99.5", "over_-1.5", "over_3", "over_x", "goals_0_1", "goals_2_3", "goals_4plus", "goals_9", "what"]
QUOTED += [f"hcap_{side}_{line}" for side in ("home", "draw", "away") for line in ("-1", "+1", "0", "-0.5", "+1.5", "-30", "x")]


def test_prices_are_looked_up_once_a_match(spark):
    rates = spark.createDataFrame([(1, 1.4, 1.1), (2, 0.3, 2.7), (3, 4.0, 3.0)], "match_id long, lam double, mu double")
    blend = spark.createDataFrame([(1, 0.5, 0.3, 0.2), (2, 0.1, 0.2, 0.7), (3, 0.6, 0.4, 0.0), (4, 0.2, 0.2, 0.6)], "match_id long, home_win double, draw double, away_win double")
    odds = spark.createDataFrame([(i, o, 2.0) for i in range(6) for o in QUOTED], "match_id long, outcome string, odds double")
    for scale in (1.0, markets.CUP_SCALE):
        matrix = markets.reconcile(markets.score_matrix(rates, -0.05, scale), blend)
        want = {(r["match_id"], r["outcome"]): r["p"] for r in markets.priced(matrix, blend, odds).collect() if r["match_id"] < 4}
        out = markets.priced_tails(markets.reconciled_tails(rates, -0.05, blend, scale), odds)
        got = {(r["match_id"], r["outcome"]): r["p"] for r in out.collect()}
        assert got.keys() == want.keys() and len(got) > 60
        assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in got)


def test_reconciled_markets_make_no_row_for_each_score(spark, small):
    from matchloom.plans import catalog

    n, most = most_rows(catalog.reconciled_markets(spark, small))
    assert most <= 2 * n  # 121 rows a match and outcome before


def test_books_are_solved_side_by_side(spark):
    books = [(2.1, 3.3, 4.2), (5.0, 6.0), (1.5, 2.9), (3.0,), (1.2, 8.0, 15.0, 21.0)]
    odds = spark.createDataFrame([(i, f"hcap_{k}_1", o) for i, b in enumerate(books) for k, o in enumerate(b)] + [(9, "draw", 1.0), (None, "draw", 2.0), (9, None, 2.0)], "match_id long, outcome string, odds double")
    p = {}
    for r in betting.fair_book(odds).collect():
        p.setdefault(r["match_id"], []).append(r["fair_p"])
    assert {i: len(v) for i, v in p.items()} == {i: len(b) for i, b in enumerate(books)}
    over = [i for i, b in enumerate(books) if len(b) > 1 and sum(1 / o for o in b) > 1]
    assert over == [0, 2, 4] and all(math.isclose(sum(p[i]), 1.0, abs_tol=1e-9) for i in over)
    assert all(math.isclose(sum(p[i]), 1.0, abs_tol=1e-12) for i in (1, 3))  # no root: in proportion


def test_bets_take_no_row_for_each_score(spark, small):
    from matchloom.plans import catalog

    assert most_rows(catalog.value_bets(spark, small))[1] <= 11 * 1500


def test_total_stake_is_not_broadcast(spark, small):
    from matchloom.plans import catalog

    bets = betting.find_bets(spark.createDataFrame([(i, "draw", 3.0, 0.6) for i in range(9)], "match_id long, outcome string, odds double, p double"), 0.5, 0.05)
    folio = betting.build_portfolio(bets)
    assert math.isclose(sum(r["stake"] for r in folio.collect()), 0.7)
    assert "Broadcast" not in folio._jdf.queryExecution().executedPlan().toString()  # limited to 300 s


def test_totals_of_a_portfolio_are_not_broadcast(spark):
    bets = betting.find_bets(spark.createDataFrame([(i, "draw", 3.0, 0.6) for i in range(9)], "match_id long, outcome string, odds double, p double"), 0.5, 0.05)
    totals = betting.portfolio_totals(betting.build_portfolio(bets))
    assert [(r["n_bets"], round(r["stake_eur"], 2)) for r in totals.collect()] == [(9, 700.02)]
    assert "Broadcast" not in totals._jdf.queryExecution().executedPlan().toString()


def test_scorelines_of_the_goals_model_make_no_rows(spark):
    from pyspark.sql import functions as F

    from matchloom.plans import pipeline

    teams = [(k, t, kind, v) for k in (0, 1) for t, one in (("A", 0.3), ("B", -0.2 + k)) for kind, v in (("att", one), ("def", -one / 2))]
    scalars = [(k, n, "scalar", v) for k in (0, 1) for n, v in (("base", 0.1), ("home", 0.2 + k / 10), ("rho", -0.1))]
    fitted = spark.createDataFrame(teams + scalars, "fold int, name string, kind string, value double")
    sides = [("A", "B"), ("B", "A"), ("A", "new")]
    rows = spark.createDataFrame([(i % 2, i, *sides[i % 3], i % 4 == 0) for i in range(200)], "fold int, match_id long, home_team string, away_team string, neutral boolean")
    out = pipeline.goals_proba(rows, fitted)
    got = {r["match_id"]: r["proba"] for r in out.collect()}
    n, most = most_rows(out)
    assert n == len(got) == 200 and most <= 400  # 121 a match before
    strength = {(k, t, kind): v for k, t, kind, v in teams}
    for fold in (0, 1):
        mine = rows.where(F.col("fold") == fold)
        named = [(t, strength[fold, t, "att"], strength[fold, t, "def"]) for t in ("A", "B")]
        rates = markets.match_rates(mine, spark.createDataFrame(named, "team string, att double, dfn double"), {"base": 0.1, "home": 0.2 + fold / 10})
        for r in markets.one_x_two(markets.score_matrix(rates, -0.1)).collect():
            assert all(math.isclose(g, w, abs_tol=1e-12) for g, w in zip(got[r["match_id"]], (r["home_win"], r["draw"], r["away_win"])))


def some_features(spark, n=900):
    return spark.range(n).selectExpr(
        *("id as match_id", "date_add(date'2000-01-01', cast(id as int))", "concat('t', id % 5)", "concat('t', (id + 1 + id % 3) % 5)"),
        *("cast(id * 7 % 4 as int)", "cast(id * 5 % 3 as int)", "if(id % 4 = 0, 'Friendly', 'UEFA Euro')", "id % 3 = 0"),
    ).toDF("match_id", "date", "home_team", "away_team", "home_score", "away_score", "tournament", "neutral")


def test_ratings_of_a_backtest_are_passed_once(spark):
    from matchloom.operators import ratings
    from matchloom.plans import pipeline

    matches = some_features(spark)
    both, first = ratings.snapshots(matches), ratings.snapshots(matches, glicko2=False)
    assert first.columns == both.columns[:7]  # no Glicko-2 where nobody asks for it
    assert sorted(map(tuple, first.collect())) == sorted(tuple(r)[:7] for r in both.collect())
    spark.catalog.clearCache()
    pooled, losses = pipeline.backtest(pipeline.build_features(matches, start=None), months=6, train_years=1, least_train=100)
    for df in (pooled, losses):  # every pass over the ratings lies in the cached table
        plan = df._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and "elo_home" in plan
        assert "MapInArrow" not in plan.split("InMemoryRelation")[0]
    assert {r["model"] for r in pooled.collect()} == {"lr", "dc", "elo", "blend_0.3", "blend_0.5", "blend_0.7"}
    spark.catalog.clearCache()


def test_boosting_returns_only_the_rows_asked_for(spark):
    from pyspark.sql import functions as F

    from matchloom.operators import models

    dealt = spark.range(3000).selectExpr("cast(id % 2 as int) as fold", "if(id % 10 < 6, 'train', 'test') as part", "id as match_id", "cast(if(id * 37 % 101 > 60, 0, id % 3) as int) as target", "if(id % 9 = 0, null, cast(id * 37 % 101 as double)) as a", "cast(id % 7 as double) as b")
    whole = {(r["fold"], r["match_id"]): (r["part"], r["target"], r["proba"]) for r in models.boosted_proba(dealt, ["a", "b"], F.lit(1.0)).collect()}
    test = {(r["fold"], r["match_id"]): (r["part"], r["target"], r["proba"]) for r in models.boosted_proba(dealt, ["a", "b"], F.lit(1.0), ("test",)).collect()}
    assert len(whole) == 3000 and test == {k: v for k, v in whole.items() if v[0] == "test"} and len(test) == 1200


def test_bins_counted_in_pairs_are_those_of_each_column():
    import numpy as np

    from matchloom.operators import models

    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3)).astype(np.float32)
    x[::7, 1] = np.nan
    model = models.Booster(rounds=1, hold=0.0, least=100).fit(x, rng.integers(0, 3, 4000), np.ones(4000))
    codes, g, rows = model._codes(x), rng.normal(size=4000), np.flatnonzero(x[:, 0] > 0)
    sums = model._sums(codes, g, g * g, rows)
    for j, edges in enumerate(model.edges):
        bins = np.where(np.isnan(x[rows, j]), len(edges) + 1, np.searchsorted(edges, x[rows, j]))
        assert np.allclose(sums[j], [np.bincount(bins, v, 256) for v in (g[rows], g[rows] ** 2, np.ones(len(rows)))])


def test_a_backtest_makes_no_row_for_each_model_or_fold(spark):
    from pyspark.sql import functions as F

    from matchloom.operators import evaluate, models
    from matchloom.plans import pipeline

    spark.catalog.clearCache()
    features = pipeline.build_features(some_features(spark), start=None)
    pooled, losses = pipeline.backtest(features, months=6, train_years=1, least_train=100)
    assert most_rows(pooled)[1] <= 900  # six for each test match before
    assert len({r["match_id"] for r in losses.collect()}) == pooled.first()["n"]
    spark.catalog.clearCache()
    # steps that read a match once fit what copies of it for each fold do, gaps included
    df = pipeline.competitive_only(features).withColumn("gap", F.when(F.col("match_id") % 7 > 0, F.col("elo_diff") % 11)).persist()
    used = ["elo_diff", "glicko_exp", "gap"]
    folds = evaluate.fold_table(spark, df, 6, 8, 1)
    dealt = evaluate.assign_folds(df, folds, 100)
    last = dealt.where("part = 'train'").groupBy("fold").agg(F.max("date").alias("_last"), F.count("*").alias("n_train"), F.avg((F.col("target") == 1).cast("int")).alias("draw_rate"))
    sized = evaluate.sized_folds(df, folds, 100)
    told = {r["fold"]: (r["_last"], r["n_train"], r["draw_rate"]) for r in last.collect()}
    assert {f["fold"]: (f["last"], f["n_train"], f["draw_rate"]) for f in sized} == told and len(told) > 2
    day = lambda d: (d - dt.date(1970, 1, 1)).days
    spans = [(f["fold"], day(f["train_lo"]), day(f["b0"]), day(f["last"])) for f in sized]
    weight = evaluate.time_decay(F.col("date"), F.col("_last"))
    once = df.select(F.unix_date("date").alias("_day"), "target", *used), models.by_day(spans, evaluate.HALFLIFE_DAYS)
    rows = dealt.join(last.select("fold", "_last"), "fold")
    want, got = (models.fit_logit(rows, used, weight, once=o) for o in (None, once))
    assert want.keys() == got.keys() == told.keys()
    for k, m in want.items():
        assert m["converged"] and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(m["theta"].ravel(), got[k]["theta"].ravel()))
    spark.catalog.clearCache()
