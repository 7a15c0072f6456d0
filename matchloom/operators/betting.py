"""Fair probabilities from quoted odds, value bets and an exposure-capped portfolio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALVINGS = 60  # of (0, 1/2): far below the spacing of doubles


def implied(odds: Column) -> Column:
    return F.when(odds > 0, 1 / odds)


def kelly_fraction(p: Column, odds: Column) -> Column:
    return F.when(odds <= 1, 0.0).otherwise(F.greatest((p * odds - 1) / (odds - 1), F.lit(0.0)))


def market_of(outcome: Column) -> Column:
    """The market whose outcomes exclude each other: a handicap's is named by the line from the home side."""
    parts = F.split(outcome, "_")
    line = F.element_at(parts, -1).try_cast("double")
    home_line = F.when(parts[1] == "away", -line).otherwise(line)
    return (
        F.when(outcome.isin("home_win", "draw", "away_win"), "1x2")
        .when(parts[0].isin("over", "under"), F.concat(F.lit("ou_"), F.element_at(parts, -1)))
        .when(parts[0] == "goals", "totals")
        .when(parts[0] == "hcap", F.concat(F.lit("hcap_"), home_line.cast("string")))
        .otherwise(outcome)
    )


def insider_roots(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each row of inverse prices ``q`` the root z of sum(p(z)) = 1 in (1e-9, 0.5) by bisection; NaN if the ends
    have one sign.

    p(z) = (sqrt(z^2 + 4 (1 - z) q^2 / B) - z) / (2 (1 - z)) for each inverse price q of a book that sums to B.
    """

    def excess(z: np.ndarray) -> np.ndarray:
        total = np.zeros(len(z))
        for one in q.T:  # in the order of the prices
            total = total + (np.sqrt(z * z + 4 * (1 - z) * one * one / book) - z) / (2 * (1 - z))
        return total - 1

    low, high = np.full(len(q), 1e-9), np.full(len(q), 0.5)
    start, end = excess(low), excess(high)
    rising = start < 0
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        left = (excess(mid) < 0) == rising
        low, high = np.where(left, mid, low), np.where(left, high, mid)
    return np.where(start * end <= 0, (low + high) / 2, np.nan)


def insider_share(inverse: Column, book: Column) -> Column:
    """``insider_roots`` of arrays of inverse prices, the books of one size side by side; null without a root."""

    @F.arrow_udf("double")
    def roots(lists: pa.Array, books: pa.Array) -> pa.Array:
        sizes, flat = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        first, total, out = np.cumsum(sizes) - sizes, books.to_numpy(zero_copy_only=False), np.full(len(lists), np.nan)
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            out[at] = insider_roots(flat[first[at, None] + np.arange(n)], total[at])
        return pa.array(out, mask=np.isnan(out))

    return roots(inverse, book)


def with_fair(rows: DataFrame, method: str = "shin") -> DataFrame:
    """``rows`` (match_id, outcome, odds, ...) whose price is over 1, plus ``market`` and ``fair_p``.

    A book is gathered with its rows and dealt out again, so rows are shuffled once, or not at all if they come
    dealt by match.
    """
    if method not in ("shin", "multiplicative"):
        raise ValueError(f"unknown method {method}")
    good = rows.withColumn("market", market_of(F.col("outcome"))).where("odds > 1 and match_id is not null and market is not null")
    rest = [c for c in rows.columns if c != "match_id"]
    books = good.groupBy("match_id", "market").agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    books = books.withColumn("_qs", F.array_sort(F.transform("_rows", lambda r: 1 / r["odds"])))
    books = books.withColumn("_n", F.size("_rows")).withColumn("_b", F.aggregate("_qs", F.lit(0.0), lambda a, q: a + q))
    books = books.withColumn("_z", insider_share(F.col("_qs"), F.col("_b")) if method == "shin" else F.lit(None).cast("double"))
    dealt = books.select("match_id", "market", "_n", "_b", "_z", F.inline("_rows")).withColumn("_q", 1 / F.col("odds"))
    z, q, b = F.col("_z"), F.col("_q"), F.col("_b")
    fair = F.when((F.col("_n") < 2) | z.isNull(), q / b).otherwise((F.sqrt(z * z + 4 * (1 - z) * q * q / b) - z) / (2 * (1 - z)))
    return dealt.select("match_id", *rest, "market", fair.alias("fair_p"))


def fair_book(odds: DataFrame, method: str = "shin") -> DataFrame:
    """``odds`` (match_id, outcome, odds) plus ``market`` and ``fair_p``; prices of 1 or less have none."""
    return with_fair(odds.select("match_id", "outcome", "odds"), method)


def find_bets(priced: DataFrame, kelly: float = 0.25, edge: float = 0.03, devig: str = "shin") -> DataFrame:
    """Bets of ``priced`` (match_id, outcome, odds, p[, push]) whose edge reaches the threshold."""
    push = F.coalesce(F.col("push"), F.lit(0.0)) if "push" in priced.columns else F.lit(0.0)
    rows = with_fair(priced.select("match_id", "outcome", "odds", "p", push.alias("push")), devig).where("p is not null")
    rows = rows.withColumn("edge", F.col("p") * F.col("odds") - (1 - F.col("push"))).where(F.col("edge") >= edge)
    full = F.greatest(F.col("edge") / (F.col("odds") - 1), F.lit(0.0))
    return rows.select(
        "match_id",
        "outcome",
        F.col("p").alias("p_model"),
        "push",
        "fair_p",
        (1 / F.col("odds")).alias("book_p"),
        "odds",
        (F.col("p") - F.col("fair_p")).alias("vs_fair"),
        "edge",
        full.alias("kelly_full"),
        (full * kelly).alias("stake"),
    )


def build_portfolio(bets: DataFrame, bankroll: float = 1000.0, max_per_bet: float = 0.2, max_exposure: float = 0.7) -> DataFrame:
    """Stakes clipped one by one, then scaled together to the exposure cap; money to the cent, half to even."""
    clipped = bets.withColumn("stake", F.least("stake", F.lit(max_per_bet)))
    total = clipped.agg(F.sum("stake")).scalar()  # a subquery, since a broadcast fails if its input takes over 300 s
    scale = F.when(total > max_exposure, F.lit(max_exposure) / total).otherwise(1.0)
    scaled = clipped.withColumn("stake", F.col("stake") * scale)
    return scaled.withColumn("stake_eur", F.bround(F.col("stake") * bankroll, 2)).withColumn("exp_profit_eur", F.bround(F.col("stake") * bankroll * F.col("edge"), 2))


def portfolio_totals(portfolio: DataFrame) -> DataFrame:
    return portfolio.agg(F.count("*").alias("n_bets"), F.sum("stake_eur").alias("stake_eur"), F.sum("exp_profit_eur").alias("exp_profit_eur"))

