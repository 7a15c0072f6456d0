"""Elo ratings over a stream of results, with the teams' state kept by Structured Streaming.

Matches of a pool (a league whose teams don't meet others) share one state. Within a micro-batch rows are sorted by
(date, match id); across batches they are taken as they come, so a result that arrives late is rated when it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import k_factor, margin_multiplier
from ..operators.ratings import ELO_HOME_ADVANTAGE, ELO_START

OUTPUT = "match_id long, elo_home double, elo_away double"


def stream_elo(matches: DataFrame, pool: str | None = None) -> DataFrame:
    """Pre-match Elo of a streaming ``matches``; append mode."""
    gd = F.col("home_score") - F.col("away_score")
    rows = matches.select(
        (F.col(pool) if pool else F.lit("")).alias("pool"),
        "match_id",
        "date",
        "home_team",
        "away_team",
        F.when(gd > 0, 1.0).when(gd == 0, 0.5).otherwise(0.0).alias("score"),
        (k_factor(F.col("tournament")) * margin_multiplier(gd)).alias("k"),
        F.when(F.col("neutral"), 0.0).otherwise(ELO_HOME_ADVANTAGE).alias("advantage"),
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        elo = dict(zip(*state.get)) if state.exists else {}
        out = []
        for r in pd.concat(list(frames)).sort_values(["date", "match_id"]).itertuples(index=False):
            home, away = elo.get(r.home_team, ELO_START), elo.get(r.away_team, ELO_START)
            out.append((r.match_id, home, away))
            gain = r.k * (r.score - 1 / (1 + 10 ** (-(home + r.advantage - away) / 400)))
            elo[r.home_team], elo[r.away_team] = home + gain, away - gain
        state.update((list(elo), list(elo.values())))
        yield pd.DataFrame(out, columns=["match_id", "elo_home", "elo_away"])

    return rows.groupBy("pool").applyInPandasWithState(step, OUTPUT, "teams array<string>, elo array<double>", "append", GroupStateTimeout.NoTimeout)
