"""Match-analytics inputs made from the generic star-schema tables, one SQL text for Spark and DuckDB each.

``{day:expr}`` stands for the day that many days after 1995-01-01, which the two engines spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")

MATCHES = """
select o_orderkey as match_id, cast(o_orderdate as date) as date,
  concat('T', cast(c_nationkey as string)) as home_team,
  concat('T', cast((c_nationkey + 1 + (o_orderkey % 24)) % 25 as string)) as away_team,
  cast((cast(round(o_totalprice) as bigint) % 7) % 5 as int) as home_score,
  cast((cast(round(o_totalprice) as bigint) % 11) % 4 as int) as away_score,
  case o_orderpriority when '1-URGENT' then case when o_orderkey % 3 = 0 then 'FIFA World Cup qualification' else 'FIFA World Cup' end
    when '2-HIGH' then 'UEFA Euro qualification' when '3-MEDIUM' then 'Copa América'
    when '4-NOT SPECIFIED' then 'Friendly' else 'African Cup of Nations' end as tournament,
  (o_orderstatus = 'P') as neutral,
  concat('T', cast(o_custkey % 25 as string)) as country
from orders join customer on o_custkey = c_custkey
"""

ADAPTERS = {
    "matches": MATCHES,
    "series": """
select concat('T', cast(user_id % 25 as string)) as country, {day:(event_id * 7) % 2400} as date, max(value) as mv_eur
from events group by 1, 2""",
    "player_values": """
select user_id as player_id, {day:(event_id * 7) % 2400} as date, max(value) as value_eur
from events where event_type <> 'error' group by 1, 2""",
    "injuries": """
select user_id as player_id, {day:(event_id * 7) % 2400} as from_date, {day:(event_id * 7) % 2400 + event_id % 15} as end_date
from events where event_type = 'error'""",
    "pool": """
select distinct user_id as player_id, concat('T', cast(user_id % 25 as string)) as country,
  case when user_id % 3 = 0 then {day:user_id % 700} end as debut
from events""",
    "transfers": """
select user_id as player_id, {day:(event_id * 7) % 2400} as transfer_date, event_id % 20 as to_team_id,
  case when event_id % 17 = 0 then 'Retired' when event_id % 23 = 0 then null else concat('C', cast(event_id % 20 as string)) end as to_team_name
from events where event_type = 'click'""",
    "lineups": """
select distinct cast(o_orderdate as date) as date, concat('T', cast(c_nationkey as string)) as team, l_suppkey as player_id
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
    "editions": """
select concat('T', cast(user_id % 25 as string)) as country, {day:(user_id * 13) % 1500} as start,
  {day:(user_id * 13) % 1500 + 200} as "end", user_id as player_id from events group by user_id""",
    "former_names": """
select concat('T', cast(n_nationkey as string)) as former, concat('N', cast(n_nationkey as string)) as current,
  {day:n_nationkey * 20} as start_date, {day:n_nationkey * 20 + 700} as end_date from nation where n_nationkey % 4 = 0""",
    "profiles": """
select c_custkey as player_id, concat('Player ', cast(c_custkey as string)) as player_name,
  concat(case when c_custkey % 5 = 0 then 'Other' else n_name end, '  ', 'Second') as citizenship, c_nationkey as team_id
from customer join nation on c_nationkey = n_nationkey""",
    "odds": """
select o_orderkey as match_id, outcome, odds from (
  select o_orderkey, 'home_win' as outcome, 1.2 + cast(o_orderkey % 37 as double) / 10 as odds from orders
  union all select o_orderkey, 'draw', 2.4 + cast(o_orderkey % 23 as double) / 10 from orders
  union all select o_orderkey, 'away_win', 1.5 + cast(o_orderkey % 41 as double) / 10 from orders
  union all select o_orderkey, 'over_2.5', 1.3 + cast(o_orderkey % 13 as double) / 10 from orders
  union all select o_orderkey, 'under_2.5', 1.6 + cast(o_orderkey % 11 as double) / 10 from orders
  union all select o_orderkey, 'goals_0_1', 2.6 + cast(o_orderkey % 19 as double) / 10 from orders
  union all select o_orderkey, 'goals_2_3', 1.9 + cast(o_orderkey % 9 as double) / 10 from orders
  union all select o_orderkey, 'goals_4plus', 2.9 + cast(o_orderkey % 29 as double) / 10 from orders
  union all select o_orderkey, 'hcap_home_-1', 2.2 + cast(o_orderkey % 31 as double) / 10 from orders
  union all select o_orderkey, 'hcap_draw_-1', 3.0 + cast(o_orderkey % 17 as double) / 10 from orders
  union all select o_orderkey, 'hcap_away_+1', 1.6 + cast(o_orderkey % 15 as double) / 10 from orders
) t""",
    "rates": """
select o_orderkey as match_id, 0.6 + cast(o_orderkey % 29 as double) / 12 as lam, 0.4 + cast(o_orderkey % 23 as double) / 11 as mu
from orders""",
    "losses": """
select m.match_id, m.date, m.tournament, m.neutral, m.home_score, m.away_score,
  1400 + cast(m.match_id % 401 as double) as elo_home, 1380 + cast(m.match_id % 379 as double) as elo_away,
  cast(m.match_id % 97 as double) / 97 as glicko_exp,
  0.2 + cast(m.match_id % 7 as double) / 20 as p_home, 0.15 + cast(m.match_id % 5 as double) / 20 as p_draw,
  cast(case when m.home_score > m.away_score then 0 when m.home_score = m.away_score then 1 else 2 end as int) as target
from ({matches}) m""",
}


def text(name: str, engine: str) -> str:
    sql = ADAPTERS[name].replace("{matches}", MATCHES)
    spelled = {"spark": "date_add(date'1995-01-01', cast({} as int))", "duckdb": "cast(date '1995-01-01' + cast({} as int) as date)"}[engine]
    sql = re.sub(r"\{day:([^}]*)\}", lambda m: spelled.format(m[1]), sql)
    return sql.replace('"end"', "`end`") if engine == "spark" else sql


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = text(name, "spark")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def ctes(*names: str) -> str:
    """``name as (...)`` definitions for the start of a DuckDB query."""
    return ", ".join(f"{n} as ({text(n, 'duckdb')})" for n in names)
