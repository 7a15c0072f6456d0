"""DuckDB SQL for the queries of the catalog, written apart from the plans that it checks."""

from __future__ import annotations

from ..functions import rules
from ..operators.chemistry import NON_CLUBS
from ..sources.adapters import ctes

K = rules.decide_sql("tournament", rules.K_FACTORS, rules.DEFAULT_K)
CONFED = rules.decide_sql("tournament", rules.CONFEDERATIONS, rules.DEFAULT_CONFEDERATION)
KIND = rules.decide_sql("tournament", rules.MATCH_TYPES, rules.DEFAULT_MATCH_TYPE)
Q = "0.005756462732485114"  # ln(10) / 400


def with_(names: tuple[str, ...], body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes(*names)}{body}"


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


FORM = with_(
    ("matches",),
    f""", t as (
  select match_id, date, 0 as side, home_team as team, home_score as gf, away_score as ga from matches
  union all select match_id, date, 1, away_team, away_score, home_score from matches
), w as (
  select match_id, side, avg(case when gf > ga then 3 when gf = ga then 1 else 0 end) over p as pts, avg(gf) over p as gf, avg(ga) over p as ga
  from t window p as (partition by team order by date, side, match_id rows between 10 preceding and 1 preceding)
), s as (select match_id, side, coalesce(pts, 1.0) as pts, coalesce(gf, 1.0) as gf, coalesce(ga, 1.0) as ga from w)
select match_id, {", ".join(f"round(max({c}) filter (side = {n}), 6) as form_{c}_{s}" for c in ("pts", "gf", "ga") for n, s in ((0, "home"), (1, "away")))}
from s group by match_id""",
)

H2H = with_(
    ("matches",),
    """, k as (
  select *, least(home_team, away_team) as lo, greatest(home_team, away_team) as hi,
    case when home_team <= away_team then home_score - away_score else away_score - home_score end as gd from matches
), w as (
  select *, count(*) over p as m, coalesce(sum((gd > 0)::int) over p, 0) as won, coalesce(sum((gd < 0)::int) over p, 0) as lost, coalesce(sum(gd) over p, 0) as goals
  from k window p as (partition by lo, hi order by date, match_id rows between unbounded preceding and 1 preceding)
)
select match_id,
  round(case when m = 0 then 0.5 else ((case when home_team = lo then won else lost end) + 2.5) / (m + 5) end, 6) as h2h_home_winrate,
  round(case when m = 0 then 0.0 else (case when home_team = lo then goals else -goals end) / (m + 5.0) end, 6) as h2h_home_gd,
  round(ln(1 + m), 6) as h2h_logn from w""",
)

ORDERED = f"""o as materialized (
  select *, row_number() over (order by date, match_id) as rn, cast(substr(home_team, 2) as int) + 1 as hi, cast(substr(away_team, 2) as int) + 1 as ai,
    case when home_score > away_score then 1.0 when home_score = away_score then 0.5 else 0.0 end as s,
    {K} * case when abs(home_score - away_score) <= 1 then 1.0 when abs(home_score - away_score) = 2 then 1.5 else (11 + abs(home_score - away_score)) / 8.0 end as k
  from matches
)"""

ELO_STATE = with_(
    ("matches",),
    f""", {ORDERED}, st as (
  select 0::bigint as rn, 0::bigint as match_id, 0.0::double as elo_home, 0.0::double as elo_away, list_transform(range(25), lambda x: 1500.0::double) as e
  union all
  select rn, match_id, eh, ea, list_transform(e, lambda v, i: case when i = hi then v + d when i = ai then v - d else v end) from (
    select o.rn, o.match_id, st.e, o.hi, o.ai, st.e[o.hi] as eh, st.e[o.ai] as ea,
      o.k * (o.s - 1.0 / (1.0 + power(10.0, -(st.e[o.hi] - st.e[o.ai]) / 400.0))) as d
    from st join o on o.rn = st.rn + 1)
)""",
    True,
)
ELO = f"{ELO_STATE} select match_id, {r('elo_home', 'elo_away')} from st where rn > 0"
ELO_FINAL = (
    f"{ELO_STATE} select team, round(elo, 6) as elo from (select concat('T', (unnest(range(25)))::string) as team, unnest(e) as elo from st "
    "where rn = (select max(rn) from st)) where team in (select home_team from matches union select away_team from matches)"
)


def _g(rd: str) -> str:
    return f"(1.0 / sqrt(1.0 + 3.0 * {Q} * {Q} * ({rd}) * ({rd}) / (pi() * pi())))"


GLICKO = with_(
    ("matches",),
    f""", {ORDERED}, st as (
  select 0::bigint as rn, 0::bigint as match_id, 0.0::double as rh, 0.0::double as ra, 0.0::double as dh, 0.0::double as da,
    list_transform(range(25), lambda x: 1500.0::double) as r, list_transform(range(25), lambda x: 350.0::double) as rd,
    list_transform(range(25), lambda x: null::date) as last
  union all
  select rn, match_id, rh, ra, dh, da,
    list_transform(r, lambda v, i: case when i = hi then rh + {Q} / vh * ga * (s - eh) when i = ai then ra + {Q} / va * gh * ((1 - s) - ea) else v end),
    list_transform(rd, lambda v, i: case when i = hi then sqrt(1 / vh) when i = ai then sqrt(1 / va) else v end),
    list_transform(last, lambda v, i: case when i = hi or i = ai then date else v end)
  from (select *, 1 / (dh * dh) + {Q} * {Q} * ga * ga * eh * (1 - eh) as vh, 1 / (da * da) + {Q} * {Q} * gh * gh * ea * (1 - ea) as va from (
    select *, 1 / (1 + power(10.0, -ga * (rh - ra) / 400)) as eh, 1 / (1 + power(10.0, -gh * (ra - rh) / 400)) as ea from (
      select *, {_g("dh")} as gh, {_g("da")} as ga from (
        select o.rn, o.match_id, o.hi, o.ai, o.s, o.date, st.r, st.rd, st.last, st.r[o.hi] as rh, st.r[o.ai] as ra,
          case when st.last[o.hi] is null then st.rd[o.hi] else least(sqrt(st.rd[o.hi] * st.rd[o.hi] + 165.0 * date_diff('day', st.last[o.hi], o.date)), 350.0) end as dh,
          case when st.last[o.ai] is null then st.rd[o.ai] else least(sqrt(st.rd[o.ai] * st.rd[o.ai] + 165.0 * date_diff('day', st.last[o.ai], o.date)), 350.0) end as da
        from st join o on o.rn = st.rn + 1))))
) select match_id, round(rh - ra, 6) as glicko_diff, round(sqrt(dh * dh + da * da), 6) as glicko_unc,
  round(1 / (1 + power(10.0, -{_g("sqrt(dh * dh + da * da)")} * (rh - ra) / 400)), 6) as glicko_exp from st where rn > 0""",
    True,
)

TAU2 = "0.25"  # Glicko-2's tau, squared
NEWTON = 5


def _g2(phi: str) -> str:
    return f"(1.0 / sqrt(1.0 + 3.0 * ({phi}) * ({phi}) / (pi() * pi())))"


def _newton(x: str, side: str) -> str:
    """A step towards the volatility equation's root from x, the logarithm of sigma squared."""
    e, total = f"exp({x})", f"(w{side} + exp({x}))"
    value = f"{e} * (dd{side} - {total}) / (2 * {total} * {total}) - ({x} - a{side}) / {TAU2}"
    slope = f"{e} * (w{side} * (dd{side} - {total}) - {e} * dd{side}) / (2 * {total} * {total} * {total}) - 1 / {TAU2}"
    return f"{x} - greatest(-0.5, least(0.5, ({value}) / ({slope})))"


def _solved(source: str) -> str:
    """``source`` with the roots xh and xa, from the old values ah and aa."""
    sql = f"select *, ah as xh, aa as xa from ({source})"
    for _ in range(NEWTON):
        sql = f"select * replace ({_newton('xh', 'h')} as xh, {_newton('xa', 'a')} as xa) from ({sql})"
    return sql


GLICKO2 = with_(
    ("matches",),
    f""", {ORDERED}, st as (
  select 0::bigint as rn, 0::bigint as match_id, 0.0::double as mh, 0.0::double as ma, 0.0::double as ph, 0.0::double as pa, 0.0::double as sh, 0.0::double as sa,
    list_transform(range(25), lambda x: 0.0::double) as mu, list_transform(range(25), lambda x: 350.0::double / 173.7178) as phi,
    list_transform(range(25), lambda x: 0.06::double) as sigma, list_transform(range(25), lambda x: null::date) as last
  union all
  select rn, match_id, mh, ma, ph, pa, sh, sa,
    list_transform(mu, lambda v, i: case when i = hi then mh + nh * nh * gh * (s - eh) when i = ai then ma + na * na * ga * (1 - s - ea) else v end),
    list_transform(phi, lambda v, i: case when i = hi then nh when i = ai then na else v end),
    list_transform(sigma, lambda v, i: case when i = hi then exp(xh / 2) when i = ai then exp(xa / 2) else v end),
    list_transform(last, lambda v, i: case when i = hi or i = ai then date else v end)
  from (select *, 1 / sqrt(1 / (ph * ph + exp(xh)) + 1 / vh) as nh, 1 / sqrt(1 / (pa * pa + exp(xa)) + 1 / va) as na from ({_solved(f"""
    select *, 2 * ln(sh) as ah, 2 * ln(sa) as aa, ph * ph + vh as wh, pa * pa + va as wa, (vh * gh * (s - eh)) * (vh * gh * (s - eh)) as ddh,
      (va * ga * (1 - s - ea)) * (va * ga * (1 - s - ea)) as dda from (
      select *, 1 / (gh * gh * eh * (1 - eh)) as vh, 1 / (ga * ga * ea * (1 - ea)) as va from (
        select *, greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-gh * (mh - ma))))) as eh, greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-ga * (ma - mh))))) as ea from (
          select *, {_g2("pa")} as gh, {_g2("ph")} as ga from (
            select o.rn, o.match_id, o.hi, o.ai, o.s, o.date, st.mu, st.phi, st.sigma, st.last, st.mu[o.hi] as mh, st.mu[o.ai] as ma, st.sigma[o.hi] as sh, st.sigma[o.ai] as sa,
              case when st.last[o.hi] is null then st.phi[o.hi] else least(sqrt(st.phi[o.hi] * st.phi[o.hi] + st.sigma[o.hi] * st.sigma[o.hi] * greatest(date_diff('day', st.last[o.hi], o.date) / 30.0, 0)), 350.0 / 173.7178) end as ph,
              case when st.last[o.ai] is null then st.phi[o.ai] else least(sqrt(st.phi[o.ai] * st.phi[o.ai] + st.sigma[o.ai] * st.sigma[o.ai] * greatest(date_diff('day', st.last[o.ai], o.date) / 30.0, 0)), 350.0 / 173.7178) end as pa
            from st join o on o.rn = st.rn + 1))))
  """)}))
) select match_id, round(173.7178 * (mh - ma), 6) as glicko2_diff, round(173.7178 * sqrt(ph * ph + pa * pa), 6) as glicko2_unc,
  round(1 / (1 + power(10.0, -{_g("173.7178 * sqrt(ph * ph + pa * pa)")} * 173.7178 * (mh - ma) / 400)), 6) as glicko2_exp,
  round(sqrt(sh * sh + sa * sa), 6) as glicko2_vol from st where rn > 0""",
    True,
)

FEATURES = f"""select m.match_id, m.date, round(e.elo_home - e.elo_away, 6) as elo_diff, m.neutral::int as is_neutral,
  f.form_pts_home, f.form_pts_away, f.form_gf_home, f.form_gf_away, f.form_ga_home, f.form_ga_away, h.h2h_home_winrate, h.h2h_home_gd, h.h2h_logn,
  g.glicko_exp, case when m.home_score > m.away_score then 0 when m.home_score = m.away_score then 1 else 2 end as target
from (with {ctes("matches")} select * from matches) m join ({ELO_STATE} select match_id, elo_home, elo_away from st where rn > 0) e using (match_id)
join ({FORM}) f using (match_id) join ({H2H}) h using (match_id) join ({GLICKO}) g using (match_id)"""

TEAM_CONFED = f"""tc as (
  select team, confed from (select team, confed, row_number() over (partition by team order by count(*) desc, confed) as n from (
    select unnest([home_team, away_team]) as team, {CONFED} as confed from matches) where confed in ({", ".join(f"'{c}'" for c in rules.CONTINENTAL)}) group by 1, 2) where n = 1
)"""

CONTEXT = with_(
    ("matches",),
    f""", {TEAM_CONFED}
select m.match_id, round({K} / 30.0, 6) as comp_importance, coalesce(h.confed = a.confed, false)::int as same_confed,
  coalesce(h.confed = v.confed, false)::int as home_own_continent, coalesce(a.confed = v.confed, false)::int as away_own_continent,
  {", ".join(f"coalesce({t}.confed = '{c}', false)::int as {s}_conf_{c}" for t, s in (("h", "home"), ("a", "away")) for c in rules.CONTINENTAL)}
from matches m left join tc h on h.team = home_team left join tc a on a.team = away_team left join tc v on v.team = m.country""",
)


def _shin(q: str, b: str, z: str) -> str:
    return f"((sqrt({z} * {z} + 4 * (1 - {z}) * {q} * {q} / {b}) - {z}) / (2 * (1 - {z})))"


MARKET = """case when outcome in ('home_win', 'draw', 'away_win') then '1x2'
  when split_part(outcome, '_', 1) in ('over', 'under') then 'ou_' || split_part(outcome, '_', -1)
  when split_part(outcome, '_', 1) = 'goals' then 'totals'
  when split_part(outcome, '_', 1) = 'hcap' then 'hcap_' || (case when split_part(outcome, '_', 2) = 'away' then -1 else 1 end * split_part(outcome, '_', -1)::double)::string
  else outcome end"""

FAIR = f"""q as (select *, {MARKET} as market, 1 / odds as q from odds where odds > 1
), books as materialized (select match_id, market, list(q order by q) as qs, count(*) as n, list_sum(list(q order by q)) as b from q group by 1, 2
), ends as materialized (
  select match_id, market, qs, b, list_sum(list_transform(qs, lambda q: {_shin("q", "b", "1e-9")})) - 1 as f0, list_sum(list_transform(qs, lambda q: {_shin("q", "b", "0.5")})) - 1 as f1 from books
), halving as (
  select match_id, market, qs, b, f0 < 0 as rising, 1e-9::double as lo, 0.5::double as hi, 0 as i from ends where f0 * f1 <= 0
  union all
  select match_id, market, qs, b, rising, case when below = rising then (lo + hi) / 2 else lo end, case when below = rising then hi else (lo + hi) / 2 end, i + 1
  from (select *, list_sum(list_transform(qs, lambda q: {_shin("q", "b", "((lo + hi) / 2)")})) - 1 < 0 as below from halving where i < 60)
), roots as (select match_id, market, (lo + hi) / 2 as z from halving where i = 60
), fair as (
  select q.match_id, outcome, odds, q.market, case when n < 2 or z is null then q / b else {_shin("q", "b", "z")} end as fair_p
  from q join books using (match_id, market) left join roots using (match_id, market)
)"""


def _cells(scale: float, rho: float) -> str:
    return f"""raw as (
  select match_id, x, y, greatest(0, exp(x * ln(lam) - lam) / factorial(x::int) * exp(y * ln(mu) - mu) / factorial(y::int) *
    case when x = 0 and y = 0 then 1 - lam * mu * {rho} when x = 0 and y = 1 then 1 + lam * {rho} when x = 1 and y = 0 then 1 + mu * {rho} when x = 1 and y = 1 then 1 - {rho} else 1.0 end) as p
  from (select match_id, lam * {scale} as lam, mu * {scale} as mu from rates), range(11) a(x), range(11) b(y)
), cells as (select match_id, x, y, p / sum(p) over (partition by match_id) as p from raw)"""


def all_oracles(stale: int, live: int, top: int, rho: float, blend: dict[str, float], crude: float) -> dict[str, str]:
    priced = f"""{_cells(1.0, rho)}, region as (
  select *, case when x > y then 'home_win' when x = y then 'draw' else 'away_win' end as o from cells
), scaled as (
  select match_id, x, y, p * case o {" ".join(f"when '{k}' then {v}" for k, v in blend.items())} end / sum(p) over (partition by match_id, o) as p from region
), m as (select match_id, x, y, p / sum(p) over (partition by match_id) as p from scaled
), priced as (
  select odds.match_id, outcome, odds, sum(case when split_part(outcome, '_', 1) = 'over' and x + y > split_part(outcome, '_', -1)::double then p
    when split_part(outcome, '_', 1) = 'under' and x + y <= split_part(outcome, '_', -1)::double then p
    when outcome = 'goals_0_1' and x + y <= 1 then p when outcome = 'goals_2_3' and x + y in (2, 3) then p when outcome = 'goals_4plus' and x + y >= 4 then p
    when outcome = 'hcap_home_-1' and x - y - 1 > 0 then p when outcome = 'hcap_draw_-1' and x - y - 1 = 0 then p when outcome = 'hcap_away_+1' and x - y - 1 < 0 then p else 0 end) as p
  from odds join m on m.match_id = odds.match_id where outcome not in ('home_win', 'draw', 'away_win') group by 1, 2, 3
  union all select match_id, outcome, odds, case outcome {" ".join(f"when '{k}' then {v}" for k, v in blend.items())} end
  from odds join rates using (match_id) where outcome in ('home_win', 'draw', 'away_win')
)"""
    bets = lambda kelly, edge: f"""bets as (
  select priced.match_id, priced.outcome, p as p_model, 0.0::double as push, fair_p, 1 / priced.odds as book_p, priced.odds, p - fair_p as vs_fair, p * priced.odds - 1 as edge,
    greatest((p * priced.odds - 1) / (priced.odds - 1), 0) as kelly_full, {kelly} * greatest((p * priced.odds - 1) / (priced.odds - 1), 0) as stake
  from priced join fair on fair.match_id = priced.match_id and fair.outcome = priced.outcome where priced.odds > 1 and p * priced.odds - 1 >= {edge}
)"""  # noqa: E731
    folio = f"""{bets(0.5, 0.05)}, clipped as (select *, least(stake, 0.2) as c from bets), scaled2 as (
  select match_id, outcome, edge, c * case when sum(c) over () > 0.7 then 0.7 / sum(c) over () else 1 end as stake from clipped
), money as (select *, round_even(stake * 1000, 2) as stake_eur, round_even(stake * 1000 * edge, 2) as exp_profit_eur from scaled2)"""
    grid = """grid as (
  select unnest(generate_series((case when date_trunc('month', a) < a then date_trunc('month', a) + interval 1 month else date_trunc('month', a) end)::timestamp, b::timestamp, interval 1 month))::date as date
  from (select min(date) as a, max(date) as b from player_values)
)"""
    asof = lambda probes, days: f"""valued as (
  select p.*, case when date_diff('day', v.date, p.date) <= {days} then v.value_eur end as value_eur
  from ({probes}) p asof left join player_values v on p.player_id = v.player_id and p.date >= v.date
)"""  # noqa: E731
    hurt = "not exists (select 1 from injuries i where i.player_id = valued.player_id and valued.date between i.from_date and i.end_date)"
    debuts = "players as (select country, player_id, min(debut) as debut from pool group by 1, 2)"
    mv = f"""s as (select * from series), mv as (
  select m.*, case when date_diff('day', h.date, m.date) <= {stale} then h.mv_eur end as mv_home, case when date_diff('day', a.date, m.date) <= {stale} then a.mv_eur end as mv_away
  from matches m asof left join s h on m.home_team = h.country and m.date > h.date asof left join s a on m.away_team = a.country and m.date > a.date
), mvl as (
  select *, case when mv_home > 0 then log10(mv_home) end as mv_log_home, case when mv_away > 0 then log10(mv_away) end as mv_log_away from mv
), mvf as (select *, mv_log_home - mv_log_away as mv_log_diff, (mv_log_home - mv_log_away is null)::int as mv_missing from mvl)"""
    spells = f"""known as (select * from transfers where to_team_id is not null), sp as (
  select player_id, to_team_id as club, transfer_date as start, coalesce(lead(transfer_date) over (partition by player_id order by transfer_date, to_team_id), date '2100-01-01') as "end", to_team_name from known
), spells as (select player_id, club, start, "end" from sp where to_team_name is null or to_team_name not in ({", ".join(f"'{c}'" for c in NON_CLUBS)}))"""
    onset = """onset as (
  select a.player_id as lo, b.player_id as hi, min(greatest(a.start, b.start)) as onset from spells a join spells b
  on a.club = b.club and a.player_id < b.player_id and greatest(a.start, b.start) < least(a."end", b."end") group by 1, 2
)"""
    sides = "select match_id, date, 'home' as side, home_team as team from matches union all select match_id, date, 'away', away_team from matches"
    called = lambda body: f"""called as ({body}), {asof("select * from called", 1000000)}, v2 as (
  select match_id, max(v) filter (side = 'home') as mv_home, max(v) filter (side = 'away') as mv_away from (select match_id, side, sum(value_eur) as v from valued group by 1, 2) group by 1
) select match_id, round(mv_home, 6) as mv_home, round(mv_away, 6) as mv_away,
  (case when mv_home > 0 then log10(mv_home) end - case when mv_away > 0 then log10(mv_away) end is null)::int as mv_missing from matches left join v2 using (match_id)"""  # noqa: E731
    losses = """pr as (
  select *, [p_home, p_draw, 1 - p_home - p_draw] as proba, 1 / (1 + power(10.0, -(elo_home - elo_away) / 400)) as w from losses
), c as (select *, [greatest(1e-6, least(1, 0.75 * w)), 0.25, greatest(1e-6, least(1, 0.75 * (1 - w)))] as raw from pr
), base as (select *, list_transform(raw, lambda v: v / list_sum(raw)) as base from c
), ll as (select *, -ln(greatest(1e-15, least(1 - 1e-15, proba[target + 1]))) as ll_lr, -ln(greatest(1e-15, least(1 - 1e-15, base[target + 1]))) as ll_dc,
  abs(elo_home - elo_away) as gap, (elo_home + elo_away) / 2 as mean, least(elo_home, elo_away) as low, greatest(elo_home, elo_away) as high from base)"""
    slice_ = lambda name, key, where="true": f"""select '{name}' as report, ({key})::string as slice, count(*) as n, round(avg(ll_dc), 6) as dc_ll, round(avg(ll_lr), 6) as lr_ll,
  round(avg(ll_lr) - avg(ll_dc), 6) as edge, case when avg(ll_dc) < avg(ll_lr) then 'DC' else 'LR' end as winner from ll where {where} group by 1, 2"""  # noqa: E731
    quantile = lambda x, q: " + ".join(f"({x} > (select quantile_cont({x}, {i / q}) from ll where neutral))::int" for i in range(1, q))
    fav = "greatest(glicko_exp, 1 - glicko_exp)"
    cuts = lambda x, edges, labels: "case " + f"when {x} <= {edges[0]} then null " + " ".join(f"when {x} <= {e} then '{n}'" for e, n in zip(edges[1:], labels)) + " end"
    reports = [
        slice_("type", KIND),
        slice_("gap", cuts("gap", [-1, 50, 150, 300, 1e9], ["0-50", "50-150", "150-300", "300+"])),
        slice_("neutral", "neutral"),
        slice_("expectancy", cuts(fav, [0.35, 0.5, 0.65, 1.0], ["to 0.5", "to 0.65", "over 0.65"])),
        slice_("neutral mean quartile", quantile("mean", 4), "neutral"),
        slice_("neutral max quartile", quantile("high", 4), "neutral"),
        slice_("neutral min half", quantile("low", 2), "neutral"),
        slice_("neutral gap", cuts("gap", [-1, 100, 250, 1e9], ["0-100", "100-250", "250+"]), "neutral"),
        slice_("neutral elite", "'all'", "neutral and low >= (select quantile_cont(mean, 0.75) from ll where neutral)"),
    ]
    linear = "exp(0.2 + 0.004 * d + 0.3 * glicko_exp) as a, exp(0.0 * d + 0.1 * glicko_exp) as b, exp(-0.1 - 0.004 * d - 0.2 * glicko_exp) as c"
    return {
        "labels": with_(("matches",), " select match_id, date, home_team, away_team, case when home_score > away_score then 0 when home_score = away_score then 1 else 2 end as target, neutral::int as is_neutral from matches"),
        "competitive_recent": with_(("matches",), " select match_id, date, tournament from matches where not contains(lower(tournament), 'friendly') and date >= (select max(date) from matches) - interval 36 month"),
        "time_split": with_(("matches",), " select match_id, case when row_number() over (order by date, match_id) <= floor(count(*) over () * 0.8) then 'train' else 'test' end as part from matches"),
        "tournament_rules": with_(("matches",), f" select tournament, {K} as k, {CONFED} as confed, {KIND} as kind, not contains(lower(tournament), 'friendly') as competitive, count(*) as n from matches group by all"),
        "form_last10": FORM,
        "head_to_head": H2H,
        "elo": ELO,
        "elo_final": ELO_FINAL,
        "glicko": GLICKO,
        "glicko2": GLICKO2,
        "features": FEATURES,
        "context_features": CONTEXT,
        "team_confederations": with_(("matches",), f", {TEAM_CONFED} select * from tc"),
        "former_names": with_(
            ("matches", "former_names"),
            """ select match_id, coalesce(h.current, home_team) as home_team, coalesce(a.current, away_team) as away_team,
  (h.current is not null)::int + (a.current is not null)::int as renamed from matches m
  left join former_names h on h.former = home_team and m.date between h.start_date and h.end_date left join former_names a on a.former = away_team and m.date between a.start_date and a.end_date""",
        ),
        "market_value_asof": with_(("matches", "series"), f", {mv} select match_id, {r('mv_home', 'mv_away', 'mv_log_home', 'mv_log_away', 'mv_log_diff')}, mv_missing from mvf"),
        "covered_confederations": with_(
            ("matches", "series"),
            f", {mv}, tagged as (select *, {CONFED} as confed from mvf) select tournament, count(*) as n, round(avg(1 - mv_missing), 6) as coverage from tagged "
            "where confed in (select confed from tagged group by 1 having avg(1 - mv_missing) >= 0.33) group by 1",
        ),
        "latest_top10": with_(("series",), " select country, date, round(mv_eur, 6) as mv_eur from (select *, row_number() over (partition by country order by date desc) as n from series) where n = 1 order by mv_eur desc, country limit 10"),
        "aligned_names": with_(("series",), " select case country when 'T1' then 'North' when 'T2' then 'South' else country end as country, count(*) as n, round(max(mv_eur), 6) as mv_eur from series group by 1"),
        "player_asof": with_(("pool", "player_values"), f", {grid}, {asof('select distinct player_id, date from pool, grid', live)} select player_id, date, round(value_eur, 6) as value_eur from valued where value_eur is not null"),
        "uninjured_values": with_(("player_values", "injuries"), f" select player_id, date, round(value_eur, 6) as value_eur from player_values valued where {hurt}"),
        "squad_series": with_(
            ("pool", "player_values", "injuries"),
            f", {debuts}, {grid}, {asof('select country, player_id, debut, date from players, grid', live)}, ranked as ("
            f"select *, row_number() over (partition by country, date order by value_eur desc, player_id) as n from valued where value_eur is not null and (debut is null or date >= debut) and {hurt})"
            f" select country, date, round(avg(value_eur), 6) as mv_eur from ranked where n <= {top} group by 1, 2 having avg(value_eur) > 0",
        ),
        "squad_sums": with_(
            ("pool", "player_values"),
            f", {debuts}, {grid}, {asof('select country, player_id, debut, date from players, grid', live)}"
            " select country, date, round(sum(value_eur), 6) as mv_eur from valued where value_eur is not null and (debut is null or date >= debut) group by 1, 2 having sum(value_eur) > 0",
        ),
        "squads_without": with_(
            ("pool", "player_values", "injuries"),
            f", {debuts}, {grid}, {asof('select country, player_id, date from players, grid where month(date) = 1', live)}, ranked as ("
            f"select *, row_number() over (partition by country, date order by value_eur desc, player_id) as n from valued where value_eur is not null and player_id % 4 <> 0 and {hurt})"
            f" select country, date, player_id, round(value_eur, 6) as value_eur, n::int as rank from ranked where n <= {top}",
        ),
        "country_series": with_(
            ("pool", "player_values"),
            f", {grid}, {asof('select country, player_id, date from pool, grid', 1000000)} select country, date, round(sum(value_eur), 6) as squad_value_eur from valued group by 1, 2 having sum(value_eur) is not null",
        ),
        "editions_value": with_(
            ("matches", "editions", "player_values"),
            f', sides as ({sides}), ' + called('select match_id, side, s.date, player_id from sides s join editions e on e.country = s.team and s.date between e.start and e."end"'),
        ),
        "lineups_value": with_(
            ("matches", "lineups", "player_values"), f", sides as ({sides}), " + called("select match_id, side, s.date, player_id from sides s join lineups l on l.team = s.team and l.date = s.date")
        ),
        "recent_caps": with_(
            ("lineups",),
            """, days as (select team, date, row_number() over (partition by team order by date) as i from lineups group by 1, 2), ps as (select days.*, player_id from days join lineups using (team, date))
select a.date, a.team, count(distinct b.player_id) as n, sum(distinct b.player_id)::bigint as ids from days a join ps b on a.team = b.team and b.i between a.i - 3 and a.i - 1 group by 1, 2""",
        ),
        "team_names": with_(
            ("profiles",),
            """, c as (select team_id, trim(split_part(citizenship, '  ', 1)) as country, count(*) as n from profiles group by 1, 2), k as (
  select *, row_number() over (partition by team_id order by n desc, country) as i, sum(n) over (partition by team_id) as total from c)
select team_id, country from k where i = 1 and total >= 5 and n / total >= 0.6""",
        ),
        "club_spells": with_(("transfers",), f", {spells} select * from spells"),
        "teammate_onset": with_(("transfers",), f", {spells}, {onset} select * from onset"),
        "squad_chemistry": with_(
            ("transfers", "pool", "player_values"),
            f", {spells}, {onset}, {debuts}, {grid}, {asof('select country, player_id, date from players, grid where month(date) in (1, 7)', 400)}, ranked as ("
            "select *, row_number() over (partition by country, date order by value_eur desc, player_id) as n from valued where value_eur is not null), chosen as (select * from ranked where n <= 12), "
            "large as (select * from chosen where (country, date) in (select (country, date) from chosen group by country, date having count(*) >= 3))"
            " select a.country, a.date, round(avg((onset is not null and onset < a.date)::int), 6) as chem from large a join large b on a.country = b.country and a.date = b.date and a.player_id < b.player_id"
            " left join onset on lo = a.player_id and hi = b.player_id group by 1, 2",
        ),
        "fold_sizes": with_(
            ("matches",),
            """, b as (select (max(date) - interval 24 month)::date as b0, max(date) as last, 0 as fold from matches
  union all select (b0 + interval 3 month)::date, last, fold + 1 from b where b0 + interval 3 month < last
), f as (select fold, b0, (b0 + interval 3 month)::date as b1, (b0 - interval 36 month)::date as lo from b
), l as (select *, (home_score = away_score)::int as drawn from matches)
select fold, b0, b1, sum((date < b0)::int)::bigint as n_train, sum((date >= b0)::int)::bigint as n_test, round(avg(drawn) filter (date < b0), 6) as draw_rate
from f join l on date >= lo and date < b1 group by 1, 2, 3 having sum((date < b0)::int) >= 100 and sum((date >= b0)::int) > 0""",
            True,
        ),
        "prediction_metrics": with_(
            ("losses",),
            f""", {losses} select tournament, count(*) as n, round(avg(ll_lr), 6) as log_loss,
  round(avg(power(proba[1] - (target = 0)::int, 2) + power(proba[2] - (target = 1)::int, 2) + power(proba[3] - (target = 2)::int, 2)), 6) as brier,
  round(avg((list_position(proba, list_max(proba)) - 1 = target)::int), 6) as accuracy from ll group by 1""",
        ),
        "crude_baseline": with_(
            ("losses",),
            f""", b as (select target, [{1 - crude} * w, {crude}, {1 - crude} * (1 - w)] as q from (select *, 1 / (1 + power(10.0, -(elo_home - elo_away) / 400)) as w from losses)
), c as (select target, list_transform(list_transform(q, lambda x: greatest(1e-6, least(1.0, x))), lambda x: x / list_sum(list_transform(q, lambda y: greatest(1e-6, least(1.0, y))))) as p from b)
select count(*) as n, round(avg(-ln(greatest(1e-15, least(1 - 1e-15, p[target + 1])))), 6) as log_loss,
  round(avg(power(p[1] - (target = 0)::int, 2) + power(p[2] - (target = 1)::int, 2) + power(p[3] - (target = 2)::int, 2)), 6) as brier,
  avg((list_position(p, list_max(p)) - 1 = target)::int) as accuracy from c""".replace("avg((list", "round(avg((list").replace("= target)::int) as accuracy", "= target)::int), 6) as accuracy"),
        ),
        "resolved_players": with_(
            ("profiles", "pool"),
            """, n as (select *, concat('T', team_id::string) as country from profiles
), members as (select distinct country, player_id from pool
), hits as (
  select a.country, b.player_id, m.player_id is not null as in_pool, a.player_name from (select * from n where player_id % 2 = 1) a
  join profiles b on lower(trim(a.player_name)) = lower(trim(b.player_name)) left join members m on m.country = a.country and m.player_id = b.player_id
)
select country, player_id from n where player_id % 2 = 0
union select country, player_id from (select *, bool_or(in_pool) over (partition by country, player_name) as any_in from hits) where in_pool or not any_in""",
        ),
        "flags": with_(("matches",), " select match_id, match_id % 7 in (0, 1, 3, 4, 6) as yes, match_id % 7 in (0, 1, 4, 6) as or_no from matches"),
        "read_results": with_(("matches",), " select date, home_team, away_team, home_score::int as home_score, away_score::int as away_score, tournament, neutral from matches where match_id % 50 <> 0"),
        "read_former_names": with_(("former_names",), " select current, former, start_date, end_date from former_names"),
        "read_country_series": with_(("series",), " select country, date, round(mv_eur, 6) as mv_eur from series"),
        "read_market_values": with_(("player_values",), " select player_id::bigint as player_id, date, round(value_eur, 6) as value_eur from player_values where player_id % 9 <> 0"),
        "read_injuries": with_(("injuries",), " select player_id::bigint as player_id, from_date, end_date from injuries"),
        "read_pool": with_(("pool",), " select player_id::bigint as player_id, substr(country, 2)::bigint as team_id, debut from pool"),
        "read_transfers": with_(("transfers",), " select player_id::bigint as player_id, transfer_date, to_team_id::bigint as to_team_id, to_team_name from transfers"),
        "read_profiles": with_(("profiles",), " select player_id::bigint as player_id, player_name, trim(split_part(citizenship, '  ', 1)) as country from profiles"),
        "read_fixtures": with_(
            ("odds",),
            " select concat('H', match_id::string, ' vs A', match_id::string) as match, outcome, round(odds, 6) as odds, match_id % 3 <> 0 as neutral, match_id % 4 = 0 as wc"
            " from odds where outcome in ('home_win', 'draw', 'over_2.5') and odds > 1",
        ),
        "value_history": with_(
            ("player_values",),
            " select player_id::bigint as player_id, date, round(case when player_id % 2 = 0 then value_eur else floor(value_eur / 1000) * 1000 end, 6) as value_eur from player_values",
        ),
        "elo_baseline": with_(("losses",), f", {losses} select match_id, round(base[1], 6) as home, round(base[2], 6) as draw, round(base[3], 6) as away, {r('ll_dc', 'll_lr')} from ll"),
        "loss_slices": with_(("losses",), f", {losses} " + " union all ".join(reports)),
        "decay_weights": with_(
            ("matches",),
            " select match_id, round(power(0.5, date_diff('day', date, (select max(date) from matches)) / 730.0), 6) as w_lr, round(exp(-0.0004 * date_diff('day', date, (select max(date) from matches))), 6) as w_dc from matches",
        ),
        "odds_unpivoted": with_(("odds",), " select match_id, outcome, round(round(odds, 2), 6) as odds from odds where outcome in ('home_win', 'draw', 'away_win', 'over_2.5')"),
        "fair_odds": with_(("odds",), f", {FAIR} select match_id, outcome, round(odds, 6) as odds, market, round(fair_p, 6) as fair_p from fair", True),
        "fair_odds_multiplicative": with_(
            ("odds",), f", q as (select *, {MARKET} as market, 1 / odds as q from odds where odds > 1) select match_id, outcome, round(odds, 6) as odds, market, round(q / list_reduce(list_sort(list(q) over (partition by match_id, market)), lambda a, b: a + b), 6) as fair_p from q"
        ),
        "score_matrix": with_(("rates",), f", {_cells(1.0, rho)} select match_id, x::int as x, y::int as y, round(p, 6) as p from cells"),
        "derived_markets": with_(
            ("rates",),
            f""", {_cells(1.08, rho)} select match_id, {", ".join(f"round(coalesce(sum(p) filter ({c}), 0), 6) as {n}" for n, c in (
                ("home_win", "x > y"), ("draw", "x = y"), ("away_win", "x < y"), ("over_25", "x + y > 2.5"), ("goals_0_1", "x + y <= 1"), ("goals_2_3", "x + y in (2, 3)"),
                ("goals_4plus", "x + y >= 4"), ("home_cover", "x - y > 1"), ("push", "x - y = 1"), ("away_cover", "x - y < 1")))},
  round(1 - sum(p) filter (x + y > 2.5), 6) as under_25, round(sum(x * p), 6) as xg_home, round(sum(y * p), 6) as xg_away from cells group by 1""",
        ),
        "reconciled_markets": with_(("rates", "odds"), f", {priced} select match_id, outcome, {r('odds', 'p')} from priced"),
        "value_bets": with_(
            ("rates", "odds"), f", {priced}, {FAIR}, {bets(0.25, 0.03)} select match_id, outcome, {r('p_model', 'push', 'fair_p', 'book_p', 'odds', 'vs_fair', 'edge', 'kelly_full', 'stake')} from bets", True
        ),
        "portfolio": with_(("rates", "odds"), f", {priced}, {FAIR}, {folio} select match_id, outcome, {r('edge', 'stake', 'stake_eur', 'exp_profit_eur')} from money", True),
        "portfolio_totals": with_(
            ("rates", "odds"), f", {priced}, {FAIR}, {folio} select count(*) as n_bets, round(sum(stake_eur), 6) as stake_eur, round(sum(exp_profit_eur), 6) as exp_profit_eur from money", True
        ),
        "linear_scores": with_(
            ("losses",),
            f" select match_id, round(a / (a + b + c), 6) as home, round(b / (a + b + c), 6) as draw, round(c / (a + b + c), 6) as away from (select match_id, {linear} from (select *, elo_home - elo_away as d from losses))",
        ),
        "money_values": with_(
            ("matches",),
            """, v as (select match_id, case match_id % 6 when 0 then (match_id % 97) * 1e3 when 1 then (match_id % 97) * 1e6 when 2 then (match_id % 97) * 1e3
  when 3 then ((match_id % 97) + 0.5) * 1e6 when 4 then null else (match_id % 97) * 1.0 end::double as value_eur from matches)
select match_id, round(value_eur, 6) as value_eur, round(case when value_eur > 0 then log10(value_eur) end, 6) as log_value from v""",
        ),
    }
