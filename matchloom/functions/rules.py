"""Keyword rules over tournament names, as columns and as SQL text from one table each.

A rule is (any of these substrings, none of those, result); the first that holds decides. Names are compared in
lower case; a null name is the empty string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Match importance by tournament, in order of precedence.
K_FACTORS = [
    (["world cup"], [], 75.0),
    (["olympic"], [], 30.0),
    (["confederations"], [], 50.0),
    (["uefa euro"], [], 50.0),
    (["copa am"], [], 50.0),
    (["african cup"], [], 50.0),
    (["afc asian"], [], 50.0),
    (["gold cup"], [], 50.0),
    (["uefa nations"], [], 40.0),
    (["qualification"], [], 30.0),
    (["qualifier"], [], 30.0),
    (["friendly"], [], 10.0),
]
DEFAULT_K = 30.0

# Confederations by tournament.
CONFEDERATIONS = [
    (["world cup"], ["qualif"], "FIFA World Cup"),
    (["world cup"], [], "World Cup qualifiers"),
    (["uefa", "euro", "nations league"], ["concacaf"], "UEFA"),
    (["copa am", "conmebol", "superclásico de las américas"], [], "CONMEBOL"),
    (["concacaf", "gold cup", "caribbean", "uncaf", "cccf", "nafc", "central american"], [], "CONCACAF"),
    (["african", "africa", "cosafa", "cecafa", "afcon", "udeac", "cabral", "wafu", "nile", "uniffac"], [], "CAF"),
    (
        ["afc", "asian", "gulf", "aff ", "saff", "eaff", "cafa", "waff", "challenge cup", "asean", "king", "merdeka", "nehru", "arab", "south asian", "dynasty", "kirin"],
        [],
        "AFC",
    ),
    (["oceania", "ofc", "pacific", "melanesia", "polynesia", "south pacific"], [], "OFC"),
]
DEFAULT_CONFEDERATION = "Other/regional"
CONTINENTAL = ["UEFA", "CONMEBOL", "CONCACAF", "CAF", "AFC", "OFC"]

# Kinds of matches.
MATCH_TYPES = [
    (["world cup"], ["qualif"], "World Cup finals"),
    (["qualif"], [], "Qualifier"),
    (["uefa", "copa", "african", "asian", "gold cup", "nations league", "euro", "confederations"], [], "Continental"),
]
DEFAULT_MATCH_TYPE = "Other competitive"


def decide(name: Column, rules: list, default) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))

    def holds(some: list[str], none: list[str]) -> Column:
        met = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in some])
        return reduce(lambda a, s: a & ~F.contains(low, F.lit(s)), none, met)

    chain = reduce(lambda c, r: (c.when if c is not None else F.when)(holds(r[0], r[1]), F.lit(r[2])), rules, None)
    return chain.otherwise(F.lit(default))


def decide_sql(name: str, rules: list, default) -> str:
    """The same rules as SQL that both Spark and DuckDB read."""
    low = f"lower(coalesce({name}, ''))"
    quoted = lambda v: f"cast({v} as double)" if isinstance(v, float) else f"'{v}'"

    def holds(some: list[str], none: list[str]) -> str:
        met = " or ".join(f"contains({low}, '{s}')" for s in some)
        return f"({met})" + "".join(f" and not contains({low}, '{s}')" for s in none)

    return "case " + " ".join(f"when {holds(s, n)} then {quoted(v)}" for s, n, v in rules) + f" else {quoted(default)} end"


def k_factor(tournament: Column) -> Column:
    return decide(tournament, K_FACTORS, DEFAULT_K)


def confederation(tournament: Column) -> Column:
    return decide(tournament, CONFEDERATIONS, DEFAULT_CONFEDERATION)


def match_type(tournament: Column) -> Column:
    return decide(tournament, MATCH_TYPES, DEFAULT_MATCH_TYPE)


def is_competitive(tournament: Column) -> Column:
    return ~F.contains(F.lower(F.coalesce(tournament, F.lit(""))), F.lit("friendly"))


def margin_multiplier(goal_diff: Column) -> Column:
    """Wins by more than one goal move ratings more."""
    g = F.abs(goal_diff)
    return F.when(g <= 1, 1.0).when(g == 2, 1.5).otherwise((g + 11) / 8.0)


def flag(text: Column, default: bool) -> Column:
    """A yes/no field of a CSV; blank takes the default. ``1.0`` counts as yes."""
    return F.when(text.isNull() | (F.trim(text) == ""), default).otherwise(F.lower(F.trim(text)).isin("1", "1.0", "true", "yes", "y", "t"))


def money(text: Column) -> Column:
    """Amounts such as ``€2.50m``, ``800k`` or ``1,2 mio`` in units; what can't be read is null."""
    bare = F.trim(F.replace(F.lower(text), F.lit("€"), F.lit("")))
    scale = (
        F.when(bare.rlike("(m|mio)$"), 1e6).when(bare.rlike("(th\\.|k|tsd)$"), 1e3).otherwise(1.0)
    )
    number = F.replace(F.trim(F.regexp_replace(bare, "(mio|m|th\\.|k|tsd)$", "")), F.lit(","), F.lit("."))
    return number.try_cast("double") * scale


def safe_log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))
