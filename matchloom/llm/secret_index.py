"""Secret scanning through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query of trigrams that any match must contain (an OR of
ANDs, over lower-cased text). One scan posts (trigram, document) pairs for the trigrams that the rules can ask
for; grouping the postings by document intersects them; a document that satisfies a rule's query is a candidate
and only candidates are searched with that rule's expression. Rules without mandatory trigrams search every text.

Postings of a document all come from its row, so they are combined before the shuffle and no posting list, however
long, meets in one task. The candidates join the documents by broadcast while their count, which is known by then,
stays under ``broadcast_rows``, and by a shuffled join beyond it.

Edge cases: a null text counts as empty; null ids are looked up like any other; documents that share an id share
candidacy, which adds work but no span; repeated rows are kept; an empty table gives an empty result.
Spans are (start, end, kind) in code points, the end exclusive. Only functions of DataFrame and SQL are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table

BROADCAST_ROWS = 500_000
CLAUSES = 24  # a query with more alternatives is given up in favour of fewer trigrams
WORD = 62  # trigrams in a long


@dataclass(frozen=True)
class Rule:
    """``pattern`` must read the same in Java, RE2 and Python. A match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules of the contract, then well-known token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
)
BASE = 3

Query = frozenset  # of clauses, each a frozenset of trigrams; {frozenset()} asks for nothing


def _trigrams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _join(parts: set[str | None], more: set[str | None]) -> set[str | None]:
    return {None if a is None or b is None else a + b for a in parts for b in more}


def _strings(item) -> set[str] | None:
    """All strings that one parsed item matches, or None if they are too many to list."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and not any(x is sre.NEGATE or x is sre.CATEGORY for x, _ in arg):
        found = set()
        for x, v in arg:
            found |= {chr(v)} if x is sre.LITERAL else {chr(c) for c in range(v[0], min(v[1], v[0] + 30) + 1)}
        found = {c.lower() for c in found}
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        each = [_sequence_strings(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = _sequence_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence_strings(items) -> set[str] | None:
    found = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(found) * len(more) > CLAUSES:
            return None
        found = {a + b for a in found for b in more}
    return found


def _and(a: Query, b: Query) -> Query:
    both = frozenset(x | y for x in a for y in b)
    return both if len(both) <= CLAUSES else a


def trigram_query(pattern: str) -> Query:
    """Clauses of which every match of ``pattern`` satisfies one, over its lower-cased text."""

    def walk(items) -> Query:
        query, run = Query([frozenset()]), {""}

        def flush() -> None:
            nonlocal query, run
            query, run = _and(query, Query(_trigrams(s) for s in run)), {""}

        for item in items:
            some = _strings(item)
            if some is not None and len(run) * len(some) <= CLAUSES:
                run = {a + b for a in run for b in some}
                continue
            flush()
            if some is not None:
                run = some
            elif item[0] is sre.SUBPATTERN:
                query = _and(query, walk(item[1][3]))
            elif item[0] is sre.BRANCH:
                query = _and(query, Query(c for x in item[1][1] for c in walk(x)))
            elif item[0] is sre.MAX_REPEAT and item[1][0] >= 1:
                query = _and(query, walk(item[1][2]))
        flush()
        return query

    query = walk(sre_parser.parse(pattern))
    # a clause that asks for all that another asks for, and more, adds no candidate
    return Query(c for c in query if not any(d < c for d in query))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for c in trigram_query(r.pattern) for g in c})


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: ``gram`` (its place in ``grams``) and ``doc_id``, a row for each trigram of a document."""
    low = docs.select("doc_id", F.lower("text").alias("low")).where("low is not null")
    held = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(grams)]), lambda x: F.contains("low", x["g"]))
    return low.select("doc_id", F.explode(F.transform(held, lambda x: x["i"])).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """``doc_id`` and ``rules``, the bits of the rules whose trigram query the document's postings satisfy."""
    words = range((len(grams) + WORD - 1) // WORD)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % WORD)
    sets = index.groupBy("doc_id").agg(
        *[F.bit_or(F.when(F.floor(F.col("gram") / WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words]
    )
    at = {g: i for i, g in enumerate(grams)}

    def holds(clause: frozenset) -> Column:
        masks: dict[int, int] = {}
        for g in clause:
            masks[at[g] // WORD] = masks.get(at[g] // WORD, 0) | 1 << at[g] % WORD
        met = F.lit(True)
        for w, m in masks.items():
            met = met & (F.col(f"w{w}").bitwiseAND(F.lit(m)) == m)
        return met

    found = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if frozenset() not in query:
            met = F.lit(False)
            for clause in sorted(query, key=sorted):
                met = met | holds(clause)
            found = found.bitwiseOR(F.when(met, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return sets.select("doc_id", found.alias("rules")).where("rules != 0")


def _before(lengths: Column) -> Column:
    """For each length the sum of those before it; blocks keep the cost near linear."""
    block = 256
    zero = F.lit(0).cast("long")
    run = lambda xs, at: F.aggregate(xs, F.array(at), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    starts = run(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), zero)
    return F.flatten(F.transform(blocks, lambda b, i: F.slice(run(b, F.get(starts, i)), F.lit(1), F.size(b))))


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """``array<struct<start, kind, end>>`` of one rule's counted matches in a text."""
    pattern = F.lit(rule.pattern)
    hits, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    # the text before each match, the match, and whether it counts; a last piece without a match has a null one
    parts = F.arrays_zip(
        F.transform(pieces, lambda p: F.length(p).cast("long")).alias("gap"),
        F.transform(hits, lambda h: F.length(h).cast("long")).alias("len"),
        F.transform(counted, lambda g: F.length(g) >= rule.least).alias("ok"),
    )
    lengths = F.transform(parts, lambda p: p["gap"] + F.coalesce(p["len"], F.lit(0)))
    placed = F.zip_with(
        parts,
        _before(lengths),
        lambda p, at: F.struct((at + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + p["gap"] + p["len"]).alias("end"), p["ok"].alias("ok")),
    )
    return F.transform(F.filter(placed, lambda p: p["ok"]), lambda p: F.struct(p["start"], p["kind"], p["end"]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` (with doc_id and text) plus ``secret_spans``, in order of start, kind and end."""
    grams = vocabulary(rules)
    found = materialise(candidates(postings(docs, grams), rules, grams), "secrets").withColumnsRenamed({"doc_id": "_id", "rules": "_rules"})
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left").drop("_id")
    empty = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")
    text = F.coalesce(F.col("text"), F.lit(""))
    each = []
    for k, rule in enumerate(rules):
        if frozenset() in trigram_query(rule.pattern):
            asked = text.rlike(rule.pattern)
        else:
            asked = F.coalesce(F.col("_rules"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        each.append(F.when(asked, rule_spans(text, rule, k)).otherwise(empty))
    return joined.withColumn("secret_spans", F.array_sort(F.concat(*each))).drop("_rules")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans give one mark."""
    spans = scan(docs, rules)
    # a gap runs from the furthest end so far to the next start beyond it
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    kept = F.aggregate(
        "secret_spans",
        start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(a["out"], F.array(F.substr("text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")))),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(F.array_join(F.concat(a["out"], F.array(F.lit(""))), mark), F.substr("text", (a["at"] + 1).cast("int"))),
    )
    return spans.withColumn("text", F.when(F.size("secret_spans") > 0, kept).otherwise(F.col("text"))).drop("secret_spans")


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op6_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "secret_spans")
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{RULES[k].kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in range(BASE)],
        F.sha2(_listed(F.filter("secret_spans", lambda s: s["kind"] < BASE), RULES), 256).alias("base_sha256"),
        _listed(F.col("secret_spans"), RULES).alias("spans"),
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    quoted = lambda r: "'" + r.pattern.replace("'", "''") + "'"
    kinds = "\n  union all ".join(
        f"select u, {k} as kind, '{r.kind}' as name, regexp_extract_all(text, {quoted(r)}) as hits, "
        f"regexp_extract_all(text, {quoted(r)}, {r.group}) as counted, regexp_split_to_array(text, {quoted(r)}) as pieces, {r.least} as least from t"
        for k, r in enumerate(rules)
    )
    base = ", ".join(f"count(*) filter (kind = {k}) as n_{rules[k].kind}" for k in range(BASE))
    return f"""
with t as materialized (select row_number() over () as u, doc_id, coalesce(text, '') as text from documents
), m as materialized (
  {kinds}
), placed as (
  select u, kind, name, i, length(hits[i]) as n, length(counted[i]) >= least as ok,
    list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as start
  from (select *, unnest(range(1, len(hits) + 1)) as i from m)
), s as (
  select u, kind, start::bigint as start, name || ':' || start::bigint || ':' || (start + n)::bigint as span from placed where ok
), g as (
  select u, {base}, coalesce(string_agg(span, ',' order by start, kind) filter (kind < {BASE}), '') as b, string_agg(span, ',' order by start, kind) as spans
  from s group by u
)
select doc_id, {", ".join(f"coalesce(n_{rules[k].kind}, 0)::bigint as n_{rules[k].kind}" for k in range(BASE))},
  sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
from t left join g using (u)
"""


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str]]:
    """All counted spans of one text, by Python's own engine."""
    found = []
    for k, r in enumerate(rules):
        found += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least]
    return [(a, b, rules[k].kind) for a, k, b in sorted(found)]
