"""Conversation formatting in budgeted, turn-aligned windows.

A conversation's turns are laid out in windows of at most ``budget`` tokens. Prefix sums of turn tokens choose the
spans: a window takes new turns while its repeated part and they fit. From the second window on, a window starts with
the conversation's system turn and with as many of the turns just before its span as fit in ``history`` tokens and,
beside the system turn and the first new turn, in the budget: history gives way first, then the system turn. So a
window is over the budget only if it is a single new turn that is over it by itself; no turn is cut or dropped.
Repeated turns carry another mark and no loss, so each assistant text is a target once.

Layout of a turn: ``<|turn|>`` (new) or ``<|past|>`` (repeated), role, ``<|text|>``, text, ``<|end|>``. In roles
and texts every ``<`` is written ``<.``, so no control string can occur there; ``<.`` read back is ``<``.

Tokens of a turn: a quarter of its code points, rounded up, plus ``TURN_TOKENS`` for its marks.

Edge cases: null role or text counts as empty; rows with a null conversation id are each a conversation of one turn;
rows of one conversation are ordered by (turn, role, text), nulls first, repeated rows kept; a system turn after the
first is repeated in the windows after it; an empty table gives no windows; columns but conv_id, turn, role and text
are not read. Only functions of DataFrame and SQL are used. A conversation is gathered in one row, as its digest asks
for; its windows are sliced there, so that each row of them holds its own turns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table

BUDGET = 512
HISTORY = 128
TURN_TOKENS = 4
TURN, PAST, TEXT, END = "<|turn|>", "<|past|>", "<|text|>", "<|end|>"
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<"), F.lit("<."))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<."), F.lit("<"))


def gathered(turns: DataFrame) -> DataFrame:
    """One row for each conversation: ``conv_id, turns array<struct<turn, role, text, n>>`` in order."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        text.alias("text"),
        (F.ceil(F.length(text) / 4).cast("long") + TURN_TOKENS).alias("n"),
    )
    known = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return known.unionByName(turns.where("conv_id is null").select("conv_id", F.array(row).alias("turns")))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, formatted, loss``: loss holds (start, length) spans in code points, escaped text included."""
    zero, none = F.lit(0).cast("long"), F.lit(-1)
    # One fold over the turns chooses the windows. Its state: tokens before the turn; place and tokens of the first
    # system turn so far, and tokens before it; tokens before each of the latest turns that fit in the history; tokens
    # that the open window repeats, and tokens before it; and the windows. Nothing looks back further, so a turn's
    # cost is bounded.
    state = F.struct(
        F.lit(0).alias("i"),
        zero.alias("at"),
        none.alias("sys"),
        zero.alias("sys_n"),
        zero.alias("sys_at"),
        F.expr("cast(array() as array<bigint>)").alias("recent"),
        zero.alias("base"),
        zero.alias("since"),
        F.expr("cast(array() as array<struct<s: int, past: int, sys: int>>)").alias("opened"),
    )

    def opening(a: Column, t: Column) -> Column:
        """The window that the turn opens, and how many tokens it repeats."""
        room = F.lit(budget) - t["n"]
        again = (a["sys"] >= 0) & (a["sys_n"] <= room)  # the system turn fits beside the turn
        apart = lambda x: F.when(again & (a["sys_at"] < x), a["sys_n"]).otherwise(zero)  # noqa: E731  and stands before x
        back = F.filter(a["recent"], lambda x: a["at"] - x + apart(x) <= room)
        from_ = F.coalesce(F.get(back, F.lit(0)), a["at"])
        opened = F.struct(a["i"].alias("s"), (a["i"] - F.size(back)).alias("past"), F.when(again, a["sys"]).otherwise(none).alias("sys"))
        return F.struct(opened.alias("w"), F.when(a["i"] == 0, zero).otherwise(a["at"] - from_ + apart(from_)).alias("base"))

    def step(a: Column, t: Column) -> Column:
        system = (a["sys"] == -1) & (t["role"] == "system")
        opens = (a["i"] == 0) | (a["base"] + a["at"] + t["n"] - a["since"] > budget)
        new = F.when(opens, opening(a, t))
        recent = F.when(system & (a["i"] == 0), a["recent"]).otherwise(F.concat(a["recent"], F.array(a["at"])))
        return F.struct(
            (a["i"] + 1).alias("i"),
            (a["at"] + t["n"]).alias("at"),
            F.when(system, a["i"]).otherwise(a["sys"]).alias("sys"),
            F.when(system, t["n"]).otherwise(a["sys_n"]).alias("sys_n"),
            F.when(system, a["at"]).otherwise(a["sys_at"]).alias("sys_at"),
            F.filter(recent, lambda x: a["at"] + t["n"] - x <= history).alias("recent"),
            F.coalesce(new["base"], a["base"]).alias("base"),
            F.when(opens, a["at"]).otherwise(a["since"]).alias("since"),
            F.concat(a["opened"], F.array_compact(F.array(new["w"]))).alias("opened"),
        )

    convs = gathered(turns).withColumn("opened", F.aggregate("turns", state, step, lambda a: a["opened"]))

    def cut(w: Column, k: Column) -> Column:
        """A window's own turns: repeated ones, and new ones up to the next window."""
        end = F.coalesce(F.get("opened", k + 1)["s"], F.size("turns"))
        past = F.when(w["s"] == 0, 0).otherwise(w["past"])
        again = (w["sys"] >= 0) & (w["sys"] < past)
        system = F.slice("turns", F.when(again, w["sys"] + 1).otherwise(1), F.when(again, 1).otherwise(0))
        return F.struct(
            F.concat(system, F.slice("turns", past + 1, w["s"] - past)).alias("past"),
            F.slice("turns", w["s"] + 1, end - w["s"]).alias("new"),
        )

    spans = convs.select("conv_id", F.posexplode(F.transform("opened", cut)).alias("window", "w"))
    show = lambda mark: lambda t: F.struct(
        F.concat(F.lit(mark), escape(t["role"]), F.lit(TEXT)).alias("head"),
        escape(t["text"]).alias("body"),
        (F.lit(mark == TURN) & (t["role"] == "assistant")).alias("loss"),
    )
    shown = spans.select(
        "conv_id",
        F.col("window").cast("int").alias("window"),
        F.concat(F.transform("w.past", show(PAST)), F.transform("w.new", show(TURN))).alias("parts"),
    )
    start = F.struct(zero.alias("at"), F.expr("cast(array() as array<struct<start: bigint, len: bigint>>)").alias("spans"))
    loss = F.aggregate(
        "parts",
        start,
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).cast("long").alias("at"),
            F.when(
                x["loss"],
                F.concat(
                    a["spans"],
                    F.array(F.struct((a["at"] + F.length(x["head"])).cast("long").alias("start"), F.length(x["body"]).cast("long").alias("len"))),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return shown.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        loss.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse windows: ``conv_id, turns array<struct<role, text>>`` without repeats, and ``targets array<string>``."""
    pieces = F.filter(F.split("formatted", r"\<\|end\|\>", -1), lambda x: F.startswith(x, F.lit(TURN)))
    one = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
            unescape(F.substring_index(x, TEXT, -1)).alias("text"),
        ),
    )
    each = formatted.select(
        "conv_id",
        F.struct(
            "window",
            one.alias("turns"),
            F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, s["len"].cast("int")))).alias("targets"),
            F.length("formatted").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = each.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("w"), lambda a, b: a["window"] - b["window"]).alias("ws"))
    whole = whole.unionByName(each.where("conv_id is null").select("conv_id", F.array("w").alias("ws")))  # of one window each
    return whole.select(
        "conv_id",
        F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
        F.flatten(F.transform("ws", lambda w: w["targets"])).alias("targets"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("chars"),
        F.size("ws").cast("long").alias("n_windows"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations plus conversation -1, whose two texts consist of control strings of other templates."""
    rows = [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)]
    probe = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = materialise(windows(with_probe(table(spark, sf_dir, "conversations"))), "chat")
    target = F.array_join("targets", "")
    return read_back(out).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"),
        F.sha2(target, 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
        "n_windows",
    )


def oracle_sql(budget: int = BUDGET, history: int = HISTORY) -> str:
    marks = len(TURN) + len(TEXT) + len(END)
    return f"""
with recursive given as (
  select case when conv_id is null then 'row ' || row_number() over () else conv_id::varchar end as key, conv_id, turn,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select '-1', -1, 0, 'user', '{PROBE}' union all select '-1', -1, 1, 'assistant', '{PROBE}'
), t as materialized (
  select *, row_number() over (partition by key order by turn nulls first, role, text) - 1 as i,
    ceil(length(text) / 4.0)::bigint + {TURN_TOKENS} as n,
    length(replace(text, '<', '<.')) + length(replace(role, '<', '<.')) + {marks} as w
  from given
), u as materialized (
  select *, sum(n) over (partition by key order by i) - n as before,
    min(case when role = 'system' then i end) over (partition by key) as sys from t
), fits as materialized (
  -- a window that opens at a: does the system turn fit, and which turns b may its history begin with?
  select a.key, a.i, a.before, a.n, case when a.sys < a.i and s.n + a.n <= {budget} then a.sys end as sys, s.n as sys_n
  from u a left join u s on s.key = a.key and s.i = a.sys
), p as materialized (
  select f.key, f.i, any_value(f.before) as before, any_value(f.n) as n, any_value(f.sys) as sys, any_value(f.sys_n) as sys_n, min(b.i) as past
  from fits f join u b on b.key = f.key and b.i <= f.i
  where b.i = f.i or (f.before - b.before <= {history} and not (b.i = 0 and b.role = 'system')
    and f.before - b.before + case when f.sys < b.i then f.sys_n else 0 end + f.n <= {budget})
  group by f.key, f.i
), c as materialized (
  select p.*, case when p.i = 0 then 0 else p.before - q.before + case when p.sys < p.past then p.sys_n else 0 end end as base
  from p join u q on q.key = p.key and q.i = p.past
), walk as (
  select key, i, i as start from c where i = 0
  union all
  select c.key, c.i, case when b.base + c.before + c.n - b.before > {budget} then c.i else walk.start end
  from walk join c on c.key = walk.key and c.i = walk.i + 1
  join c b on b.key = walk.key and b.i = walk.start
), extra as (
  select s.key, sum(r.w) as w from (select distinct key, start from walk where start > 0) s
  join c on c.key = s.key and c.i = s.start
  join u r on r.key = s.key and (r.i >= c.past and r.i < c.i or r.i = c.sys and c.sys < c.past) group by 1
), shown as (
  select key, any_value(conv_id) as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
    sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
    sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by i)) as loss_sha256, sum(w) as w
  from u group by 1
), counted as (select key, count(distinct start) as n_windows from walk group by 1)
select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (shown.w + coalesce(extra.w, 0))::bigint as formatted_chars, n_windows
from shown left join extra on extra.key = shown.key
join counted on counted.key = shown.key
"""
