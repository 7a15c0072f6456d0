"""Reproducible global shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in key order; a keyed Feistel network permutes the smallest even-bit domain that holds
n values, and values of n or more are walked along their cycle until they fall below n. The permuted number p
gives shard ``p % shards`` and slot ``p // shards``: counts differ by one at most, slots are gapless, and either
can be computed again from the row number alone. All of it is expressed in SQL functions.

Edge cases: a null text counts as the empty text (size 1, CRC 0); null keys are numbered first; ties of the whole
order and repeated rows are numbered apart; an empty table gives an empty result; extra columns of any names pass
through, but for row_no, shard and slot, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import numbered, table

SHARDS = 16
SEED = 20_240_229
ROUNDS = 8
WALK = 256  # a step leaves the range with a chance under 3/4: 256 of them under 1e-31, and then an error, not a loss
PRIME = 2_147_483_647


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """An odd multiplier and an addend for each round, below 2**30, from a 64-bit mixing sequence."""
    out, state = [], seed & (1 << 64) - 1
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            state = (state + 0x9E3779B97F4A7C15) % (1 << 64)
            z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
            pair.append((z ^ z >> 31) >> 34)
        out.append((pair[0] | 1, pair[1]))
    return out


def half_bits(n: int) -> int:
    """Half the width of the smallest even-bit domain with at least n values."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def permute(x: int, n: int, seed: int = SEED) -> int:
    """The permutation in plain Python, for tests and for looking up one row."""
    h = half_bits(n)
    mask = (1 << h) - 1
    while True:
        left, right = x >> h, x & mask
        for m, c in round_keys(seed):
            left, right = right, left ^ ((right * m + c) % PRIME & mask)
        x = left << h | right
        if x < n:
            return x


def permuted(row: Column, n: int, seed: int = SEED) -> Column:
    """The same permutation as a column."""
    h = half_bits(n)
    mask = F.lit((1 << h) - 1).cast("long")
    keys = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c")) for m, c in round_keys(seed)])

    def network(x: Column) -> Column:
        start = F.struct(F.shiftright(x, h).alias("l"), x.bitwiseAND(mask).alias("r"))
        return F.aggregate(
            keys,
            start,
            lambda s, k: F.struct(
                s["r"].alias("l"),
                s["l"].bitwiseXOR(((s["r"] * k["m"] + k["c"]) % F.lit(PRIME)).bitwiseAND(mask)).alias("r"),
            ),
            lambda s: F.shiftleft(s["l"], h).bitwiseOR(s["r"]),
        )

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), network(row), lambda x, _: F.when(x < n, x).otherwise(network(x))
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shard_rows(df: DataFrame, order: list[Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` (with columns of the caller's choice, narrow ones best) plus ``shard`` int and ``slot`` long.

    ``order`` must order all rows but equal ones. Law: ``rows``.
    """
    rows, n = numbered(df, order, "shard")
    kept = F.struct(*[rows[f"`{c}`"] for c in rows.columns if c not in ("shard", "slot")]).alias("row")
    placed = rows.select(kept, permuted(F.col("row_no"), n, seed).alias("p"))
    slot = F.floor(F.col("p") / shards).cast("long") if shards & (shards - 1) else F.shiftright("p", shards.bit_length() - 1)
    return placed.select("row.*", (F.col("p") % shards).cast("int").alias("shard"), slot.alias("slot"))


def op3_feistel_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "text_crc32", "size")]
    return shard_rows(docs, order).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", "row_no", F.lit(None).cast("int").alias("grown_shard")
    )


def oracle_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """DuckDB: the rounds as nested selects, the walk and the CRC (bit by bit table, then byte by byte) in SQL."""

    def network(source: str) -> str:
        sql = f"select row_no, x >> (select h from dom) as l, x & (select mask from dom) as r from {source}"
        for m, c in round_keys(seed):
            sql = f"select row_no, r as l, xor(l, ((r * {m} + {c}) % {PRIME}) & (select mask from dom)) as r from ({sql})"
        return f"select row_no, (l << (select h from dom)) | r as x from ({sql})"

    return f"""
with recursive crc_bits as (
  select range as i, range::bigint as c, 0 as k from range(256)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_bits where k < 8
), crc_table as (select list(c order by i) as t from crc_bits where k = 8
), bytes as (
  select doc_id, text, encode(coalesce(text, '')) as b, row_number() over () as u from documents
), summed as (
  select doc_id, octet_length(b) + 1 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), i::bigint * 2 + 1, 2))::bigint)),
      lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) as text_crc32
  from bytes, crc_table
), dom as materialized (
  select greatest(1, (ceil(log2(greatest(count(*), 2)))::bigint + 1) // 2) as h,
    (1::bigint << greatest(1, (ceil(log2(greatest(count(*), 2)))::bigint + 1) // 2)) - 1 as mask, count(*) as n from documents
), numbered as materialized (
  select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as row_no from summed
), walk as (
  {network("(select row_no, row_no as x from numbered)")}
  union all
  {network("(select row_no, x from walk where x >= (select n from dom))")}
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, (x % {shards})::int as shard,
  (x // {shards})::bigint as slot, row_no::bigint as row_no, null::int as grown_shard
from numbered join walk using (row_no) where x < (select n from dom)
"""
