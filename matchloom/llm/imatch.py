"""I-Match fingerprints over randomised lexicons.

Document frequencies of all terms are counted over all documents. The lexicon has the terms whose inverse document
frequency ln(n / df) lies in a band. Its size doesn't grow with the number of documents: the terms within idf H
number at most e^H times the mean count of distinct terms in a document. Up to ``BROADCAST_TERMS`` of them, which is
checked, are broadcast; more are joined to the documents' distinct terms by a shuffle. A document's fingerprint has one hash for each of several randomised lexicon subsets: the document's
distinct terms in the subset, sorted, are hashed. Subsets thin out by powers of two, with a few seeds for each
power, so that texts of any length have subsets in which only a few of their terms count; there an edit of part of a
text may leave the hash alone, and in dense ones any edit of a counted term changes it.

Likeness of two fingerprints: of the subsets in which either text has terms, the share in which their hashes agree.

A text without terms in the lexicon is hashed whole, so equal texts always have equal fingerprints. Edge cases:
null counts as empty; null ids come last, and those of one id are ordered by a hash of the text, then by the text, so
that bands can cut through an id that many rows have; with one document, the next one is itself; repeated rows are
kept; columns but doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import forget, materialise, partitions, slices, table

IDF_LOW, IDF_HIGH = 0.5, 7.0
LEVELS, SEEDS = 12, 8
BUCKETS = 1 << 20
BROADCAST_TERMS = 500_000


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+"))


def lexicon(docs: DataFrame, idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH) -> DataFrame:
    """``term, df`` of the terms in the band; terms are lower-cased runs without white space.

    Rare terms, most of all, never travel: first the documents with any term of a hash bucket are counted for
    ``BUCKETS`` buckets, and only terms of buckets frequent enough for the band are then counted themselves. Buckets
    that frequent are bounded as the lexicon is.
    """
    n = docs.count()
    least = n * math.exp(-idf_high)
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    crowded = docs.select(F.explode(F.array_distinct(F.transform(distinct_words(F.col("text")), bucket))).alias("bucket"))
    # at most BUCKETS numbers, so it can be broadcast whatever the input
    crowded = materialise(crowded.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("bucket"), "buckets")
    words = docs.select(F.explode(distinct_words(F.col("text"))).alias("term")).withColumn("bucket", bucket(F.col("term")))
    counted = words.join(F.broadcast(crowded), "bucket").groupBy("term").agg(F.count("*").alias("df"))
    return counted.where((F.col("df") >= least) & (F.col("df") <= n * math.exp(-idf_low)) & (F.col("term") != ""))


class Fingerprinter:
    """Fingerprints of texts: an array of one 64-bit hash for each subset, zero where the text has no term in it."""

    def __init__(self, terms: list[str] = (), levels: int = LEVELS, seeds: int = SEEDS) -> None:
        from xxhash import xxh64_intdigest

        self.hash, self.levels, self.seeds, self.subsets = xxh64_intdigest, levels, seeds, levels * seeds
        self.place = {w.encode(): i for i, w in enumerate(sorted(terms))}
        self.terms = frozenset(self.place)
        self.keys = self.keys_of(self.place)
        self.member = self.members(self.keys)

    def keys_of(self, terms) -> np.ndarray:
        return np.fromiter(map(self.hash, terms), np.uint64, len(terms))

    def members(self, keys: np.ndarray) -> np.ndarray:
        """In a subset are the terms whose salted hash ends in as many zero bits as its level says."""
        out = np.empty((len(keys), self.subsets), bool)
        for k in range(self.subsets):
            out[:, k] = stirred(keys, k + 1) & np.uint64((1 << k // self.seeds) - 1) == 0
        return out

    def whole(self, text: str) -> int:
        """What stands for a text without terms."""
        return self.hash(text.encode(), 7) | 1

    def __call__(self, text: str) -> np.ndarray:
        found = self.terms.intersection(text.lower().encode().split())  # bytes are split at ASCII white space only
        if not found:
            return np.full(self.subsets, self.whole(text), np.uint64)
        at = np.array(sorted(map(self.place.__getitem__, found)))
        return self._hashed(self.keys[at], self.member[at])

    def of_terms(self, terms: list[str] | None, whole: int) -> np.ndarray:
        """The same from a text's terms in the lexicon."""
        if not terms:
            return np.full(self.subsets, whole, np.uint64)
        keys = self.keys_of(sorted(w.encode() for w in terms))
        return self._hashed(keys, self.members(keys))

    def _hashed(self, keys: np.ndarray, member: np.ndarray) -> np.ndarray:
        """``keys`` in the order of their terms."""
        subset, nth = np.nonzero(member.T)
        data = keys[nth].tobytes()
        ends = np.searchsorted(subset, np.arange(self.subsets + 1)).tolist()
        hashed = self.hash
        return np.array([hashed(data[8 * a : 8 * b], k) | 1 if b > a else 0 for k, (a, b) in enumerate(pairwise(ends))], np.uint64)


def stirred(h: np.ndarray, salt: int) -> np.ndarray:
    z = h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    some = np.count_nonzero((a != 0) | (b != 0))
    return float(np.count_nonzero((a == b) & (a != 0)) / some) if some else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by as many of the first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


LAST = -(1 << 63)  # stands for a null id, after all others


def in_bands(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) plus ``key``, ``mark``, ``band`` and ``tail``. Rows are ordered by descending key (the
    id), then mark (a hash of the text) and text; bands are ranges of that order with bounds spread over the rows. Each
    band also has, as its tail, a copy of the row that follows its last one (after all: the first)."""
    spark = docs.sparkSession
    n = partitions(spark)
    key, mark = F.coalesce("doc_id", F.lit(LAST).cast("long")).alias("key"), F.xxhash64("text").alias("mark")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", key, mark)
    found = docs.select(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first()["c"] or []
    # an id that has several of the bounds is cut by the mark
    cuts = [(c, LAST + (1 << 64) * i // found.count(c)) for c in sorted(set(found), reverse=True) for i in range(found.count(c))]
    step = max(1, int(len(cuts) ** 0.5))
    heads = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if not heads:
        band = F.lit(0)
    else:  # how many cuts the row lies behind, by blocks of cuts
        cut = lambda c, t: F.struct(F.lit(c).cast("long").alias("c"), F.lit(t).cast("long").alias("t"))
        blocks = F.array(*[F.array(*[cut(c, t) for c, t in h]) for h in heads])
        behind = lambda x: (F.col("key") < x["c"]) | ((F.col("key") == x["c"]) & (F.col("mark") >= x["t"]))
        whole = F.size(F.filter(blocks, lambda cs: behind(F.element_at(cs, -1))))
        band = whole * step + F.coalesce(F.size(F.filter(F.get(blocks, whole), behind)), F.lit(0))
    banded = docs.withColumn("band", band.cast("int"))
    tops = banded.groupBy("band").agg(F.max("key").alias("key")).join(banded.select("band", "key", "mark"), ["band", "key"])
    tops = tops.groupBy("band", "key").agg(F.min("mark").alias("mark")).orderBy("band").collect()  # one row for each band
    pairs = [(r["key"], r["mark"], tops[i - 1]["band"]) for i, r in enumerate(tops)]  # the first band's top follows the last band
    firsts = F.broadcast(spark.createDataFrame(pairs, "key long, mark long, band int"))
    tails = docs.join(firsts, ["key", "mark"]).groupBy("band", "key", "mark").agg(F.min(F.struct(F.col("text").isNull().alias("none"), "text", "doc_id")).alias("x"))
    columns = ["doc_id", "text", "key", "mark", "band"]
    tails = tails.select("x.doc_id", "x.text", "key", "mark", "band", F.lit(True).alias("tail"))
    return banded.select(*columns, F.lit(False).alias("tail")).unionByName(tails)


def edit_probe(docs: DataFrame, terms: DataFrame, levels: int = LEVELS, seeds: int = SEEDS, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Fingerprints of all texts and of their edited versions, in descending order of ids."""
    spark = docs.sparkSession
    terms = materialise(terms.select("term"), "lexicon")
    order = [F.col("band"), F.col("tail"), F.col("key").desc(), F.col("mark"), F.col("text").asc_nulls_last()]
    dealt = in_bands(docs).repartitionByRange(partitions(spark), "band").sortWithinPartitions(*order).select("doc_id", "text", "band", "tail")
    if terms.count() > broadcast_terms:
        return _joined_probe(dealt, terms, levels, seeds)
    shared = spark.sparkContext.broadcast([r["term"] for r in terms.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        mark = Fingerprinter(shared.value, levels, seeds)
        rows = ((doc_id, text or "", band, tail, mark(text or "")) for doc_id, text, band, tail in _tuples(batches))
        yield from _packed((one[0], len(one[1]), _sha256(changed), one[4], mark(changed), two[4]) for one, two, changed in _edits(rows))

    return dealt.mapInArrow(run, NAMES)


def _joined_probe(dealt: DataFrame, terms: DataFrame, levels: int, seeds: int) -> DataFrame:
    """The same for lexicons too large for a worker: texts' distinct terms are joined to the lexicon, and come back as
    the lists of terms that count. A place in a band stands for its row meanwhile."""
    spark = dealt.sparkSession

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        mark, at, last = Fingerprinter((), levels, seeds), 0, None
        words = lambda text: sorted({w.decode() for w in text.lower().encode().split()})
        rows = ((doc_id, text or "", band, tail) for doc_id, text, band, tail in _tuples(batches))
        out = []
        for one, two, changed in _edits(rows, with_tails=True):
            at, last = (at + 1 if last == one[2] else 0), one[2]
            told = [one[0], len(one[1]), _sha256(changed), one[2], at, one[3]]
            out.append([*told, mark.whole(one[1]) - (1 << 63), mark.whole(changed) - (1 << 63), words(one[1]), words(changed)])
            if len(out) >= 500:
                yield _batch(out, EDITED)
                out = []
        if out:
            yield _batch(out, EDITED)

    kinds = "doc_id long, n_chars long, sha string, band int, at long, tail boolean, whole long, whole_edited long, words array<string>, words_edited array<string>"
    edited_ = materialise(dealt.mapInArrow(edits, kinds), "edits")
    each = edited_.select("band", "at", F.explode("words").alias("term"), F.lit(0).alias("which"))
    each = each.unionByName(edited_.select("band", "at", F.explode("words_edited").alias("term"), F.lit(1).alias("which")))
    counted = each.join(terms, "term").groupBy("band", "at").agg(
        *[F.collect_list(F.when(F.col("which") == k, F.col("term"))).alias(f"terms{k}") for k in (0, 1)]
    )
    back = edited_.drop("words", "words_edited").join(counted, ["band", "at"], "left")
    back = back.repartitionByRange(partitions(spark), "band").sortWithinPartitions("band", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = Fingerprinter((), levels, seeds)

        def rows():
            for r in _tuples(batches, ["doc_id", "n_chars", "sha", "band", "tail", "whole", "whole_edited", "terms0", "terms1"]):
                yield (*r, mark.of_terms(r[7], r[5] + (1 << 63)))
            yield None

        yield from _packed(
            (one[0], one[1], one[2], one[9], mark.of_terms(one[8], one[6] + (1 << 63)), two[9]) for one, two in pairwise(rows()) if not one[4]
        )

    return back.mapInArrow(run, NAMES)


def _tuples(batches: Iterator[pa.RecordBatch], names: list[str] | None = None) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*[batch.column(n).to_pylist() for n in names or batch.schema.names])


def _edits(rows: Iterator[tuple], with_tails: bool = False) -> Iterator[tuple]:
    """Each row (doc_id, text, band, tail, ...) with the next and its edited text; tails have none."""
    for one, two in pairwise(chain(rows, [(None, "", None, None, None)])):
        if one[3]:
            if with_tails:
                yield one, two, one[1]
        elif two[2] != one[2]:
            raise ValueError("a band has no tail")
        else:
            yield one, two, edited(one[1], two[1])


def _sha256(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Results of (doc_id, n_chars, edited_sha256, own, edited's and next one's fingerprint)."""
    out = []
    for doc_id, n, sha, own, other, following in rows:
        out.append((doc_id, n, sha, own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, following)))
        if len(out) >= 2000:
            yield _batch(out, SCHEMA)
            out = []
    if out:
        yield _batch(out, SCHEMA)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), schema.types)], schema=schema)


NAMES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


EDITED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("sha", pa.string()),
        ("band", pa.int32()),
        ("at", pa.int64()),
        ("tail", pa.bool_()),
        ("whole", pa.int64()),
        ("whole_edited", pa.int64()),
        ("words", pa.list_(pa.string())),
        ("words_edited", pa.list_(pa.string())),
    ]
)


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return edit_probe(docs, lexicon(docs))
