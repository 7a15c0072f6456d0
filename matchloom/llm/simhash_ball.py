"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text is lower-cased (A-Z), cut into words at ASCII white space and into shingles of some words; each bit of its
fingerprint is the majority of that bit over the shingles' XXH64 values. To link all fingerprints within ``radius``
bits, every distinct fingerprint emits all variants within half of it; two fingerprints that near share a variant.
One shuffle brings the variants together; a group holds distinct fingerprints around one point, so at most
``1 + bits`` of them (for radius 2), whatever the input: neighbours in the group's order are verified and linked,
which connects all that collide there without listing all pairs. Components of the links are the classes. Copies
share a fingerprint and are one node, however many.

``near_texts`` finds texts whose sets of five-word shingles have a likeness of at least 0.8. One fingerprint can't:
such texts differ in up to 15 % of its bits. So there are ``TABLES`` keys of ``BITS`` bits, of the distinct shingles
of ``FEATURES`` words (an edited word spoils two of those, but five of five words, so fewer bits flip). A pair that
differs in the share f of bits meets in a table if at most 2 of its bits differ, and all that meet and are within
``APART`` of all bits are verified by the likeness of their whole sets, see ``meet``. With 16 tables of 32 bits a
pair is missed by formula 3 times in 10^7 at f = 0.07, 7 in 10^4 at 0.1 and 1 in 90 at 0.12. Scattered edits give
about 0.1 at a likeness of 0.8; a block added or cut in one place gives 0.15 at 0.8 (found: 86 %), 0.13 at 0.85
(97 %) and 0.1 at 0.9 (99.9 %).
Each pair of rows meets by chance with 2^-23 in a table, so beyond some ten million texts more bits are due, and
more tables with them.

A table's variants travel by their upper half: one row for the key and one for each flip in that half; flips in the
lower half stay in the same place and are made there. That is half the rows, and a place's variants need no second
shuffle to be counted.

Edge cases: null and empty texts have the fingerprint zero and are linked like any other (for ``near_texts`` they
are one class, as all texts of equal sets are); fewer words than a shingle has make one shingle; repeated rows and
ids are each returned; a null id never becomes a component's id while there is another; an empty table gives an
empty result; extra columns, of whatever names, pass through ``keep_one``. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import likeness, meet
from ._common import forget, materialise, slices, table
from .components import components
from .shingles import hashes, mixed, shingle_hashes, words_of

BROADCAST_ROWS = 500_000
BLOCK = 1 << 15
FEATURES, TABLES, BITS, APART = 2, 16, 32, 0.25


def majority(values: np.ndarray) -> int:
    """The fingerprint, as a signed 64-bit integer."""
    n, counts = len(values), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        bits = np.unpackbits(values[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_hash, node``: the fingerprint of each of ``docs`` (doc_id, text) as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text"):
            prints = [majority(shingle_hashes(text or "", words)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "text_hash", "node"])

    return _slim(docs).mapInArrow(run, "doc_id long, text_hash long, node long")


def _bit(i: int) -> Column:
    return F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long")


def links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links of ``nodes`` (node: a fingerprint, distinct), whose components are those of all within 2 bits.

    All that meet are within 2 bits of each other, so one link to the next of them will do.
    """
    masks = F.array(F.lit(0).cast("long"), *[_bit(i) for i in range(64)])
    emitted = nodes.select("node", F.explode(F.transform(masks, lambda m: F.col("node").bitwiseXOR(m))).alias("variant"))
    met = emitted.select("node", F.lag("node").over(Window.partitionBy("variant").orderBy("node")).alias("before"))
    met = met.where("before <> node").distinct()
    return met.where(F.bit_count(F.col("node").bitwiseXOR(F.col("before"))) <= 2).select(F.col("before").alias("a"), F.col("node").alias("b"))


def _named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, component_id, class`` for ``nodes`` (node, first): the least id, and the component's own name."""
    linked = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("class"))
    least = linked.groupBy("class").agg(F.min("first").alias("component_id"))
    return materialise(linked.join(least, "class").select("node", "component_id", "class"), "classes", nodes.count())


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, text_hash, node, component_id, class``, a row for each of ``docs``: fingerprints within 2 bits are
    linked. The class is the component's own name, which ids that repeat across texts don't share."""
    rows = materialise(fingerprints(docs, words), "prints")
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("first")), "nodes", rows.count())
    return rows.join(_named(nodes, components(links(nodes.select("node")))), "node")


def sketches(docs: DataFrame, words: int, features: int, prints: int) -> DataFrame:
    """``doc_id, text_hash, node, prints`` of ``docs`` (doc_id, text): the node names the set of shingles of ``words``
    words, the fingerprints are of the distinct shingles of ``features`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        forget()
        for batch in slices(batches, "text"):
            nodes, marks = [], []
            for text in batch.column(2).to_pylist():
                found = words_of(text or "")
                nodes.append(xxh64_intdigest(np.unique(hashes(found, words)).tobytes()) - (1 << 63))
                values = np.unique(hashes(found, features))
                marks.append([majority(mixed(values, t)) for t in range(prints)])
            made = [pa.array(nodes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "text_hash", "node", "prints"])

    return _slim(docs).mapInArrow(run, "doc_id long, text_hash long, node long, prints array<long>")


def meetings(nodes: DataFrame, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """``bucket, node, n``: nodes (node, prints) that share a variant of a table's key, of ``n`` > 1 nodes.

    A bucket in which all have the same flipped bit is left out: theirs is one key, whose own bucket holds them too.
    """
    each, low = 64 // bits, bits // 2
    cut = lambda p, k: F.shiftrightunsigned(p, k * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    keys = F.array(*[cut(F.get("prints", F.lit(t // each)), t % each) for t in range(tables)])
    high = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("flip"), (F.lit(0).cast("long") if i < 0 else _bit(i)).alias("bit")) for i in (-1, *range(low, bits))])
    sent = nodes.select("node", F.posexplode(keys).alias("t", "key")).select("node", "t", "key", F.explode(high).alias("h"))
    key = F.col("key").bitwiseXOR(F.col("h.bit"))
    place = F.shiftrightunsigned(key, low) * tables + F.col("t")
    rest = F.col("h.flip") * (1 << low) + key.bitwiseAND(F.lit((1 << low) - 1).cast("long"))
    there = sent.select("node", place.alias("place"), rest.alias("rest")).repartition("place")
    flip, end = F.shiftright("rest", low), F.col("rest").bitwiseAND(F.lit((1 << low) - 1).cast("long"))
    own = F.struct(flip.alias("flip"), end.alias("end"))
    lower = [F.struct(F.lit(i + 1).cast("long").alias("flip"), end.bitwiseXOR(_bit(i)).alias("end")) for i in range(low)]
    made = there.select("node", "place", F.explode(F.when(flip > 0, F.array(own)).otherwise(F.array(own, *lower))).alias("v"))
    made = made.select("node", "place", F.col("v.end").alias("end"), F.col("v.flip").cast("int").alias("flip"))
    alone = Window.partitionBy("place", "end")
    counted = made.select("node", "place", "end", F.count("*").over(alone).alias("n"), F.min("flip").over(alone).alias("least"), F.max("flip").over(alone).alias("most"))
    met = counted.where("n > 1 and (least = 0 or least < most)")
    return materialise(met.select((F.col("place") * (1 << low) + F.col("end")).alias("bucket"), "node", "n"), "met")


def _with_texts(docs: DataFrame, wanted: DataFrame, wanted_rows: int, broadcast_rows: int) -> DataFrame:
    """``node, text``: one text of ``docs`` for each of ``wanted`` (node, one: its id and text hash), of ``wanted_rows`` at most."""
    asked = materialise(wanted.select("node", F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("_hash")), "wanted", wanted_rows)
    asked = F.broadcast(asked) if asked.count() <= broadcast_rows else asked
    slim = _slim(docs)
    found = slim.join(asked, slim["doc_id"].eqNullSafe(asked["_id"]) & (slim["text_hash"] == asked["_hash"]))
    return found.select("node", "text").dropDuplicates(["node"])


def near_texts(
    docs: DataFrame,
    words: int = 5,
    least: float = 0.8,
    features: int = FEATURES,
    tables: int = TABLES,
    bits: int = BITS,
    apart: float = APART,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, text_hash, component_id, class``, a row for each of ``docs``: texts that meet in a table and whose
    sets of shingles have a likeness of at least ``least`` are linked, see the top."""
    prints = -(-tables // (64 // bits))
    rows = materialise(sketches(docs, words, features, prints), "sketches")
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("first"), one, F.first("prints").alias("prints")), "nodes", rows.count())
    met = meetings(nodes, tables, bits)
    p, q = nodes.select("node", F.col("prints").alias("p")), nodes.select(F.col("node").alias("before"), F.col("prints").alias("q"))
    flips = F.aggregate(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    grouped = meet.groups(met)
    pairs = meet.first_pairs(meet.small(met)).unionByName(meet.first_pairs(grouped)).distinct()
    near = pairs.join(p, "node").join(q, "before").where(flips <= int(apart * 64 * prints)).select("node", "before")
    near = materialise(near, "pairs")
    asked = near.select("node").unionByName(near.select(F.col("before").alias("node"))).unionByName(grouped.select("node")).distinct()
    texts = _with_texts(docs, nodes.join(asked, "node"), 2 * near.count() + grouped.count(), broadcast_rows)
    sets = materialise(likeness.shingle_sets(texts, words), "sets")
    a, b = sets.select("node", F.col("payload").alias("p")), sets.select(F.col("node").alias("before"), F.col("payload").alias("q"))
    found = near.join(a, "node").join(b, "before").where(likeness.alike(F.col("p"), F.col("q"), least))
    roots = meet.roots(grouped, found.select(F.col("before").alias("a"), F.col("node").alias("b")), sets, likeness.kernel(least))
    return rows.join(_named(nodes, roots), "node").select("doc_id", "text_hash", "component_id", "class")


def keep_one(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, find: Callable[..., DataFrame] = near_texts, **how) -> DataFrame:
    """``docs`` without all but one document of each class that ``find`` finds: that of the smallest id, by text hash
    among equal ids.

    Those to drop join by broadcast while their count is under ``broadcast_rows``, by a shuffle beyond it. Of rows
    that repeat id and text one stays.
    """
    classes = find(docs, **how).select("doc_id", "text_hash", "class")
    seen = materialise(classes.groupBy("class", "doc_id", "text_hash").agg(F.count("*").alias("n")), "seen")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("keep")
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash"))
    judged = seen.join(seen.groupBy("class").agg(least), "class").select(F.struct("doc_id", "text_hash", stays.alias("stays"), "n").alias("told"))
    marked = materialise(judged.where("not told.stays or told.n > 1"), "marked", seen.count())
    told = F.broadcast(marked) if marked.count() <= broadcast_rows else marked
    # the documents travel as one column, so that theirs can have any names
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("told.doc_id")) & (F.xxhash64("doc.text") == F.col("told.text_hash"))
    left = whole.join(told, same, "left").where("told is null or told.stays")
    single = left.where("told is null").select("doc.*")
    repeated = left.where("told is not null").withColumn("key", F.struct("told.doc_id", "told.text_hash")).dropDuplicates(["key"])
    return single.unionByName(repeated.select("doc.*"))


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
