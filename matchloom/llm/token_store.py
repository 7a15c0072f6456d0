"""Token ids in Parquet: list columns, controlled encodings, row groups and pages, whole or selective reads.

Documents are range-partitioned and sorted by id, encoded with the tokenizers library, closed with an end id, and
written one file for each partition, so that files and rows are in ascending id order. The ids column is dictionary
encoded (two bytes an id for vocabularies up to 65,536); ids of documents, counts and offsets, which rise, are delta
encoded. Row groups and pages are small enough that a reader of a few documents skips the rest by the page index,
and metadata columns can be read without the ids. ``starts`` are kept relative to the file; the number of ids in
each file, one row a file, gives the offset of each file.

Edge cases: null and empty texts have the end id alone; null document ids come first; documents with one id are
ordered by text; repeated rows are written each; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import MEMOS, partitions, scratch_path, slices, table, uncollected
from .bpe_codec import UnitCoder, id_lists, split_pattern, vocabulary

END_ID = 0
SCHEMA = "doc_id long, part int, start long, n_tokens long, ids array<int>"
#: Of the writer: version 2 pages for delta encoding, row groups of 32 MB, pages of 128 KB and 2,000 rows at most.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}

_coders: dict[tuple[bytes, bool], TextCoder] = {}
MEMOS.append(_coders)


@cache
def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte. Printable bytes of Latin-1 stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextCoder:
    """Whole texts to ids as ``Tokenizer.encode`` gives them without special tokens around the text.

    Pre-tokens are split here and go to the library's model one at a time, since what its whole call adds (offsets,
    masks, alignments) costs five times the merges; what was seen is kept. A text with a string of an added token
    goes to the whole call.
    """

    def __init__(self, raw: bytes, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = "|".join(f"(?:{re.escape(a)})" for a in added)
        tokenize, letters = self.tokenizer.model.tokenize, byte_letters()

        def code(pieces: list[str]) -> list[list[int]]:
            written = (p.encode().decode("latin-1").translate(letters) for p in pieces)
            return [[t.id for t in tokenize(w)] for w in written]

        self.units = UnitCoder(code, split_pattern())

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        marked = pc.fill_null(pc.match_substring_regex(texts, self.added), False) if self.added else None
        if marked is None or not pc.any(marked).as_py():
            return self.units.lists(texts)
        whole = lambda t: array("i", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
        texts = texts.to_pylist()
        plain = iter(self.units([t for t, m in zip(texts, marked.to_pylist()) if not m]))
        return id_lists([whole(t) if m else next(plain) for t, m in zip(texts, marked.to_pylist())])


def _coder(raw: bytes, special_as_text: bool = False) -> TextCoder:
    key = hashlib.sha256(raw).digest(), special_as_text
    if key not in _coders:
        _coders.clear()
        _coders[key] = TextCoder(raw, special_as_text)
    return _coders[key]


def _closed(lists: pa.ListArray, end_id: int) -> pa.ListArray:
    """Each list with the end id after it."""
    ends = lists.offsets.to_numpy()
    values = np.insert(lists.flatten().to_numpy(), ends[1:] - ends[0], end_id)
    return pa.ListArray.from_arrays(pa.array((ends - ends[0] + np.arange(len(ends))).astype(np.int32)), pa.array(values, pa.int32()))


def write(docs: DataFrame, path: str, tokenizer: bytes, end_id: int = END_ID, special_as_text: bool = False) -> None:
    """Encode ``docs`` and write the store; of its columns only doc_id and text are read. ``tokenizer`` is the content
    of a tokenizers file of the byte-level kind, whose pre-tokens are the matches of ``split_pattern()``. The string
    of a special token in a text gives that token, as in the library's plain call, or ordinary text if asked for."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = _coder(shared.value, special_as_text), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 2_000, 8 << 20):
            with uncollected():
                ids = _closed(coder(batch.column(1)), end_id)
            counts = np.diff(ids.offsets.to_numpy()).tolist()
            starts = list(accumulate(counts, initial=at))
            at = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(counts), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), ids],
                ["doc_id", "part", "start", "n_tokens", "ids"],
            )

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = docs.select("doc_id", "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first())
    ranged.sortWithinPartitions(*order).mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` with starts over the whole store; unread columns and pages are skipped."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    first = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part int, first long"))
    return rows.join(first, "part").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids`` replaced by ``ids_crc32``, of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sums = [zlib.crc32(memoryview(x.values.to_numpy(zero_copy_only=True))) for x in lists]
            yield pa.RecordBatch.from_arrays(batch.columns[:3] + [pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write(table(spark, sf_dir, "documents", "doc_id", "text"), path, vocabulary("byte_bpe_50k.json"))
    return checksums(read(spark, path))
