"""Byte-level BPE encoding and decoding of whole texts by a file of merge ranks.

A text is split by the tokenizer's pattern and each match is merged on its own. Merging keeps the pieces in a linked
list and the mergeable neighbours in a rank queue: a bucket for each rank holds list positions (leftmost first), a
two-level bitmap says which buckets have any, and find-first-set picks the lowest. A merge makes older entries of
its neighbours stale; they are recognised by the rank now noted at their position and skipped. A pre-token of n
bytes thus costs O(n log n) at most, however long it is.

Words repeat much, so each worker keeps bounded memos of the ids of space-delimited units and of pre-tokens; they
only save time.

Edge cases: null and empty texts have no ids; other columns pass through (one that has the output's name is
replaced); repeated rows are encoded each; an empty table stays empty. The rank file is read on the driver and
broadcast: its size is that of the vocabulary, not of the data.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from heapq import heappop, heappush
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import MEMOS, slices, table, uncollected

MEMO = 240_000
RANKS = "byte_bpe_multi_50k.tiktoken"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


BIT = [1 << i for i in range(256)]
NONE = 1 << 40  # the rank of a pair that does not merge


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    ``buckets`` is the rank queue: rank to positions, a heap. ``words`` has a bit for each rank that has a bucket,
    256 to a word, and ``top`` one for each word that isn't zero. Only pairs that rank below both neighbours are
    queued (on a tie the left one): the lowest pair always does, and a merge can raise no others than those next to
    it to that. Its steps stand in line, as they run for every pair of every new pre-token.
    """
    find = ranks.get
    if (whole := find(piece)) is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    noted = [find(piece[i : i + 2], NONE) for i in before[1:n]]
    noted.append(NONE)  # of the last token; also read at -1 and n, which are no pairs
    noted.append(NONE)
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    left = NONE
    fresh = []
    for p in before[1:n]:
        rank = noted[p]
        if rank < left and rank <= noted[p + 1]:
            fresh.append(p)
        left = rank
    while True:
        for p in fresh:
            rank = noted[p]
            if rank in buckets:
                heappush(buckets[rank], p)
            else:
                buckets[rank] = [p]
                word = rank >> 8
                if word in words:
                    words[word] |= BIT[rank & 255]
                else:
                    words[word] = BIT[rank & 255]
                    top |= BIT[word] if word < 256 else 1 << word
        if not top:
            break
        word = (top & -top).bit_length() - 1
        bits = words[word]
        low = bits & -bits
        rank = word << 8 | low.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            p = heappop(bucket)
        else:
            p = bucket[0]
            del buckets[rank]
            if bits == low:
                del words[word]
                top ^= BIT[word] if word < 256 else 1 << word
            else:
                words[word] = bits ^ low
        fresh = []
        if noted[p] != rank:
            continue
        q = after[p]
        end = after[q]
        was_right = noted[q]
        after[p], before[end], noted[q] = end, p, NONE
        noted[p] = here = find(piece[p : after[end]], NONE) if end < n else NONE
        l = before[p]
        if l >= 0:
            was_left = noted[l]
            noted[l] = side = find(piece[l:end], NONE)
            ll = before[l]
            further = noted[ll]
            if side < further:
                if side <= here and side != NONE:
                    fresh.append(l)
            elif was_left < further and further != NONE and further < noted[before[ll]]:
                fresh.append(ll)
        else:
            side = NONE
        beyond = noted[end]
        if here <= beyond:
            if here < side:
                fresh.append(p)
        elif was_right <= beyond and beyond <= noted[after[end]]:
            fresh.append(end)
    out, p = [], 0
    while p < n:
        q = after[p]
        out.append(ranks[piece[p:q]])
        p = q
    return out


#: A space before anything but white space always begins a pre-token, so texts can be cut there before the pattern.
_cut = re.compile(r" (?=\S)").split
_odd = re.compile(r" (?:\s|$)").search
#: Plain words, of Latin letters and perhaps a sign that ends them, which is a pre-token of its own.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_plain = re.compile(rf"([{LETTERS}]+)([,.;:!?]?)").fullmatch
_ODD = r" (?:[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"  # the same for Arrow
LONG = 64  # characters of units that aren't kept


class Kept(dict):
    """Units and their ids in two generations: when the younger has ``limit`` entries it becomes the elder."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.elder = limit, {}

    def add(self, found: dict[str, bytes]) -> None:
        if len(self) + len(found) > self.limit:
            self.elder = dict(self)
            self.clear()
        self.update(found)


class UnitCoder:
    """Whole texts to ids (int32 bytes): cut at such spaces, new units cut by ``pattern``, and ``code`` gives the ids
    of a list of pre-tokens. Where the pattern keeps plain words whole and their ends apart, they are cut without it.

    Units seen once are kept for a while, those seen again longer, so that the many that never return don't push them
    out; in all about ``limit`` of them. A call learns all the new units of its texts at once.
    """

    def __init__(self, code: Callable[[list[str]], list[Sequence[int]]], pattern: str, limit: int = MEMO) -> None:
        import regex

        self.code, self.find, self.limit = code, regex.compile(pattern).findall, limit
        word = "".join(c for c in map(chr, range(65, 592)) if _plain(c))
        self.plain = _plain if all(self.find(f" {word}{e}") == [f" {word}", e] for e in ",.;:!?") else lambda unit: None
        self.once, self.again = Kept(limit // 6), Kept(limit // 3)
        self.pieces = Kept(limit // 10)  # pre-tokens of units that aren't plain words

    def _packed(self, pieces: list[str]) -> Iterator[bytes]:
        coded = self.code(pieces)
        data = array("i", chain.from_iterable(coded)).tobytes()
        ends = accumulate((4 * len(c) for c in coded), initial=0)
        return (data[a:b] for a, b in pairwise(ends))

    def _cut_and_coded(self, strings: list[str]) -> list[bytes]:
        """Ids of strings that the pattern cuts."""
        cut = [self.find(x) for x in strings]
        wanted = set().union(*cut)
        told = {p: ids for p in wanted if (ids := self.pieces.get(p) or self.pieces.elder.get(p))}
        new = [p for p in wanted if p not in told]
        fresh = dict(zip(new, self._packed(new)))
        told |= fresh
        self.pieces.add({p: told[p] for p in wanted if p not in self.pieces and len(p) <= LONG})
        return [b"".join(map(told.__getitem__, c)) for c in cut]

    def _learnt(self, new: list[str]) -> dict[str, bytes]:
        words, ended, others = [], [], []
        for u in new:
            if (m := self.plain(u)) is None:
                others.append(u)
            elif m[2]:
                ended.append((u, *m.groups()))
            else:
                words.append(u)
        met = {w for _, w, _ in ended}.difference(words)
        told = {w: ids for w in met if (ids := self.again.get(w) or self.once.get(w))}
        words += [w for w in met if w not in told]
        told.update(zip(words, self._packed([f" {w}" for w in words])))
        ends = dict(zip(",.;:!?", self._packed(list(",.;:!?"))))
        told.update((u, told[w] + ends[e]) for u, w, e in ended)
        told.update(zip(others, self._cut_and_coded([f" {u}" for u in others])))
        return told

    def _told(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids of units, each with the space before it."""
        again, old, once, older = self.again, self.again.elder, self.once, self.once.elder
        told, back, new = {}, {}, []
        for u in units:
            if (ids := again.get(u)) is not None:
                told[u] = ids
            elif (ids := old.get(u) or once.get(u) or older.get(u)) is not None:
                back[u] = ids
            else:
                new.append(u)
        fresh = self._learnt(new)
        again.add(back)
        once.add({u: ids for u, ids in fresh.items() if len(u) <= LONG})
        return told | back | fresh

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """The same for a column of texts, as a list array of int32. Texts are cut and their units told apart in Arrow,
        so that Python sees each different unit once."""
        texts = pc.fill_null(texts, "")
        if not len(texts) or pc.any(pc.match_substring_regex(texts, _ODD)).as_py():
            return id_lists(self(texts.to_pylist()))
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        flat = cut.flatten()
        told = flat.dictionary_encode()
        units, at = told.dictionary.to_pylist(), told.indices.to_numpy().copy()
        heads = self._cut_and_coded(flat.take(pa.array(bounds[:-1])).to_pylist())
        coded = [*map(self._told(units).__getitem__, units), *heads]
        at[bounds[:-1]] = np.arange(len(units), len(coded), dtype=at.dtype)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[bounds]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), id_lists(coded).take(pa.array(at)).flatten())

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        cut = [(_cut(t) if _odd(t) else t.split(" ")) if t else [""] for t in texts]
        heads = self._cut_and_coded([c.pop(0) for c in cut])
        told = self._told(set().union(*cut)).__getitem__
        return [head + b"".join(map(told, c)) for head, c in zip(heads, cut)]


def bpe_coder(ranks: dict[bytes, int], pattern: str) -> UnitCoder:
    return UnitCoder(lambda pieces: [merge(p.encode(), ranks) for p in pieces], pattern)


_coders: dict[tuple[bytes, str], UnitCoder] = {}
MEMOS.append(_coders)
_tokens: dict[bytes, dict[int, bytes]] = {}


def _coder(raw: bytes, pattern: str) -> UnitCoder:
    key = hashlib.sha256(raw).digest(), pattern
    if key not in _coders:
        _coders.clear()
        _coders[key] = bpe_coder(read_ranks(raw), pattern)
    return _coders[key]


def _decoder(raw: bytes) -> Callable[[list[int]], bytes]:
    key = hashlib.sha256(raw).digest()
    if key not in _tokens:
        _tokens.clear()
        _tokens[key] = {rank: x for x, rank in read_ranks(raw).items()}
    token = _tokens[key].__getitem__
    return lambda ids: b"".join(map(token, ids))


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, x in enumerate(batch.schema.names) if x != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [values], [batch.schema.names[i] for i in keep] + [name])


def schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def id_lists(parts: list[bytes]) -> pa.Array:
    """A list array of int32 from the lists' bytes."""
    offsets = list(accumulate((len(p) // 4 for p in parts), initial=0))
    values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode(df: DataFrame, raw: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` plus ``ids array<int>``. ``raw`` is the content of a rank file."""
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in slices(batches, text, 2_000, 8 << 20):
            with uncollected():
                coded = coder.lists(batch.column(batch.schema.get_field_index(text)))
            yield with_column(batch, ids, coded)

    return df.mapInArrow(run, schema_with(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, raw: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` plus ``decoded binary``; null ids give empty bytes, an id outside the vocabulary is an error."""
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _decoder(shared.value)
        for batch in slices(batches):
            column = batch.column(batch.schema.get_field_index(ids))
            offsets, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
            valid = column.is_valid().to_pylist()
            parts = [joined(values[a:b].tolist()) if v else b"" for v, (a, b) in zip(valid, pairwise(offsets))]
            yield with_column(batch, decoded, pa.array(parts, pa.binary()))

    return df.mapInArrow(run, schema_with(df, decoded, T.BinaryType()))


def there_and_back(df: DataFrame, raw: bytes, pattern: str, decoded: bool = True, text: str = "text") -> DataFrame:
    """``df`` with ``text`` replaced by ``ids`` and what the ids decode to: its bytes as ``decoded``, or, without them,
    whether they are the text's as ``round_trip``. One kernel does both ways, so ids don't travel in between; columns
    of ``df`` with these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(raw)
    name = "decoded" if decoded else "round_trip"
    slim = df.select(*[c for c in df.columns if c not in (name, "ids")])
    out = T.StructType([f for f in slim.schema.fields if f.name != text])
    out = out.add("ids", T.ArrayType(T.IntegerType())).add(name, T.BinaryType() if decoded else T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, joined = _coder(shared.value, pattern), _decoder(shared.value)
        for batch in slices(batches, text, 2_000, 8 << 20):
            texts = batch.column(batch.schema.get_field_index(text))
            with uncollected():
                codes = coder.lists(texts)
            values = codes.flatten().to_numpy()
            back = (joined(values[a:b].tolist()) for a, b in pairwise(codes.offsets.to_pylist()))
            told = pa.array(back, pa.binary())
            if not decoded:
                told = pc.equal(told, pc.fill_null(texts, "").cast(pa.binary()))
            keep = [i for i, x in enumerate(batch.schema.names) if x != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], codes, told], [*[batch.schema.names[i] for i in keep], "ids", name])

    return slim.mapInArrow(run, out)


def vocabulary(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = vocabulary(RANKS)
    coded = there_and_back(table(spark, sf_dir, "documents", "doc_id", "text"), raw, split_pattern())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
