"""Language identification with a linear-chain conditional random field over the words of a text.

Each word has features (the word itself as a lexicon entry, its prefixes and suffixes, and letter n-grams between
word bounds), hashed into a weight table with a column for each language; learned transitions connect neighbours.
Forward-backward gives each word's language probabilities, so code-switched texts are labelled word by word; a text's
language is the one with the largest expected number of words, and the score its share of them.

Training: stochastic gradient ascent on the conditional log-likelihood, on sequences spliced from pieces of labelled
documents of different languages so that transitions see switches. The labelled documents are a bounded sample
(``TRAIN_DOCS`` of them, the least by a hash of the id; ``TRAIN_CHARS`` characters from a place in the whole text that
a hash of the id chooses, and ``TRAIN_WORDS`` words from a random place in those).
Only text and language are used. The model is a few MB, whatever the input, and is broadcast.

Prediction reads whole texts. Words are looked up in a bounded memo of emission scores; texts of similar length go
through forward-backward side by side, a step for each word position, so no text is cut.

Edge cases: a null text or one without a letter is ``und`` with score 0; without labelled rows every text is ``und``;
repeated rows are each labelled; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import forget, slices, table

UND = "und"
BUCKETS = 1 << 16
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WORDS = 2_000, 4_000, 60
EPOCHS, RATE, DECAY = 3, 0.3, 1e-5
MEMO = 150_000
SIDE_BY_SIDE = 1 << 16  # words, padding included, in a batch of texts

_runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters (digits of other kinds may be among them); none if the text has no letter."""
    found = _runs(text)
    return found if any(c.isalpha() for w in found for c in w) else []


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transitions: np.ndarray  # languages x languages, from row to column


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of some words, and the place of the word that each belongs to.

    Between marks of its bounds a word has every 1-, 2- and 3-gram (those at a bound are its short affixes), affixes
    of three and four letters, and itself.
    """
    marked = [f"<{w.lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(marked)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    left = sizes[owner] - place
    every = np.arange(len(marked))
    found, owners = [_bucket(codes, 1)], [owner]
    gram = codes
    for k in (2, 3):
        gram = gram[:-1] * FACTOR + codes[k - 1 :]
        whole = left[: len(gram)] >= k
        found.append(_bucket(gram[whole], k))
        owners.append(owner[: len(gram)][whole])
    for k in (4, 5):
        long = sizes >= k
        for salt, at in ((10 + k, starts[long]), (20 + k, (starts + sizes - k)[long])):
            affix = np.zeros(len(at), np.uint64)
            for j in range(k):
                affix = affix * FACTOR + codes[at + j]
            found.append(_bucket(affix, salt))
            owners.append(every[long])
    powers = np.cumprod(np.full(int(sizes.max()), FACTOR))
    found.append(_bucket(np.add.reduceat(codes * powers[place], starts), 30))
    owners.append(every)
    return np.concatenate(found), np.concatenate(owners)


FACTOR = np.uint64(0x100000001B3)


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    z = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    ids, owner = features(words)
    return np.stack([np.bincount(owner, weights[ids, k], len(words)) for k in range(weights.shape[1])], axis=1)


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (texts x words x languages) and log-partitions. Emissions are log-scores, padded; lengths are over 0."""
    b, n, k = emissions.shape
    scale = emissions.max(axis=2, keepdims=True)
    e = np.exp(emissions - scale)
    t = np.exp(transitions)
    alpha, norm = np.empty_like(e), np.empty((b, n))
    a = e[:, 0] / k
    for i in range(n):
        if i:
            a = (a @ t) * e[:, i]
        norm[:, i] = z = a.sum(axis=1)
        a = a / z[:, None]
        alpha[:, i] = a
    beta = np.ones((b, k))
    out = alpha
    last = lengths - 1
    for i in range(n - 2, -1, -1):
        beta = ((beta * e[:, i + 1]) @ t.T) / norm[:, i + 1][:, None]
        beta[last <= i] = 1.0
        out[:, i] *= beta
    inside = np.arange(n)[None, :] < lengths[:, None]
    log_z = ((np.log(norm) + scale[:, :, 0]) * inside).sum(axis=1)
    return out / out.sum(axis=2, keepdims=True), log_z


def spliced(texts: list[tuple[str, int]], rng: np.random.Generator) -> list[list[tuple[str, int]]]:
    """Sequences of (word, language): runs of a few words up to whole pieces, from random documents in turn."""
    pieces = [(w[:TRAIN_WORDS] if len(w) <= TRAIN_WORDS else w[(at := int(rng.integers(len(w) - TRAIN_WORDS + 1))) : at + TRAIN_WORDS], y) for w, y in ((words_of(t), y) for t, y in texts)]
    pieces = [(w, y) for w, y in pieces if w]
    rng.shuffle(pieces)
    out, at = [], 0
    while at < len(pieces):
        some = int(rng.integers(1, 4))
        sequence = []
        for w, y in pieces[at : at + some]:
            sequence += [(x, y) for x in w]
        out.append(sequence)
        at += some
    return out


def train(texts: list[tuple[str, str]], seed: int = 1) -> Model:
    """Fit the field to (text, language) pairs."""
    languages = sorted({y for _, y in texts})
    k, rng = len(languages), np.random.default_rng(seed)
    model = Model(languages, np.zeros((BUCKETS, max(k, 1)), np.float32), np.zeros((k, k)))
    coded = [(t, languages.index(y)) for t, y in texts]
    grad2_w, grad2_t = np.full((BUCKETS, max(k, 1)), 1e-2, np.float32), np.full((k, k), 1e-2)
    for _ in range(EPOCHS if k > 1 else 0):
        for sequence in spliced(coded, rng):
            y = np.array([c for _, c in sequence])
            flat, owner = features([w for w, _ in sequence])
            e = np.zeros((len(y), k))
            np.add.at(e, owner, model.weights[flat])
            marginals, _ = forward_backward(e[None], np.array([len(y)]), model.transitions)
            miss = -marginals[0]
            miss[np.arange(len(y)), y] += 1
            g = miss[owner] - DECAY * model.weights[flat]
            np.add.at(grad2_w, flat, (g * g).astype(np.float32))
            np.add.at(model.weights, flat, (RATE * g / np.sqrt(grad2_w[flat])).astype(np.float32))
            g_t = np.zeros((k, k))
            np.add.at(g_t, (y[:-1], y[1:]), 1)
            g_t -= pair_marginals(e, marginals[0], model.transitions)
            g_t -= DECAY * model.transitions
            grad2_t += g_t * g_t
            model.transitions += RATE * g_t / np.sqrt(grad2_t)
    return model


def pair_marginals(e: np.ndarray, single: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected transitions of one sequence, summed, from its emissions and single-word marginals."""
    if len(e) < 2:
        return np.zeros_like(transitions)
    t = np.exp(transitions)
    x = np.exp(e - e.max(axis=1, keepdims=True))
    alpha = np.empty_like(x)
    a = x[0] / x[0].sum()
    alpha[0] = a
    for i in range(1, len(x)):
        a = (a @ t) * x[i]
        a /= a.sum()
        alpha[i] = a
    # p(i, j) = alpha_i t_ij (marginal_j / (alpha t)_j), with the next word's emission in both of the latter
    ahead = alpha[:-1] @ t
    return np.einsum("ni,ij,nj->ij", alpha[:-1], t, single[1:] / ahead)


class Predictor:
    def __init__(self, model: Model, memo: int = MEMO) -> None:
        self.model, self.memo = model, memo
        self.place: dict[str, int] = {}
        self.rows = np.empty((memo, len(model.languages)), np.float32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > self.memo:
            self.place.clear()
            new = list(words)
            if len(new) > len(self.rows):
                self.rows = np.empty((2 * len(new), self.rows.shape[1]), np.float32)
        at = len(self.place)
        self.rows[at : at + len(new)] = emissions(new, self.model.weights)
        self.place.update(zip(new, range(at, at + len(new))))

    def _emissions(self, texts: list[list[str]]) -> list[np.ndarray]:
        place = self.place
        try:
            return [np.fromiter(map(place.__getitem__, w), np.int32, len(w)) for w in texts]
        except KeyError:
            self._learn(set().union(*texts))
            return [np.fromiter(map(place.__getitem__, w), np.int32, len(w)) for w in texts]

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word with its language and probability."""
        found = words_of(text)
        if not found or not self.model.languages:
            return []
        e = self.rows[self._emissions([found])[0]][None].astype(float)
        m = forward_backward(e, np.array([len(found)]), self.model.transitions)[0][0]
        return [(w, self.model.languages[int(p.argmax())], float(p.max())) for w, p in zip(found, m)]

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UND, 0.0)] * len(texts)
        if not self.model.languages:
            return out
        split = [words_of(t) if t else [] for t in texts]
        order = sorted((i for i, w in enumerate(split) if w), key=lambda i: len(split[i]))
        while order:
            # the longest left, and as many of the next ones as fit beside it
            longest = len(split[order[-1]])
            side = max(1, SIDE_BY_SIDE // longest)
            some, order = order[-side:], order[:-side]
            lengths = np.array([len(split[i]) for i in some])
            at = self._emissions([split[i] for i in some])
            e = np.zeros((len(some), longest, len(self.model.languages)))
            e[np.arange(longest)[None, :] < lengths[:, None]] = self.rows[np.concatenate(at)]
            m, _ = forward_backward(e, lengths, self.model.transitions)
            m *= (np.arange(longest)[None, :] < lengths[:, None])[:, :, None]
            share = m.sum(axis=1) / lengths[:, None]
            best = share.argmax(axis=1)
            for i, k, s in zip(some, best.tolist(), share.max(axis=1).tolist()):
                out[i] = self.model.languages[k], min(1.0, s)
        return out


def training_rows(docs: DataFrame, labelled: Column, bound: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """At most ``bound`` labelled documents, spread by a hash; a top-k, so nothing else leaves the executors."""
    picked = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64(F.col("doc_id"), F.lit(7))
    ids = F.broadcast(picked.select(F.col("doc_id").alias("_id"), key.alias("_k")).orderBy("_k", "_id").limit(bound).distinct())
    room = F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1
    part = F.substr("text", (F.pmod(F.xxhash64("_id", F.lit(8)), room) + 1).cast("int"), F.lit(TRAIN_CHARS))
    rows = picked.join(ids, picked["doc_id"] == F.col("_id")).select("lang", part.alias("text"), "_k", "_id")
    return [(r["text"], r["lang"]) for r in rows.orderBy("_k", "_id", "text", "lang").limit(bound).collect()]


def label(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` plus ``lang_pred`` and ``score``; columns of those names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    df = df.select(*kept)
    schema = T.StructType(df.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        predictor = Predictor(shared.value)
        for batch in slices(batches, text):
            found = predictor.texts(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                batch.schema.names + ["lang_pred", "score"],
            )

    return df.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(training_rows(docs, ~held_out()))
    found = label(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
