"""Mixing documents to target domain weights by soft membership.

Domains are learned from a labelled table: a naive Bayes classifier over hashed words gives each document a
posterior over them. Document rates r >= 0 are then fitted so that the expected tokens of each domain,
A r = sum_i r_i w_i p_i, meet the targets T: the least squares

    min_r  |A r - T|^2 (in the metric of (RIDGE G)^-1)  +  sum_i w_i (r_i - 1)^2,    0 <= r_i <= max_rate,

so that of all rates that meet the targets those nearest to 1 are taken, and where none do, the nearest to doing it.
G is the domains' Gram matrix, sum_i w_i p_i p_i'. The projected gradient is taken with lazy projection: a step moves
a sum of gradients, which is a vector L with an entry for each domain, and the projection is made where it is read,

    r_i = clip(1 - p_i . L, 0, max_rate).

Each step aggregates a few numbers for each domain over all documents (partial sums; K + K^2 values to the driver),
and is preconditioned by the Gram matrix of the rows that are not at a bound, summed in the same pass; a step that
doesn't lower the (dual) cost enough is tried again at a quarter of its length. So no state of the documents is kept or moved between steps, and
a document's rate needs nothing but its posterior and L. Steps end when the optimum's equation holds to ``CLOSE`` of
all tokens; whether it does is ``converged``, and how far shares are from their targets is ``residual``.
A rate becomes copies: its whole part, and one more if a hash of the document falls under the rest.

Everything that touches documents is made of DataFrame and SQL functions. The classifier is fitted on a bounded
sample of labelled documents (``TRAIN_DOCS``, the least by a hash of the id); its table of ``BUCKETS`` weights for
each domain is a literal of the plan. All documents get posteriors, tokens and rates.

Edge cases: a null or empty text has no tokens and keeps a rate of 1; a domain without labelled documents isn't
learned and its target is dropped; without labels there is one domain; repeated rows are rated alike; an empty table
gives an empty result. Extra columns of any names pass through ``resample``: documents travel as one column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table

BUCKETS = 1 << 13
TRAIN_DOCS = 6_000
LEAST_Z, LEAST_RATIO = 3.0, 3.0
STEPS, CLOSE, RIDGE = 100, 1e-6, 1e-4
SMOOTHING = 0.5
#: Shares of all tokens: of documents like those labelled toxic, and of the others by quality.
TARGETS = {"high": 0.90, "low": 0.09, "toxic": 0.01}


@dataclass
class Classifier:
    domains: list[str]
    prior: np.ndarray
    weights: np.ndarray  # domains x buckets, zero where a bucket doesn't tell the domains apart


def domain_of() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def with_terms(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` plus ``_b``: the buckets of a text's distinct words (runs of letters, in lower case), of the tenth in
    which the share of distinct words lies, and of that of the signs that are neither letters nor bounds of words.

    The steps are selected one after the other, so that each is worked out once.
    """
    split = docs.withColumn("_all", F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    counted = split.withColumn("_words", F.array_distinct("_all")).withColumn("_signs", F.length("text") - F.length(F.array_join("_all", " ")))
    tenth = lambda name, part, whole: F.concat(F.lit(f"{name} "), F.floor(part * 10 / F.greatest(whole, F.lit(1))))
    more = F.array(tenth("distinct", F.size("_words"), F.size("_all")), tenth("signs", F.coalesce("_signs", F.lit(0)), F.length("text")))
    coded = counted.withColumn("_b", F.transform(F.concat("_words", F.array_compact(more)), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))
    return coded.drop("_all", "_words", "_signs")


def fit_classifier(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, bound: int = TRAIN_DOCS) -> Classifier:
    """Naive Bayes on presence of buckets. A bucket counts for a domain if its rate there and its rate elsewhere differ
    by ``LEAST_Z`` standard errors and by the factor ``LEAST_RATIO``, which leaves out what only goes with length."""
    named = labels.select(F.col("doc_id").alias("_id"), domain_of().alias("_domain")).where("_domain is not null and _id is not null")
    few = F.broadcast(named.dropDuplicates(["_id"]).orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(bound))
    sample = with_terms(docs.join(few, docs["doc_id"] == F.col("_id")).select("_domain", "text"), buckets)
    each = sample.select("_domain", F.explode(F.concat(F.array(F.lit(-1)), F.array_distinct("_b"))).alias("b"))
    counts = each.groupBy("_domain", "b").agg(F.count("*").alias("n")).collect()  # at most domains x (buckets + 1) rows
    domains = sorted({r["_domain"] for r in counts})
    if not domains:
        return Classifier(["all"], np.zeros(1), np.zeros((1, buckets)))
    seen, total = np.zeros((len(domains), buckets)), np.zeros(len(domains))
    for r in counts:
        k = domains.index(r["_domain"])
        if r["b"] < 0:
            total[k] = r["n"]
        else:
            seen[k, r["b"]] = r["n"]
    rest, others = seen.sum(axis=0) - seen, total.sum() - total
    p = (seen + SMOOTHING) / (total + 2 * SMOOTHING)[:, None]
    q = (rest + SMOOTHING) / (others + 2 * SMOOTHING)[:, None]
    error = np.sqrt(p * (1 - p) / np.maximum(total, 1)[:, None] + q * (1 - q) / np.maximum(others, 1)[:, None])
    ratio = np.log(p / q)
    weights = np.where((np.abs(p - q) >= LEAST_Z * error) & (np.abs(ratio) >= np.log(LEAST_RATIO)), ratio, 0.0)
    return Classifier(domains, np.log(total / total.sum()), weights)


def _summed(places: Column, values: Column, start: float) -> Column:
    return F.aggregate(places, F.lit(start), lambda a, b: a + F.get(values, b))


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` plus ``_w`` (tokens: a quarter of the code points, rounded up) and ``_p0``, ``_p1``, ... by domain."""
    n = len(model.domains)
    coded = with_terms(docs, model.weights.shape[1])
    # log-odds against the first domain; the weights are one literal, folded to an array when the plan is made
    for k in range(1, n):
        column = F.split(F.lit(",".join(f"{x:.4g}" for x in model.weights[k] - model.weights[0])), ",").cast("array<double>")
        coded = coded.withColumn(f"_l{k}", _summed(F.col("_b"), column, float(model.prior[k] - model.prior[0])))
    logs = [F.lit(0.0), *[F.col(f"_l{k}") for k in range(1, n)]]
    top = F.greatest(*logs) if n > 1 else logs[0]
    tokens = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("_w")
    exps = coded.select(*docs.columns, tokens, *[F.exp(x - top).alias(f"_e{k}") for k, x in enumerate(logs)])
    total = sum((F.col(f"_e{k}") for k in range(1, n)), F.col("_e0"))
    return exps.select(*docs.columns, "_w", *[(F.col(f"_e{k}") / total).alias(f"_p{k}") for k in range(n)])


def rate_of(gradient: np.ndarray, max_rate: float | None) -> Column:
    """The rate of a row with ``_w`` and ``_p*``."""
    rate = F.lit(1.0)
    for k, x in enumerate(gradient):
        rate = rate - F.col(f"_p{k}") * F.lit(float(x))
    rate = F.greatest(F.lit(0.0), rate)
    rate = rate if max_rate is None else F.least(F.lit(float(max_rate)), rate)
    return F.when(F.col("_w") > 0, rate).otherwise(F.lit(1.0))


@dataclass
class Rates:
    """The sum of gradients, and what it reaches: tokens by domain, the targets, and whether steps have ended."""

    gradient: np.ndarray
    have: np.ndarray
    want: np.ndarray
    converged: bool
    steps: int

    @property
    def residual(self) -> float:
        """The largest distance of a domain's share of tokens from its target."""
        return float(np.abs(self.have - self.want).max() / self.want.sum()) if self.want.sum() else 0.0


def fit_rates(weighed: DataFrame, targets: np.ndarray | None, shares: np.ndarray | None, max_rate: float | None, steps: int = STEPS) -> Rates:
    """Rates for ``targets`` in tokens or ``shares`` of all tokens, from ``_w`` and ``_p*``."""
    n = sum(c.startswith("_p") for c in weighed.columns)
    mass = [F.col("_w") * F.col(f"_p{k}") for k in range(n)]
    pairs = [(j, k) for j in range(n) for k in range(j, n)]

    def sums(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Tokens by domain, the Gram matrix of rows between the bounds, and the rows' part of what is minimised."""
        frame = weighed.withColumn("_r", rate_of(at, max_rate))
        r, move = F.col("_r"), F.lit(0.0)
        for k, x in enumerate(at):
            move = move + F.col(f"_p{k}") * F.lit(float(x))
        free = r > 0 if max_rate is None else (r > 0) & (r < max_rate)
        loose = F.when(free, F.lit(1.0)).otherwise(F.lit(0.0))
        gram = [F.sum(loose * mass[j] * F.col(f"_p{k}")) for j, k in pairs]
        row = frame.agg(*[F.sum(r * m) for m in mass], *gram, F.sum(F.col("_w") * (0.5 + r * r / 2 + r * (move - 1)))).first()
        row = [x or 0.0 for x in row]
        square = np.zeros((n, n))
        for (j, k), v in zip(pairs, row[n:]):
            square[j, k] = square[k, j] = v
        return np.array(row[:n]), square, row[-1]

    at, taken = np.zeros(n), 0
    have, gram, paid = sums(at)
    total = have.sum()
    want = targets if targets is not None else shares * total
    if not total:
        return Rates(at, have, want, True, 0)
    if max_rate is not None and max_rate <= 1:  # then all rows are at a bound at first, and free to leave it
        gram = sums(np.full(n, 1 - max_rate + 1e-9))[1]
    ridge = RIDGE * (gram + 1e-3 * np.trace(gram) / n * np.eye(n))
    miss = have - want  # zero at the optimum, there with the ridge's part; the gradient of ``cost`` but for its sign
    cost = lambda at, paid: at @ ridge @ at / 2 + want @ at - paid
    while np.abs(miss).max() > CLOSE * total and taken < steps:
        step, length = np.linalg.solve(gram + ridge, miss), 1.0
        while True:
            tried = at + length * step
            reached, free, sum_ = sums(tried)
            if cost(tried, sum_) <= cost(at, paid) - 1e-4 * length * (miss @ step) or length < 1e-3:
                break
            length /= 4
        if cost(tried, sum_) >= cost(at, paid):
            break
        at, have, gram, paid, taken = tried, reached, free, sum_, taken + 1
        miss = have - want - ridge @ at
    return Rates(at, have, want, bool(np.abs(miss).max() <= CLOSE * total), taken)


@dataclass
class Mixture:
    """A fitted mixture: all that any document's rate needs but its text."""

    model: Classifier
    rates: Rates
    max_rate: float | None

    def rated(self, weighed: DataFrame) -> DataFrame:
        """``weighed`` (from ``with_posteriors``, with doc_id) plus ``rate`` and ``copies``."""
        chance = F.pmod(F.xxhash64("doc_id", "_w", F.lit(5)), F.lit(1 << 53)) / float(1 << 53)
        return weighed.withColumn("rate", rate_of(self.rates.gradient, self.max_rate)).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def fit_mixture(
    docs: DataFrame,
    labels: DataFrame,
    shares: dict[str, float] | None = None,
    keep: dict[str, float] | None = None,
    max_rate: float | None = None,
    drop: tuple[str, ...] = ("text",),
) -> tuple[Mixture, DataFrame]:
    """The mixture, and a written table of ``docs`` without the columns ``drop`` but with ``_w`` and ``_p*``.

    Targets are ``shares`` of all tokens (shares of domains that weren't learned are left out, the rest scaled to
    1), or, with ``keep``, the given part of each domain's own expected tokens.
    """
    model = fit_classifier(docs, labels)
    weighed = materialise(with_posteriors(docs, model).drop(*drop), "mixture")
    if keep is not None:
        own = weighed.agg(*[F.sum(F.col("_w") * F.col(f"_p{k}")) for k in range(len(model.domains))]).first()
        want, part = np.array([(x or 0.0) * keep.get(d, 1.0) for x, d in zip(own, model.domains)]), None
    else:
        part = np.array([(shares or TARGETS).get(d, 0.0) for d in model.domains])
        want, part = None, part / part.sum() if part.sum() else np.full(len(part), 1 / len(part))
    return Mixture(model, fit_rates(weighed, want, part, max_rate), max_rate), weighed


def resample(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs``, each row as often as its rate says. Posteriors are written beside the texts, which costs less than a
    shuffle of the texts to join them."""
    whole = docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("_")]).alias("_rest"))
    mixture, weighed = fit_mixture(whole, labels, drop=(), **how)
    drawn = mixture.rated(weighed).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return drawn.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; ``converged`` and ``residual`` are those of the whole fit."""
    mixture, narrow = fit_mixture(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
    posteriors = [F.col(f"_p{k}").alias(f"p_{d}") for k, d in enumerate(mixture.model.domains)]
    fit = [F.lit(mixture.rates.converged).alias("converged"), F.lit(mixture.rates.residual).alias("residual")]
    return mixture.rated(narrow).select("doc_id", F.col("_w").alias("n_tokens"), *posteriors, "rate", "copies", *fit)
