"""Results against brute force, other libraries, round trips, SQL and held-out accuracy."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import bpe_codec, feistel_shard, imatch, langid_crf, media_copies, mixture, registry, secret_index, shingles, simhash_ball, token_store


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_as_sql(spark, small, name):
    assert_same(registry.QUERIES[name](spark, small), registry.oracles()[name], small)


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def tiktoken_encoding():
    import tiktoken

    ranks = bpe_codec.read_ranks(bpe_codec.vocabulary(bpe_codec.RANKS))
    return tiktoken.Encoding("own", pat_str=bpe_codec.split_pattern(), mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t'sab"), max_size=60))
def test_coders_equal_the_libraries(text):
    ids = lambda b: np.frombuffer(b, "<i4").tolist()
    state = test_coders_equal_the_libraries.__dict__
    if "own" not in state:
        from tokenizers import Tokenizer

        raw = bpe_codec.vocabulary("byte_bpe_50k.json")
        state |= {"own": bpe_codec.bpe_coder(bpe_codec.read_ranks(bpe_codec.vocabulary(bpe_codec.RANKS)), bpe_codec.split_pattern()), "theirs": tiktoken_encoding()}
        state |= {"stored": token_store._coder(raw), "tokenizer": Tokenizer.from_str(raw.decode())}
    assert ids(state["own"]([text])[0]) == state["theirs"].encode_ordinary(text)
    column = pa.array([None, text, "ab cd", text + "."])[1:]
    assert state["own"].lists(column).to_pylist() == [state["theirs"].encode_ordinary(t) for t in column.to_pylist()]
    assert state["stored"](column).to_pylist() == [state["tokenizer"].encode(t, add_special_tokens=False).ids for t in column.to_pylist()]


def test_special_strings_are_the_librarys_own():
    from tokenizers import Tokenizer

    raw = bpe_codec.vocabulary("byte_bpe_50k.json")
    text = "a <|endoftext|> b<|endoftext|>, c <|endoftext"
    for as_text in (False, True):
        tokenizer = Tokenizer.from_str(raw.decode())
        tokenizer.encode_special_tokens = as_text
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert (50256 in want) != as_text
        assert token_store.TextCoder(raw, as_text)(pa.array([None, text, "a b"]))[1].as_py() == want


def test_units_are_relearnt_when_few_are_kept():
    encoding, ranks = tiktoken_encoding(), bpe_codec.read_ranks(bpe_codec.vocabulary(bpe_codec.RANKS))
    coder = bpe_codec.UnitCoder(lambda ps: [bpe_codec.merge(p.encode(), ranks) for p in ps], bpe_codec.split_pattern(), 20)
    rng = np.random.default_rng(4)
    for _ in range(30):
        texts = [" ".join(rng.choice(["word", "end.", "word,", "x" * 70, "y" * 70 + "!", "é,", "12", "a\nb", "", "it's"], 12)) + str(rng.integers(99)) for _ in range(4)]
        assert [np.frombuffer(x, "<i4").tolist() for x in coder(texts)] == [encoding.encode_ordinary(t) for t in texts]
        assert coder.lists(pa.array(texts)).to_pylist() == [encoding.encode_ordinary(t) for t in texts]


def test_bpe_query(spark, small, docs):
    encoding = tiktoken_encoding()
    for r in registry.QUERIES["op2_bpe_codec"](spark, small).collect():
        text = docs[r["doc_id"]]["text"] or ""
        ids = encoding.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_fingerprint_query(spark, small, docs):
    rows = registry.QUERIES["op1_imatch"](spark, small).collect()
    order = sorted(docs, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    seen = {}
    for r in rows:
        text = docs[r["doc_id"]]["text"] or ""
        changed = imatch.edited(text, docs[following[r["doc_id"]]]["text"] or "")
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(rows) == len(docs)
    near, following_near = np.array([(r["near_edited"], r["near_next"]) for r in rows]).T
    assert (near > following_near).mean() > 0.9


def test_likeness_of_fingerprints_is_that_of_plain_subsets(spark, small, docs):
    """Subsets drawn and hashed one term at a time, and the share of those that agree."""
    from xxhash import xxh64_intdigest

    terms = {r["term"] for r in imatch.lexicon(spark.read.parquet(f"{small}/documents.parquet")).collect()}

    def stirred(h, salt):
        z = (h + salt * 0x9E3779B97F4A7C15) % (1 << 64)
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
        return z ^ z >> 31

    def plain(text):
        found = sorted(set(text.lower().encode().split()) & {t.encode() for t in terms})
        out = []
        for k in range(imatch.LEVELS * imatch.SEEDS):
            level = k // imatch.SEEDS
            held = [h for h in map(xxh64_intdigest, found) if stirred(h, k + 1) % (1 << level) == 0]
            out.append(xxh64_intdigest(b"".join(h.to_bytes(8, "little") for h in held), k) | 1 if held else 0)
        return out if found else [xxh64_intdigest(text.encode(), 7) | 1] * len(out)

    order = sorted(docs, reverse=True)
    rows = {r["doc_id"]: r for r in registry.QUERIES["op1_imatch"](spark, small).collect()}
    for this, following in list(zip(order, order[1:] + order[:1]))[::5]:
        text, after = docs[this]["text"] or "", docs[following]["text"] or ""
        marks = [plain(t) for t in (text, imatch.edited(text, after), after)]
        assert rows[this]["fingerprint"] == np.array(marks[0], np.uint64).tobytes().hex()
        for other, near in zip(marks[1:], ("near_edited", "near_next")):
            some = [(a, b) for a, b in zip(marks[0], other) if a or b]
            assert rows[this][near] == pytest.approx(sum(a == b for a, b in some) / len(some))


def test_lexicon_is_exact(spark, small, docs):
    from collections import Counter

    import math
    import re

    n, counts = len(docs), Counter()
    for r in docs.values():
        counts.update(set(re.split(r"[\x20\x09-\x0D]+", (r["text"] or "").lower())) - {""})
    want = {w: c for w, c in counts.items() if 0.5 <= math.log(n / c) <= 3.0}
    got = {r["term"]: r["df"] for r in imatch.lexicon(spark.read.parquet(f"{small}/documents.parquet"), 0.5, 3.0).collect()}
    assert got == want


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000):
        assert sorted(feistel_shard.permute(i, n) for i in range(n)) == list(range(n))


def test_simhash_query(spark, small, docs):
    rows = registry.QUERIES["op4_simhash_ball"](spark, small).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    for i in list(docs)[:60]:
        assert prints[i] == simhash_ball.majority(shingles.shingle_hashes(docs[i]["text"] or "", 3)) % (1 << 64)
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: find(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    from matchloom.llm.components import components

    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(5, 5), (41, 40), (40, 41)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(7, 40)} == {7} and got[41] == got[40] and 5 not in got


def test_trigram_queries_hold_for_matches():
    for rule, text in (("assign", 'API_KEY": "abcdef12"'), ("assign", "passwd=abcdef12"), ("access", "AKIA" + "Z" * 16), ("github", "ghs_" + "a" * 36), ("pem", "-----BEGIN RSA PRIVATE KEY-----")):
        pattern = next(r.pattern for r in secret_index.RULES if r.kind == rule)
        assert secret_index.brute_force(text) and any(all(g in text.lower() for g in c) for c in secret_index.trigram_query(pattern))
    assert secret_index.trigram_query("[0-9a-f]{24,}") == {frozenset()} and secret_index.trigram_query("(abc|x)yz[0-9]+") == {frozenset({"abc", "bcy", "cyz"}), frozenset({"xyz"})}


def test_language_query_is_accurate_where_held_out(spark, small, docs):
    rows = registry.QUERIES["op7_langid_crf"](spark, small).collect()
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert len(rows) == len(docs) and np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95


def test_forward_backward_is_exact():
    from itertools import product

    rng = np.random.default_rng(3)
    e, t = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    marginals, log_z = langid_crf.forward_backward(e, np.array([4, 2]), t)
    for b, n in ((0, 4), (1, 2)):
        paths = {p: np.exp(sum(e[b, i, p[i]] for i in range(n)) + sum(t[p[i - 1], p[i]] for i in range(1, n))) for p in product(range(3), repeat=n)}
        z = sum(paths.values())
        assert np.isclose(log_z[b] + np.log(3), np.log(z))  # the first word's prior is even
        for i in range(n):
            assert np.allclose(marginals[b, i], [sum(v for p, v in paths.items() if p[i] == k) / z for k in range(3)])
    pairs = langid_crf.pair_marginals(e[0], marginals[0], t)
    assert np.isclose(pairs.sum(), 3) and np.allclose(pairs.sum(axis=1), marginals[0][:-1].sum(axis=0))


def test_switched_text_is_labelled_word_by_word(spark, small, docs):
    rows = [(r["text"], r["lang"]) for r in docs.values() if r["lang"]]
    predictor = langid_crf.Predictor(langid_crf.train(rows))
    words = predictor.words("that the thing was only und der keitschen ist nicht")
    assert [w[1] for w in words[:5]] == ["en"] * 5 and [w[1] for w in words[5:]] == ["de"] * 5


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_mixture_meets_its_targets(spark, small, size):
    got = registry.QUERIES["op8_mixture"](spark, small.replace("sf0.001", size)).toPandas()  # the smallest has too few labels
    p = got[[f"p_{k}" for k in mixture.TARGETS]].to_numpy()
    reached = (got["rate"] * got["n_tokens"]).to_numpy() @ p / got["n_tokens"].sum()
    assert got["converged"].all() and got["residual"].max() < 0.002 and (got["rate"] >= 0).all()
    assert np.abs(reached - list(mixture.TARGETS.values())).max() < 0.002
    drawn = (got["copies"] * got["n_tokens"]).to_numpy() @ p
    assert np.abs(drawn / drawn.sum() - list(mixture.TARGETS.values())).max() < 0.05 and (np.abs(got["copies"] - got["rate"]) < 1).all()


@pytest.mark.parametrize(("targets", "max_rate"), [((4.0, 3.0, 0.3), None), ((1.0, 8.0, 0.1), 2.5), ((30.0, 30.0, 30.0), 1.5), ((5.0, 4.0, 0.0), 1.0)])
def test_rates_are_those_of_a_plain_projected_gradient(spark, targets, max_rate):
    """The same least squares, each rate a variable of its own, by many small steps."""
    rng = np.random.default_rng(9)
    p = rng.dirichlet([0.4, 0.4, 0.2], 60)
    w = rng.integers(1, 5, 60).astype(float)
    want = np.array(targets) * w.sum() / 10
    rows = [(i, int(x), *map(float, q)) for i, (x, q) in enumerate(zip(w, p))]
    weighed = spark.createDataFrame(rows, "doc_id long, _w long, _p0 double, _p1 double, _p2 double")
    found = mixture.fit_rates(weighed, want, None, max_rate)
    assert found.converged
    got = np.array([r["r"] for r in weighed.select("doc_id", mixture.rate_of(found.gradient, max_rate).alias("r")).orderBy("doc_id").collect()])
    a = (w[:, None] * p).T
    # at first all rows are free; the ridge's metric is that of the operator
    gram = (w[:, None, None] * p[:, :, None] * p[:, None, :]).sum(axis=0)
    metric = np.linalg.inv(mixture.RIDGE * (gram + 1e-3 * np.trace(gram) / 3 * np.eye(3)))
    loss = lambda r: (a @ r - want) @ metric @ (a @ r - want) + (w * (r - 1) ** 2).sum()
    top = np.inf if max_rate is None else max_rate
    rng2 = np.random.default_rng(1)
    for _ in range(300):  # the optimum is better than what lies around it in any direction
        near = np.clip(got + rng2.normal(size=60) * 10 ** rng2.uniform(-4, -1), 0, top)
        assert loss(near) >= loss(got) - 1e-6 * loss(got)
    grad = 2 * a.T @ metric @ (a @ got - want) + 2 * w * (got - 1)
    scale = np.abs(2 * a.T @ metric @ want).max()
    inside = (got > 1e-9) & (got < top - 1e-9)
    assert np.abs(grad[inside]).max(initial=0) < 1e-3 * scale and (grad[got <= 1e-9] > -1e-3 * scale).all() and (grad[got >= top - 1e-9] < 1e-3 * scale).all()


def test_edited_copies_are_found(spark, small):
    rows = registry.QUERIES["op9_media_copies"](spark, small).collect()
    found = [r["edited_found"] for r in rows if r["vec_id"] % 20 == 0]
    assert np.mean(found) >= 0.9 and all(r["edited_found"] is None for r in rows if r["vec_id"] % 20)
    assert all(r["copy_class"] <= r["class_id"] <= r["vec_id"] for r in rows)


def test_pipeline(spark, small):
    import corpus_pipeline

    documents = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.run(spark, small).collect()
    ids = [r["doc_id"] for r in out]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = set(ids)
    clean = [i for i, r in labels.items() if not r["toxic"] and r["quality"]]
    toxic = [i for i, r in labels.items() if r["toxic"]]
    assert len(kept) == len(ids) and all(r["round_trip"] for r in out) and documents.count() > len(ids)
    assert np.mean([i in kept for i in toxic]) < np.mean([i in kept for i in clean])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents.limit(0), small).columns == documents.columns
