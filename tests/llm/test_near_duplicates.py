import numpy as np
import pytest

import corpus_pipeline
from matchloom.llm import likeness, meet, simhash_ball


def classes_of(n, near):
    """The least place in each one's component, by brute force."""
    root = np.arange(n)
    for i in range(n):
        for j in np.flatnonzero(near(i)):
            if root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
    return root.tolist()


def keys_of(prints):
    """Tables x nodes of 32-bit keys."""
    low = prints & np.uint64((1 << 32) - 1)
    return np.stack([x for t in range(prints.shape[1]) for x in (low[:, t], prints[:, t] >> np.uint64(32))])


@pytest.mark.parametrize("many", [60, 400])
def test_all_within_two_bits_of_a_table_meet(spark, many):
    rng = np.random.default_rng(many)
    original = rng.integers(0, 1 << 64, 8, np.uint64)
    flipped = np.packbits(rng.random((many, 8, 64)) < 0.06, axis=2, bitorder="little").view("<u8")[:, :, 0]
    prints = np.concatenate([original[None], original ^ flipped, rng.integers(0, 1 << 64, (50, 8), np.uint64)])
    near = (np.bitwise_count(keys_of(prints)[:, :, None] ^ keys_of(prints)[:, None]) <= 2).any(axis=0)
    want = {(i, j) for i, j in np.argwhere(near) if i < j}
    assert 100 < len(want) < len(prints) ** 2 / 2
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(prints.view(np.int64).tolist())], "node long, prints array<long>")
    met = simhash_ball.meetings(nodes).toPandas()
    assert (met.groupby("bucket").node.nunique() == met.groupby("bucket").n.first()).all() and not met.duplicated(["bucket", "node"]).any()
    got = {(i, j) for _, g in met.groupby("bucket") for i in g.node for j in g.node if i < j}
    assert got == want


def test_large_buckets_are_compared_in_full(spark):
    """Copies of one original that are not near each other, all in one bucket."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    sets = {0: {hash(w) for w in words}}
    for i in range(1, 700):
        lost = rng.permutation(300)[: 25 if i % 2 else 90]
        sets[i] = {hash(words[k]) for k in range(300) if k not in lost} | {int(x) for x in rng.integers(1 << 60, size=len(lost))}
    order = rng.permutation(700).tolist()
    payload = spark.createDataFrame([(order[i], [x % (1 << 62) for x in s]) for i, s in sets.items()], "node long, payload array<long>")
    met = payload.selectExpr("bigint(7) as bucket", "node", "bigint(700) as n").unionByName(payload.selectExpr("bigint(8) as bucket", "node", "bigint(700) as n"))
    a, b = payload.selectExpr("node", "payload as p"), payload.selectExpr("node as before", "payload as q")
    grouped = meet.groups(met)
    assert grouped.select("bucket").distinct().count() == 1 and grouped.count() == 700
    found = meet.first_pairs(grouped).join(a, "node").join(b, "before")
    found = found.where(likeness.alike(found["p"], found["q"], 0.8)).selectExpr("before as a", "node as b")
    assert found.count() < 349
    root = {r["node"]: r["root"] for r in meet.roots(grouped, found, payload, likeness.kernel(0.8)).collect()}
    by_bucket = {r["node"]: r["root"] for r in meet.roots(meet.groups(met, 100), found, payload, likeness.kernel(0.8)).collect()}
    assert root == by_bucket
    held = [{x % (1 << 62) for x in sets[i]} for i in range(700)]
    alike = np.array([[len(p & q) / len(p | q) >= 0.8 for q in held] for p in held])
    want = classes_of(700, lambda i: alike[i])
    assert len({root.get(order[i], order[i]) for i in range(700)}) == len(set(want))
    assert all(root.get(order[i], order[i]) == root.get(order[want[i]], order[want[i]]) for i in range(700))


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_keeps_one_of_each_class_of_likeness(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(1 << 30)}"

    def edited(words, share):
        return [word() if rng.random() < share else w for w in words]

    texts = []
    for share in np.linspace(0.005, 0.04, 60):  # likeness from about 0.95 to 0.65
        base = [word() for _ in range(rng.integers(60, 300))]
        texts += [base, edited(base, share)]
    many = [word() for _ in range(200)]
    texts += [many, *(edited(many, 0.018) for _ in range(150))]  # each near the original, few near each other
    texts = [" ".join(t) for t in texts] + ["", "one two", "one two"]
    sets = [shingles(t) for t in texts]
    alike = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    assert ((alike >= 0.8) & (alike < 0.85)).sum() > 100 and ((alike >= 0.7) & (alike < 0.8)).sum() > 1000
    want = classes_of(len(texts), lambda i: alike[i] >= 0.8)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_stage_finds_the_copies_of_the_documents(spark, small):
    """All pairs of a likeness of 0.8 or more among the documents, by brute force over an index of shingles."""
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = {r["doc_id"]: shingles(r["text"] or "") if (r["text"] or "").split() else set() for r in docs.collect()}
    ids = sorted(texts)
    having = {}
    for i, d in enumerate(ids):
        for s in texts[d]:
            having.setdefault(s, []).append(i)

    def near(i):
        out = np.zeros(len(ids), bool)
        mine = texts[ids[i]]
        for j in {j for s in mine for j in having[s]} if mine else [j for j, d in enumerate(ids) if not texts[d]]:
            other = texts[ids[j]]
            out[j] = len(mine & other) >= 0.8 * len(mine | other)
        return out

    want = {d: ids[w] for d, w in zip(ids, classes_of(len(ids), near))}
    assert 50 < len(ids) - len(set(want.values()))
    found = simhash_ball.near_texts(docs)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want
    assert {r["doc_id"] for r in simhash_ball.keep_one(docs, broadcast_rows=-1).collect()} == set(want.values())


def test_columns_of_any_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "a b", 5, 6, 7), (3, "c", 1, 2, 3)], "doc_id long, text string, n long, told long, class long")
    assert sorted(map(tuple, simhash_ball.keep_one(docs).collect())) == [(1, "a b", 5, 6, 7), (3, "c", 1, 2, 3)]


def test_empty_and_null_texts_are_one_class(spark):
    docs = spark.createDataFrame([(3, None), (2, ""), (None, " "), (5, "a b"), (5, "a b"), (6, "A  b")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in corpus_pipeline.NEAR["find"](docs).collect()}
    assert got == {(3, 2), (2, 2), (None, 2), (5, 5), (6, 5)}
    assert corpus_pipeline.NEAR["find"](docs.where("false")).count() == 0
