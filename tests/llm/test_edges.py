"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest

from matchloom.llm import bpe_codec, chat_windows, feistel_shard, imatch, langid_crf, media_copies, mixture, secret_index, simhash_ball, token_store
from matchloom.llm._common import scratch_path

LONG = "ab" * 30_000 + " " + "word " * 5_000
ROWS = [
    (1, "the thing was in the hand", "en", "s", 1),
    (1, "the thing was in the hand", "en", "s", 1),
    (2, None, None, None, None),
    (3, "", "de", "s", 0),
    (None, "der die das und nicht", "de", "s", 5),
    (None, None, None, None, None),
    (4, LONG, "en", "s", 9),
    (5, "12 34 !!", "en", "s", 8),
    (5, "password=hunter2hunter2 é", "en", "s", 8),
    (6, "der <|endoftext|> hand", "en", "s", 8),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_fingerprints(docs, none, spark):
    from xxhash import xxh64_intdigest

    def mark(text):
        h = 42 if text is None else xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) * (h >> 63)

    for rows, given in ((ROWS, docs), (many := [(None if i % 3 else i % 7, f"text {i}", None, None, None) for i in range(400)], spark.createDataFrame(many, KIND))):
        terms = imatch.lexicon(given, 0.0, 9.0)
        renamed = given.withColumnsRenamed({"lang": "band", "source": "key"})
        got = imatch.edit_probe(renamed, terms).collect()
        assert len(got) == len(rows)
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), mark(r[1]), r[1] is None, r[1] or ""))
        pairs = zip(order, order[1:] + order[:1])
        want = sorted(hashlib.sha256(imatch.edited(r[1] or "", n[1] or "").encode()).hexdigest() for r, n in pairs)
        assert sorted(r["edited_sha256"] for r in got) == want
        joined = imatch.edit_probe(given, terms, broadcast_terms=0).collect()
        assert sorted(map(repr, joined)) == sorted(map(repr, got))
    assert len({r["fingerprint"] for r in imatch.edit_probe(docs, terms).collect() if r["doc_id"] == 1}) == 1
    assert imatch.edit_probe(none, imatch.lexicon(none)).count() == 0
    assert imatch.edit_probe(none, imatch.lexicon(none), broadcast_terms=-1).count() == 0
    one = docs.where("doc_id = 4").select("doc_id", "text")
    assert imatch.edit_probe(one, imatch.lexicon(one, 0.0)).count() == 1


def test_rows_of_a_null_id_are_in_several_bands(spark):
    rows = [(None, f"text {i}") for i in range(4000)] + [(i, "x") for i in range(20)]
    banded = imatch.in_bands(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    sizes = sorted(r["count"] for r in banded.where("not tail").groupBy("band").count().collect())
    assert len(sizes) >= 4 and sizes[-1] < 1500 and banded.where("tail").count() == len(sizes)


def test_bpe(docs, none, spark):
    raw, pattern = bpe_codec.vocabulary(bpe_codec.RANKS), bpe_codec.split_pattern()
    got = bpe_codec.decode(bpe_codec.encode(docs.withColumn("ids", docs["doc_id"]), raw, pattern), raw).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((r[1] or "").encode() for r in ROWS)
    assert bpe_codec.encode(none, raw, pattern).count() == 0
    clash = docs.withColumn("round_trip", docs["doc_id"])
    both = bpe_codec.there_and_back(clash, raw, pattern, decoded=False)
    assert "text" not in both.columns and [r["round_trip"] for r in both.collect()] == [True] * len(ROWS)
    assert sorted(map(tuple, (r["ids"] for r in both.collect()))) == sorted(map(tuple, (r["ids"] for r in got)))
    assert sorted(bytes(r["decoded"]) for r in bpe_codec.there_and_back(docs, raw, pattern).collect()) == sorted((r[1] or "").encode() for r in ROWS)
    assert bpe_codec.there_and_back(none, raw, pattern).count() == 0


def test_shards(docs, none):
    rows = docs.selectExpr("doc_id", "coalesce(text, '') as t", "source as shard_name")
    got = feistel_shard.shard_rows(rows, [rows["doc_id"].asc_nulls_first(), rows["t"]], 4).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert sum(counts) == len(ROWS) and max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s])) for s in range(4))
    assert feistel_shard.shard_rows(none.select("doc_id"), [none["doc_id"]]).count() == 0
    names = ["part", "at", "start", "row", "p", "_at", "shard", "n"]
    clash = docs.selectExpr("doc_id", *[f"'x' as {n}" for n in names])  # rows of an id are ties of the whole order
    got = feistel_shard.shard_rows(clash, [clash["doc_id"]], 3)
    assert sorted(got.columns) == sorted({"doc_id", "row_no", "slot", *names})
    assert sorted(r["row_no"] for r in got.collect()) == list(range(len(ROWS))) and {r["part"] for r in got.collect()} == {"x"}


def test_simhash(docs, none):
    got = simhash_ball.near_duplicates(docs, words=3).collect()
    assert len(got) == len(ROWS)
    assert {r["component_id"] for r in got if r["node"] == 0} == {2}  # null and empty texts; a null id doesn't name it
    for find in (simhash_ball.near_texts, simhash_ball.near_duplicates):
        kept = simhash_ball.keep_one(docs, find=find, words=3)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((r[0] or 0, r[1] or "") for r in {ROWS[0], ROWS[2], *ROWS[6:], ROWS[4]})
        assert simhash_ball.keep_one(docs, broadcast_rows=-1, find=find, words=3).count() == kept.count()
    assert simhash_ball.near_duplicates(none).count() == 0 and simhash_ball.keep_one(none).count() == 0


def test_token_store(docs, none, spark):
    from tokenizers import Tokenizer

    raw = bpe_codec.vocabulary("byte_bpe_50k.json")
    plain = Tokenizer.from_str(raw.decode())
    path = scratch_path(spark, "test-tokens")
    token_store.write(docs, path, raw)
    got = token_store.checksums(token_store.read(spark, path)).collect()
    at = 0
    for r, (_, text, *_rest) in zip(sorted(got, key=lambda r: r["start"]), sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = scratch_path(spark, "test-tokens")
    token_store.write(none, empty, raw)
    assert token_store.read(spark, empty).count() == 0


def test_token_store_layout(docs, spark):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "test-layout")
    token_store.write(docs, path, bpe_codec.vocabulary("byte_bpe_50k.json"))
    columns = []
    for f in glob.glob(path.removeprefix("file:") + "/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns += [group.column(i) for i in range(group.num_columns)]
    assert all("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.path_in_schema == "doc_id")
    # a dictionary is given up where it would be no smaller, as in files of a few ids
    ids = max((c for c in columns if c.path_in_schema == "ids.list.element"), key=lambda c: c.num_values)
    assert ids.num_values > 10_000 and any("DICTIONARY" in e for e in ids.encodings)
    assert all(c.has_offset_index and c.has_column_index for c in columns)


def test_secrets(docs, none):
    clash = docs.withColumnRenamed("lang", "rules").withColumnRenamed("source", "kind")
    got = secret_index.scan(clash).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert [(s["start"], s["end"], secret_index.RULES[s["kind"]].kind) for s in r["secret_spans"]] == secret_index.brute_force(r["text"])
    assert secret_index.scan(docs, broadcast_rows=-1).count() == len(ROWS)
    assert secret_index.scan(none).count() == 0
    assert {r["text"] for r in secret_index.redact(docs).where("doc_id = 5").collect()} == {"12 34 !!", "<secret> é"}


def test_language(docs, none):
    model = langid_crf.train([("the thing was in the hand of that", "en"), ("der die das und nicht mit dem", "de")] * 20)
    got = langid_crf.label(docs.withColumnRenamed("source", "score"), model).collect()
    assert len(got) == len(ROWS)
    found = {(r["doc_id"], r["text"]): r["lang_pred"] for r in got}
    assert found[1, ROWS[0][1]] == "en" and found[None, ROWS[4][1]] == "de"
    assert {found[2, None], found[3, ""], found[5, "12 34 !!"], found[None, None]} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got) and langid_crf.label(none, model).count() == 0
    untaught = langid_crf.train([])
    assert {r["lang_pred"] for r in langid_crf.label(docs, untaught).collect()} == {"und"}
    assert langid_crf.training_rows(none, none["doc_id"].isNotNull()) == []
    long = docs.sparkSession.createDataFrame([(i, "first " * 2_000 + "later " * 4_000, "en") for i in range(40)], "doc_id long, text string, lang string")
    taken = [t for t, _ in langid_crf.training_rows(long, long["lang"].isNotNull())]
    assert all(len(t) == langid_crf.TRAIN_CHARS for t in taken) and 10 < sum("first" not in t for t in taken) < 40


def test_mixture(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    fitted, narrow = mixture.fit_mixture(docs, labels)
    got = fitted.rated(narrow).collect()
    assert len(got) == len(ROWS) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in got)
    assert {r["rate"] for r in got if r["_w"] == 0} == {1.0}
    assert mixture.resample(docs, labels, keep={"toxic": 0.1}, max_rate=1.0).columns == docs.columns
    assert mixture.resample(docs, labels.limit(0)).count() == len(ROWS)
    assert mixture.resample(none, labels).count() == 0
    names = ["rate", "copies", "_w", "_p0", "_b", "_copy", "_id", "_domain", "text_"]
    clash = docs.selectExpr("doc_id", "text", *[f"'x' as {n}" for n in names])
    drawn = mixture.resample(clash, labels)
    assert drawn.columns == clash.columns and {r[n] for r in drawn.collect() for n in names} <= {"x"}


def test_media(spark):
    v = np.random.default_rng(1).normal(size=64)
    image = media_copies.render(v.tolist())
    cut = media_copies.encode_pgm(media_copies.edit(image))
    whole = media_copies.encode_pgm(image)
    rows = [(1, whole), (2, whole), (3, cut), (4, None), (5, b"no image"), (6, b""), (7, media_copies.encode_pgm(np.zeros((4, 4)))), (8, media_copies.encode_pgm(np.zeros((0, 0))))]
    images = spark.createDataFrame(rows, "id long, image binary")
    d = media_copies.descriptors(images.withColumn("node", images["id"]).withColumn("payload", images["id"]))
    assert {r["node"] for r in d.collect()} == {1, 2, 3}
    assert {(r["node"], r["root"]) for r in media_copies.copies(d).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {(r["class_id"], r["class_size"]) for r in media_copies.classes(images).collect()} >= {(1, 2), (3, 1)}
    assert media_copies.descriptors(images.limit(0)).count() == 0 and media_copies.copies(d.limit(0)).count() == 0


def test_png():
    import struct

    rgb = np.random.default_rng(2).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    flat = rgb.reshape(5, 21).astype(int)
    lines = b""
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        left = np.r_[np.zeros(3, int), flat[y, :-3]]
        up = flat[y - 1] if y else np.zeros(21, int)
        corner = np.r_[np.zeros(3, int), up[:-3]]
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = (0 * left, left, up, (left + up) // 2, near)[kind]
        lines += bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert np.array_equal(media_copies.decode(data), rgb.mean(axis=2).astype(np.uint8))
    assert media_copies.decode(data[:40]) is None


def test_chat(spark):
    rows = [
        (1, 0, "system", "be < kind <|end|> <."),
        (1, 1, "user", "x" * 900),
        (1, 2, "assistant", "y" * 5000),
        (1, 3, None, None),
        (1, 4, "assistant", chat_windows.PROBE),
        (1, 4, "assistant", chat_windows.PROBE),
        (2, None, "assistant", ""),
        (None, 1, "us<er", "<|turn|>"),
    ]
    rows += [(None, 1, "us<er", "<|turn|>"), (None, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows.windows(turns.withColumn("window", turns["role"]).withColumn("n", turns["role"]))
    read = chat_windows.read_back(windows).collect()
    got = {r["conv_id"]: r for r in read if r["conv_id"]}
    for conv in (1, 2):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [tuple(t) for t in got[conv]["turns"]] == own
        assert got[conv]["targets"] == [t for r, t in own if r == "assistant"]
    alone = [[tuple(t) for t in r["turns"]] for r in read if r["conv_id"] is None]
    assert sorted(alone) == [[("assistant", "")], [("us<er", "<|turn|>")], [("us<er", "<|turn|>")]]
    later = [r["formatted"] for r in windows.where("conv_id = 1 and window > 0").collect()]
    assert later and not all(w.startswith("<|past|>system") for w in later) and any(w.startswith("<|past|>system") for w in later)
    assert chat_windows.windows(turns.limit(0)).count() == 0


def tokens(part):
    """Of one formatted turn, read from the text alone."""
    text = part.split(chat_windows.TEXT, 1)[1].replace("<.", "<")
    return -(-len(text) // 4) + chat_windows.TURN_TOKENS


def test_no_window_is_over_the_budget_unless_it_is_one_turn(spark):
    rng = np.random.default_rng(6)
    rows = []
    for conv in range(120):
        system = int(rng.integers(-1, 4))
        for turn in range(int(rng.integers(1, 30))):
            role = "system" if turn == system else ("user", "assistant")[turn % 2]
            size = int(rng.choice([3, 40, 200, 400, 900, 1500, 1700, 3000], p=[0.2, 0.2, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]))
            rows.append((conv, turn, role, "a<" * (size // 2)))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_windows.windows(turns).collect()
    turns_of = {(c, t): (r, x) for c, t, r, x in rows}
    alone = 0
    at = {}
    for w in sorted(found, key=lambda w: (w["conv_id"], w["window"])):
        parts = w["formatted"].split(chat_windows.END)[:-1]
        past = [p for p in parts if p.startswith(chat_windows.PAST)]
        new = [p for p in parts if p.startswith(chat_windows.TURN)]
        assert parts == past + new and new
        total = sum(map(tokens, parts))
        if total > chat_windows.BUDGET:
            assert len(parts) == 1
            alone += 1
        # the window was full: the next turn wouldn't have fitted; and the repeated part is as large as it may be
        first = at.get(w["conv_id"], 0)
        at[w["conv_id"]] = first + len(new)
        following = turns_of.get((w["conv_id"], first + len(new)))
        if following:
            assert total + -(-len(following[1]) // 4) + chat_windows.TURN_TOKENS > chat_windows.BUDGET
        system = next((t for t in range(first) if turns_of[w["conv_id"], t][0] == "system"), None)
        if system is not None:
            n = -(-len(turns_of[w["conv_id"], system][1]) // 4) + chat_windows.TURN_TOKENS
            assert any(p.startswith(chat_windows.PAST + "system") for p in past) == (n + tokens(new[0]) <= chat_windows.BUDGET)
    assert alone > 10 and max(at.values()) > 20


def test_a_long_conversation_stays_linear(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "x" * 200) for t in range(20_000)]
    out = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert out.selectExpr("sum(length(formatted))").first()[0] < 3 * 250 * len(rows)
