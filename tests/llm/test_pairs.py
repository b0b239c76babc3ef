"""Near-duplicates, vectors and leaks against brute force, with awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpmill.llm import leaks, vectors
from kelpmill.llm.neardup import NearDuplicates, probminhash
from kelpmill.llm.text import WordHashes, shingles, words
from tests.llm import brute

TEXTS = "id string, text string, n int, band string, digest string, a string"  # with names the operator uses itself


def corpus(seed=1, n=40):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = {}
    for i in range(n):
        base = [vocabulary[j] for j in rng.integers(0, 400, 60)]
        for v in range(3):
            edited = list(base)
            for _ in range(v * 3):
                edited[rng.integers(0, len(edited))] = "edit"
            out[f"d{i}-{v}"] = " ".join(edited)
    return out


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, "x", "y", "z") for k, t in texts], TEXTS)


def test_near_duplicates_match_brute_force(spark):
    texts = corpus()
    texts |= {"copy": texts["d0-0"], "copy2": texts["d0-0"], "short": "a b", "punct": "...", "Üx": "Ä ä É é x y z 가나 다라"}
    rows = [*texts.items(), ("null", None), ("empty", ""), ("copy", texts["copy"]), (None, "a b c d")]
    near = NearDuplicates(frame(spark, rows), "id", "text", words_per_shingle=3, threshold=0.6, bands=50, rows=4)
    got = {tuple(r) for r in near.pairs().collect()}
    want = brute.similar_texts(texts, 3, 0.6)
    assert got <= want and len(got) >= 0.99 * len(want)
    docs = {r.id: r for r in near.documents().collect()}
    assert docs["copy"].class_id == docs["d0-0"].class_id and "short" not in docs and len(docs) == len(texts) - 2


def test_near_duplicates_of_nothing(spark):
    near = NearDuplicates(frame(spark, []), "id", "text")
    assert near.pairs().count() == 0 and near.documents().count() == 0


def test_probminhash_estimates_similarity():
    h = WordHashes()
    a, b = shingles(h([f"a{i}" for i in range(300)]), 1), shingles(h([f"a{i}" for i in range(100, 400)]), 1)
    reg = probminhash(np.r_[a, b], np.ones(600), np.r_[np.zeros(300, int), np.ones(300, int)], 2, 2000)
    assert abs((reg[0] == reg[1]).mean() - 0.5) < 0.05
    w = np.r_[np.full(300, 1.0), np.full(300, 5.0)]  # scaling all weights of a set changes nothing
    reg = probminhash(np.r_[a, b], w, np.r_[np.zeros(300, int), np.ones(300, int)], 2, 2000)
    assert abs((reg[0] == reg[1]).mean() - 0.5) < 0.05
    x = probminhash(np.r_[a, a], np.r_[np.ones(300), np.r_[np.full(100, 9.0), np.ones(200)]], np.r_[np.zeros(300, int), np.ones(300, int)], 2, 2000)
    assert (x[0] == x[1]).mean() < 0.8


def test_very_long_text(spark):
    long = " ".join(f"x{i % 5000}" for i in range(200_000))
    near = NearDuplicates(frame(spark, [("a", long), ("b", long + " end")]), "id", "text")
    assert {tuple(r) for r in near.pairs().collect()} == {("a", "b")}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 64))
    vecs = {f"v{i}": (centres[i % 60] + 0.25 * rng.standard_normal(64) * (i % 4 > 0)).astype(np.float32).tolist() for i in range(240)}
    vecs |= {f"n{i}": rng.standard_normal(64).astype(np.float32).tolist() for i in range(400)}
    rows = [(k, v, i, 0, 0) for i, (k, v) in enumerate(vecs.items())]
    rows += [("bad1", None, 1000, 0, 0), ("bad2", [0.0] * 64, 1001, 0, 0), ("bad3", [1.0] * 63, 1002, 0, 0), ("bad4", [float("nan")] * 64, 1003, 0, 0), ("bad5", [float("inf")] + [0.0] * 63, 1004, 0, 0), ("v0", [1.0] * 64, 2000, 0, 0), (None, [1.0] * 64, 2001, 0, 0)]
    df = spark.createDataFrame(rows, "id string, v array<float>, o int, cell int, vid int")
    got = {tuple(sorted((r.a, r.b))) for r in vectors.similar(df, "id", "v", "o").collect()}
    want = brute.neighbours(vecs, 5, 0.8)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)


def test_equal_vectors_and_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "ASK", 40)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    rows = [(f"c{i:03}", (base + 0.01 * rng.standard_normal(64)).astype(np.float32).tolist(), i) for i in range(100)] + [(f"e{i}", [1.0] + [0.0] * 63, i) for i in range(8)]
    got = vectors.similar(spark.createDataFrame(rows, "id string, v array<float>, o int"), "id", "v", "o").collect()
    per = {}
    for r in got:
        per.setdefault(r.a, []).append(r)
    assert len(per) == 108 and all(len(v) == 5 for v in per.values())
    assert [r.b for r in sorted(per["e0"], key=lambda r: r["rank"])] == ["e1", "e2", "e3", "e4", "e5"]
    want = brute.neighbours({k: v for k, v, _ in rows if k[0] == "c"}, 5, 0.8)
    assert len({tuple(sorted((r.a, r.b))) for r in got if r.a[0] == "c"} & want) >= 0.95 * len(want)


def test_no_vectors(spark):
    assert vectors.similar(spark.createDataFrame([], "id string, v array<float>, o int"), "id", "v", "o").count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).standard_normal((5, 64)).astype(np.float32)
    r = vectors.rotate(x, 3)
    assert np.allclose(r @ r.T, x @ x.T, atol=1e-3)


@pytest.mark.parametrize("n", [1, 3])
def test_leaks_match_brute_force(spark, n):
    rng = np.random.default_rng(4)
    v = [f"t{i}" for i in range(60 if n == 1 else 300)]
    say = lambda k: " ".join(v[j] for j in rng.integers(0, len(v), k))
    items = {i: say(40) for i in range(20)} | {90: "too short", 91: ""}
    docs = {i: say(80) for i in range(60)}
    for i in range(0, 60, 3):
        part = items[i % 20].split()[5 : 5 + 4 + i % 12]
        docs[i] = docs[i][:50] + " > " + ", ".join(part) + ". " + docs[i][50:]
    d = spark.createDataFrame([*[(k, t, 1) for k, t in docs.items()], (None, "x", 1), (99, None, 1), (100, "", 1)], "doc_id long, text string, longest int")
    i = spark.createDataFrame([*items.items(), (None, "y"), (50, None)], "item_id int, item_text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(d, i, min_words=6).collect()}
    assert got == brute.leaks(docs, {k: t for k, t in items.items()}, 6)
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0


def test_tiles_cover_reordered_passages(monkeypatch, spark):
    h = WordHashes()
    x, y = h(words("b1 b2 b3 b4 mid a1 a2 a3 a4")), h(words("a1 a2 a3 a4 x b1 b2 b3 b4"))
    assert sorted(leaks.tiles(x, y, 3)) == [(0, 5, 4), (5, 0, 4)]
    same = h(["z"] * 50)
    assert sum(n for *_, n in leaks.tiles(same, same[:20], 3)) == 20
    monkeypatch.setattr(leaks, "FILTER_SEEDS", 3)  # too many seeds for a filter: documents meet them by a join
    d = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    i = spark.createDataFrame([(k, "a b c d e f" + f" q{k}" * 20) for k in range(5)], "item_id int, item_text string")
    assert leaks.leaks(d, i, min_words=6).count() == 5


def test_what_a_mark_leaves_of_a_run_waits_for_its_turn():
    h = WordHashes()
    # the run of 10 marks c d e of the run of 9 in the item; its rest a b is too short, f g h i still stands
    x = h(words("p q r s t u v c d e, a b c d e f g h i"))
    y = h(words("p q r s t u v c d e f g h i"))
    assert leaks.tiles(x, y, 3) == [(0, 0, 10), (15, 10, 4)]
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, y = (h([str(k) for k in rng.integers(0, 4, n)]) for n in rng.integers(1, 40, 2))
        assert sorted(zip(*map(np.ndarray.tolist, leaks.runs(x, y, 3)))) == sorted(brute.common_runs(x.tolist(), y.tolist(), 3))
        assert [n for *_, n in leaks.tiles(x, y, 3)] == [n for *_, n in brute.tiles(x.tolist(), y.tolist(), 3)]


def test_a_word_said_a_hundred_thousand_times():
    h = WordHashes()
    x, y = h(["na"] * 100_000), h(["na"] * 400)
    i, j, n = leaks.runs(x, y, 12)
    assert len(i) <= 100_400 and n.max() == 400 and leaks.tiles(x, y, 12) == [(0, 0, 400)]


def test_long_documents_of_one_word(spark):
    d = spark.createDataFrame([(1, "na " * 20_000)], "doc_id long, text string")
    i = spark.createDataFrame([(1, "na " * 30)], "item_id int, item_text string")
    r = leaks.leaks(d, i).first()
    assert r.longest == 30 and r.covered == 30


def test_words_are_letters_and_digits():
    assert words("Ab-1_c é 가나! ２") == ["ab", "1", "c", "é", "가나", "２"]
    assert words(None) == [] and F is not None


def met(depth, among, tables, probes=3, similarity=0.81, n=1500):
    """Share of random pairs of a similarity that meet in a cell."""
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = similarity * a + np.sqrt(1 - similarity**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = _cells(a, depth, among, tables, probes), _cells(b, depth, among, tables, probes)
    return ((x[:, :, :1] == y).any(axis=(1, 2)) | (y[:, :, :1] == x).any(axis=(1, 2))).mean()


def _cells(v, depth, among, tables, probes):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(v))), pa.array(list(v), pa.list_(pa.float64()))], names=["vid", "v"])
    out = next(vectors._hashed(64, range(tables), depth, among, probes)([batch]))
    return out.column("cells").flatten().to_numpy().reshape(len(v), tables, probes)


def test_pairs_meet_at_every_number_of_vectors():
    """At 0.80 itself at least nine tenths, whatever the size; cells keep their mean size."""
    for n in (100, 5_000, 60_000, 100_000, 150_000, 500_000, 3_000_000, 20_000_000):
        depth, among, tables = vectors.planned(n, 64, 6, 0.8, 3)
        cells = 128 ** (depth - 1) * 2 * among
        assert n < 1000 or 2 <= n / cells <= 13, (n, depth, among)
        assert met(depth, among, tables, similarity=0.80) >= 0.9, (n, depth, among, tables)


def test_pairs_meet_with_four_rotations():
    depth, among, tables = vectors.planned(1_000_000_000, 64, 6, 0.8, 3)
    assert depth == 4 and met(depth, among, tables, similarity=0.80, n=400) >= 0.9
