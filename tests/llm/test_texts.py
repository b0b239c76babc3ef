"""Splitting, transcripts, mails, personal data, mixing and subjects."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpmill.llm import mail, mixing, personal, speech, split, subjects, tagger, trees
from tests.llm import brute


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n가", max_size=300), st.integers(1, 60), st.integers(0, 40))
def test_pieces_give_back_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    ends = split.cuts([text], [limit], [overlap])[0] if text else np.array([0])
    starts = np.r_[0, np.maximum(ends[:-1] - overlap, 0)]
    assert ends[-1] == len(text) and all(e - s <= limit for s, e in zip(starts, ends))
    assert text[: ends[0]] + "".join(text[a:b] for a, b in zip(ends[:-1], ends[1:])) == text
    if text:
        assert ends.tolist() == brute.greedy_cuts(split.successors(split.boundary_rank(text), limit, overlap).tolist())


def test_groups_of_texts_are_bounded(monkeypatch):
    monkeypatch.setattr(split, "AT_ONCE", 10)
    assert [list(range(9))[p] for p in split._groups([3, 4, 4, 50, 1, 1, 9, 1, 9])] == [[0, 1], [2], [3], [4, 5], [6, 7], [8]]
    assert list(split._groups([])) == []


def test_split_prefers_paragraphs(spark):
    text = "One sentence. Two here.\n\nNext paragraph goes on and on. End."
    rows = [(1, "a", text), (2, "a", None), (3, "a", ""), (4, "b", text * 3), (5, "c", text), (1, "a", text)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "record_id long, source_type string, content string, max_chars int")
    limits = spark.createDataFrame([("a", 40, 5), ("b", None, None), ("a", 50, 9)], "source_type string, max_chars int, overlap_chars int")
    out = split.pieces(split.with_limits(docs, limits), "record_id", "content").collect()
    one = sorted({(r.piece_no, r.piece) for r in out if r.row == 1})
    assert one[0] == (1, "One sentence. Two here.\n\n") and all(len(p) <= 40 for _, p in one)
    assert one[1][1].startswith(one[0][1][-5:])
    assert {r.row for r in out} == {1, 3, 4, 5} and sum(r.row == 4 for r in out) == 1
    assert split.oversized_pieces(split.with_limits(docs.limit(0), limits), "record_id", "content").count() == 0


def test_cleaning():
    cases = {
        "[00:00:11] S1> 음, 솔직히 모두가": ("솔직히 모두가", "1"), "(00:03) [화자2] (웃음)": ("", "2"), "00:00:25.200 --> um... the spring": ("the spring", None), "spk 4 - er": ("", "4"),
        "speaker b - 네": ("네", "b"), "<A> ok": ("ok", "a"), "A: yes": ("yes", "a"), "SPEAKER_01: ♪ ♪": ("", "1"), "((crosstalk)) *coughs*": ("", None), "": ("", None), "01:08 - 혹시 어, 몰라서": ("혹시 몰라서", None),
        "yara [at] post [dot] test": ("yara [at] post [dot] test", None), "[1m32s] x": ("x", None), "Speaker #1: Eh eh ehm.": ("", "1"), "the 10:30 train": ("the 10:30 train", None),
    }
    for text, want in cases.items():
        assert speech.clean(text) == want, text
    assert speech.clean(None) == ("", None)
    assert speech.speaker_key("SPEAKER_01 ") == speech.speaker_key("spk1") == "1" and speech.speaker_key(" ") is None


SEGMENTS = [("r", 0, 0.0, 2.0, "hello"), ("r", 0, 0.0, 2.0, "hello"), ("r", 2, 5.0, 6.0, "third"), ("r", 1, 3.0, 4.0, "[music]"), ("r", 3, 70.0, 71.0, "far"), ("n", 0, 0.0, 1.0, "A: one two"), ("n", 1, 1.0, 2.0, "B: red blue"), ("n", 2, 2.0, 3.0, "one two one"), ("n", 3, 3.0, 4.0, "B: red"), ("u", 0, None, None, "x"), ("r", 4, 90.0, 91.0, None)]
DIAR = [("r", 0.0, 1.5, "SPEAKER_01"), ("r", 1.0, 2.0, "spk2"), ("r", 4.9, 6.2, "Speaker 2"), ("r", 60.0, 65.0, "1"), ("r", 60.0, 65.0, None), ("x", 0.0, 1.0, "1")]


def frames(spark, segments=SEGMENTS, diar=DIAR):
    return spark.createDataFrame([(*s, "t") for s in segments], "recording_id string, seg_index int, start_sec double, end_sec double, seg_text string, text string"), spark.createDataFrame(diar, "recording_id string, start_sec double, end_sec double, speaker string")


def test_turns(spark):
    rows = {(r.recording_id, r.seg_index): (r.turn_no, r.speaker_no) for r in speech.turns_of_segments(*frames(spark)).collect()}
    assert rows[("r", 0)] == (1, 1) and rows[("r", 2)] == (2, 2) and rows[("r", 3)] == (3, 1)
    assert rows[("n", 2)][1] == 1, "the words of segment 2 are those of speaker a"
    assert rows[("u", 0)] == (1, 1) and ("r", 1) not in rows and ("r", 4) not in rows
    assert {r.text for r in speech.turns(*frames(spark)).filter("recording_id = 'r'").collect()} == {"hello", "third", "far"}


@pytest.mark.parametrize("seconds", [600.0, 7.0])
def test_turns_match_brute_force(spark, monkeypatch, seconds):
    monkeypatch.setattr(speech, "STRETCH_SECONDS", seconds)  # many stretches
    rng = np.random.default_rng(1)
    seg, diar, t = [], [], 0.0
    for i in range(200):
        t += float(rng.uniform(0.1, 9))
        seg.append(("q", i, round(t, 2), round(t + 2, 2), f"word{i}"))
        if rng.random() < 0.6:
            diar.append(("q", round(t - float(rng.uniform(0, 2)), 2), round(t + float(rng.uniform(0.5, 3)), 2), f"S{rng.integers(1, 4)}"))
    got = {tuple(r) for r in speech.turns_of_segments(*frames(spark, seg, diar)).select("recording_id", "seg_index", "turn_no", "speaker_no").collect()}
    assert got == brute.turns(seg, diar)
    assert speech.turns_of_segments(*frames(spark, seg[:0], diar)).count() == 0


def test_the_place_of_a_row_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(speech, "STRETCH_SECONDS", 2.0)
    starts = [None, None, -5.0, 0.0, 0.5, 1.9, 2.0, 9.0, 9.0, 30.0]
    rows = [("r", s, k, 0.0, k, None if k % 3 == 0 else f"v{k}") for k, s in enumerate(starts)] + [("q", 1.0, 0, 0.0, 100, "x")]
    df = speech.in_order(spark.createDataFrame(rows, "recording_id string, start_sec double, seg_index int, end_sec double, uid long, v string"), "v")
    got = {r.uid: (r._row, r.before, r.total) for r in speech.running_sum(df.withColumn("one", F.lit(1)), "one", "total").collect()}
    assert got[100] == (0, None, 1)
    assert [got[k] for k in range(10)] == [(k, rows[k - 1][5] if k else None, k + 1) for k in range(10)]


MAIL = "Hi Bo,\r\n\r\nThe parcel came back twice in the usual order.\r\n\r\nKind regards\r\nAnn Lee\r\nTel. 010-0001-0002\r\n\r\nOn 06 June 2025 10:49, Bo Kim <bo@x.test>\r\nwrote:\r\n> Dear Ann,\r\n> The old text stands here for a while.\r\n"


def test_new_lines_of_mails(spark):
    reply = "Bo Kim wrote on 2025-06-08:\n    The parcel came back twice in the usual order.\n\nThanks, this is a wholly new line of text.\n\nSent from my phone"
    docs = spark.createDataFrame([(1, "gmail", "gmail:a", MAIL, 0), (2, "gmail", "gmail:b", reply, 0), (3, "gmail", "gmail:c", None, 0), (4, "gmail", "gmail:d", " \n\n", 0), (5, "note", "n", "x", 0), (6, "gmail", "gmail:zz", "Just one new sentence without headers.", 0), (7, "gmail", "gmail:a", MAIL, 0)], "record_id long, source_type string, source_id string, content string, sender int")
    heads = spark.createDataFrame([("a", "t", "Ann Lee <ann@x.test>", "1000"), ("b", "t", "Bo Kim <bo@x.test>", "2000"), ("c", None, None, "bad"), ("d", "t", None, None)], "message_id string, thread_id string, from_header string, internal_date string")
    got = {}
    for r in mail.new_lines(docs, heads).collect():
        got.setdefault(r.record_id, set()).add(r.line_no)
    assert got[1] == got[7] == {1, 3}
    assert got[2] == {4} and got[6] == {1} and not {3, 4, 5} & set(got)
    assert {r.record_id: r.new_text for r in mail.new_text(docs, heads).collect()}[1].startswith("Hi Bo,\nThe parcel")
    assert mail.new_lines(docs.limit(0), heads).count() == 0


def test_long_lines_are_units_of_their_sender():
    import pyarrow as pa

    long = "This notice is for the named reader only " * 6
    batch = pa.RecordBatch.from_pydict({"record_id": [1], "mail": [1], "sender": ["a"], "thread": ["t"], "sent": [1], "content": [f"Hello there\n\n{long}"]})
    out = next(mail._units([batch])).to_pydict()
    assert out["kind"].count(0) == len([line for line in mail.parse(f"Hello there\n\n{long}")[0] if line.body])


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = trees.fit(x[:1500], y[:1500], trees=40)
    assert ((trees.score(m, x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_network_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in tagger.init(5, 4, 3).items()}
    x = rng.integers(40, 120, (3, 7)).astype(np.int16)
    y, n = rng.integers(0, 5, (3, 7)).astype(np.int8), np.array([7, 5, 2])
    p32 = {k: v.astype(np.float32) for k, v in p.items()}
    _, g = tagger.gradients(p32, x, n, y)
    for k, at in (("A", (1, 2)), ("V", (2, 3)), ("Uf", (1, 5)), ("Wb", (2, 7)), ("cf", (4,)), ("E", (int(x[0, 0]), 1))):
        q = {a: b.copy() for a, b in p32.items()}
        eps = 1e-2
        q[k][at] += eps
        up = tagger.gradients(q, x, n, y)[0]
        q[k][at] -= 2 * eps
        down = tagger.gradients(q, x, n, y)[0]
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-2 * max(1, abs(g[k][at])), k


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(2)
    e, a = rng.standard_normal((4, 1, 3)), rng.standard_normal((3, 3))
    best = max(itertools.product(range(3), repeat=4), key=lambda s: sum(e[i, 0, t] for i, t in enumerate(s)) + sum(a[s[i], s[i + 1]] for i in range(3)))
    assert tuple(tagger.viterbi(e, a)[0]) == best


TEXT = "You can reach Ines Falduvar at 010-0001-2862. Mail goes to ines.falduvar4681@mail.example, please.\nNational insurance: QQ 70 55 67 C. Send it to 64 Quennick Lane, Norwold. Version 10.0.7465 is out. Invoice 2025-5239-88 is open."


def test_personal_data(spark):
    rows = [(1, TEXT, "k"), (2, None, "k"), (3, "", "k"), (4, "The office moved the list.", "k"), (5, TEXT, "k"), (6, "새 주소는 온빛시 은하수대로 159길 4, 843호입니다. 박다솔님 연락처는 +82 10-0001-0013입니다.", "k"), (7, "Dr. Orla Drenthrell", "k"), (8, "x " * 50_000 + TEXT, "k")]
    df = spark.createDataFrame(rows, "record_id long, body string, kind string")
    got = {}
    for r in personal.find(df, "record_id", "body").collect():
        got.setdefault(r.record_id, set()).add((r.start_char, r.kind))
    want = {(TEXT.index(s), k) for s, k in (("Ines Fal", "person_name"), ("010-0001", "phone"), ("ines.fal", "email"), ("QQ 70", "national_id"), ("64 Quen", "street_address"))}
    assert got[1] == got[5] == want and not {2, 3, 4} & set(got)
    assert got[8] == {(s + 100_000, k) for s, k in want}
    assert {k for _, k in got[6]} == {"street_address", "person_name", "phone"} and got[7] == {(4, "person_name")}
    clean = {r.record_id: r.text for r in personal.redacted(df, "record_id", "body").collect()}
    assert clean[1].startswith("You can reach [PERSON_NAME] at [PHONE]. Mail goes to [EMAIL], please.\nNational insurance: [NATIONAL_ID]. Send it to [STREET_ADDRESS]. Version")
    assert clean[2] is None and clean[3] == "" and clean[4] == rows[3][1]
    assert personal.find(df.limit(0), "record_id", "body").count() == 0


def test_no_neighbour_hides_an_unknown_word():
    screen = personal.load()[1]
    for text in ("rescheduled the\n\n> > > Corwin,", "order? The\n\n>\n>\n> Nolan,", "as Corwin", "from Nolan Sorduvar", "Corwin second"):
        at = next(text.index(w) for w in ("Corwin", "Nolan") if w in text)
        assert any(s <= at < e for s, e in personal.screened(text, screen)), text


def test_windows_cover_a_region_once():
    for n in (1, 96, 97, 152, 153, 400, 1001):
        w = personal.windows(7, 7 + n)
        assert all(e - s <= personal.WINDOW and s <= f <= z <= e for s, e, f, z in w)
        assert [w[0][2], *[z for *_, z in w]] == [*[f for _, _, f, _ in w], 7 + n]


def test_joint_decoding_is_the_viterbi_path_of_the_whole_region():
    p, screen = personal.load()
    texts = ["please ask flora linquist to call 010-0001-0003 before " * 6, "Orla Drenthrell, 64 Quenby Road. " * 9]
    regions = [tagger.encode(t) for t in texts]
    parts = [[(tagger.encode(t[a:b]), f - a, z - a) for a, b, f, z in personal.windows(0, len(t))] for t in texts]
    e = [np.concatenate([personal._scored(p, [c.tobytes()])[0][f:z] for c, f, z in part]) for part in parts]
    ends = np.cumsum([len(r) for r in regions])
    tags = personal._decoded(p, np.concatenate(e), ends)
    for one, hi in zip(e, ends):
        assert tags[hi - len(one) : hi].tolist() == tagger.viterbi(one[:, None, :], p["A"])[0].tolist()


def test_names_in_lower_case():
    """They open windows, and the network finds most, not all of them."""
    p, screen = personal.load()
    said = ["ask {}, please", "Mit {} gesprochen und notiert.", "Thanks, {}", "> {} wrote on Monday:", "Please write to {} about it.", "{} will bring the list."]
    names = ["tovin norfenko", "flora linquist", "orla drenthrell", "mira norfenko"]
    hits = 0
    for t in said:
        for n in names:
            text = t.format(n)
            at = text.index(n)
            assert any(s <= at and at + len(n) <= e for s, e in personal.screened(text, screen))
            hits += any(s <= at < e and k == "person_name" for s, e, k in personal.tag_batch(p, [text], screen)[0])
    assert hits >= 0.7 * len(said) * len(names), hits


def test_every_character_goes_through_the_network(monkeypatch):
    """Also of texts that hold nothing but words of the vocabulary; groups of texts and windows leave nothing out."""
    p, screen = personal.load()
    scored, plain = [], personal._scored
    monkeypatch.setattr(personal, "_scored", lambda p, data: scored.extend(data) or plain(p, data))
    monkeypatch.setattr(personal, "AT_ONCE", 3000, raising=False)
    text = " ".join(sorted(screen.common)[:400])
    texts = ["The office moved the list.", "", text, "list", text[:2000], text[1:], "ok", ""]
    assert personal.screened(text, screen) == [(0, len(text))] and len(personal.tag_batch(p, texts, screen)) == len(texts)
    for t in filter(None, texts):
        code, seen = tagger.encode(t), np.zeros(len(t), bool)
        for a, b, first, last in personal.windows(0, len(t)):
            assert code[a:b].tobytes() in scored
            assert not seen[first:last].any()
            seen[first:last] = True
        assert seen.all()
    scored.clear()
    personal.tag_batch(p, ["code 1234 sent", "code 9876 sent"], screen)
    assert len(scored) == 1  # equal but for their digits


def test_what_the_viterbi_pass_leaves_out_changes_nothing():
    p, rng = personal.load()[0], np.random.default_rng(4)
    left_out = 0
    for a in [p["A"], *(rng.normal(0, 3, p["A"].shape).astype(np.float32) for _ in range(4))]:
        for _ in range(40):
            ends = np.cumsum(rng.integers(1, 150, 12))
            e = rng.normal(0, 3, (ends[-1], len(a))).astype(np.float32)
            e[:, 0] += np.repeat(rng.choice([2, 9, 16], len(e) // 9 + 1), 9)[: len(e)]
            tags = personal._decoded({"A": a}, e, ends)
            assert tags.tolist() == np.concatenate([tagger.viterbi(x[:, None, :], a)[0] for x in np.split(e, ends[:-1])]).tolist()
            left_out += personal.reach(a) is not None
    assert left_out >= 40
    assert personal.reach(np.where(np.eye(len(a)) > 0, 50, 0)) is not None and personal.reach(np.pad(np.full((10, 10), 9.0), (1, 0))) is None


def test_only_characters_that_are_not_certain_go_through_the_viterbi_pass(monkeypatch):
    p, screen = personal.load()
    taken, plain = [], tagger.paths
    monkeypatch.setattr(tagger, "paths", lambda e, a, starts, sizes: taken.append(int(sizes.sum())) or plain(e, a, starts, sizes))
    texts = [f"{k} The office moved the list to Monday, so please send the notes before noon. Call 010-0001-0003 or ask Flora Linquist. " * k for k in (1, 4, 60)]
    for t in texts:
        taken.clear()
        found = personal._tagged(p, [t])[0]
        parts = [(personal._scored(p, [tagger.encode(t[a:b]).tobytes()])[0], f - a, z - a) for a, b, f, z in personal.windows(0, len(t))]
        whole = np.concatenate([e[f:z] for e, f, z in parts])
        assert found == personal.spans_of(tagger.viterbi(whole[:, None, :], p["A"])[0]) and found
        assert sum(taken) < 0.6 * len(t), (sum(taken), len(t))


def test_the_best_path_is_o_wherever_that_is_certain():
    p, rng = personal.load()[0], np.random.default_rng(5)
    seen = [0, 0]
    for trained in (True, False):
        for k in range(60):
            a = p["A"] if trained else rng.normal(0, 2, p["A"].shape).astype(np.float32)
            ends = np.cumsum(rng.integers(1, 400, 10))
            e = rng.normal(0, 2, (ends[-1], len(a))).astype(np.float32)
            e[:, 0] += np.repeat(rng.choice([-1, 3, 7, 12], len(e) // 6 + 1), 6)[: len(e)]
            fresh = np.zeros(len(e), bool)
            fresh[np.r_[0, ends[:-1]]] = True
            sure = personal.certain(e, a, fresh)
            best = np.concatenate([tagger.viterbi(x[:, None, :], a)[0] for x in np.split(e, ends[:-1])])
            assert not best[sure].any()
            seen[trained] += int(sure.sum())
    assert min(seen) > 5000, seen


def test_rows_of_different_lengths_go_through_the_network_side_by_side():
    p, rng = personal.load()[0], np.random.default_rng(6)
    lengths = np.array([5, 40, 1, 17, 40, 33])
    x = rng.integers(0, tagger.SYMBOLS, (len(lengths), 40)).astype(np.int16)
    for order in (np.arange(6), np.argsort(-lengths), np.argsort(lengths)):
        got = tagger.emissions(p, x[order], lengths[order], np.full(10**5, 7, np.float32))
        for r, k in enumerate(order):
            n, one = lengths[k], x[k : k + 1, : lengths[k]]
            f = tagger._direction(one.T, p["E"] @ p["Wf"] + p["cf"], p["Uf"])[:, 0]
            b = tagger._direction(one[:, ::-1].T, p["E"] @ p["Wb"] + p["cb"], p["Ub"])[::-1, 0]
            assert np.allclose(got[:n, r], np.concatenate([f, b], axis=1) @ p["V"] + p["d"], atol=1e-3)
            assert (got[n:, r, 0] == 0).all() and (got[n:, r, 1:] == -30).all()


def test_runs_of_tags_end_with_their_text():
    tags = np.array([0, 1, 2, 2, 4, 4, 3, 3, 0, 2, 2, 10, 10])
    assert personal.spans_of(tags) == [(1, 4, 0), (4, 6, 1), (6, 7, 1), (7, 8, 1), (9, 11, 0), (11, 13, 4)]
    assert personal.spans_of(tags, np.array([3, 12, 13])) == [(1, 3, 0), (3, 4, 0), (4, 6, 1), (6, 7, 1), (7, 8, 1), (9, 11, 0), (11, 12, 4), (12, 13, 4)]
    assert personal.spans_of(np.zeros(0, np.int8)) == [] and personal.spans_of(np.zeros(3, np.int8)) == []


def test_inference_by_exp_is_the_network():
    p = personal.load()[0]
    x = np.random.default_rng(2).integers(0, tagger.SYMBOLS, (40, 7))
    table = p["E"] @ p["Wf"] + p["cf"]
    assert np.allclose(tagger._states(x, table, p["Uf"]), tagger._direction(x, table, p["Uf"]), atol=1e-4)
    assert np.isfinite(tagger._states(x, 1000 * table, p["Uf"])).all()


def test_min_cost_flow():
    arcs = [("s", "a", 3, 0), ("s", "a", 3, 1), ("a", "t", 5, 0), ("s", "b", 2, 5), ("b", "t", 9, 0)]
    total, flow, _ = mixing.min_cost_flow(arcs, "s", "t")
    assert total == 7 and [flow[i] for i in range(5)] == [3, 2, 5, 2, 2]
    got = mixing.flows({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1})
    total = sum(got.values())
    assert total == 220 and sum(v for (p, s), v in got.items() if s == "a") == 110


def test_the_largest_total_against_bisection():
    rng = np.random.default_rng(9)
    for _ in range(30):
        names = "abcde"[: rng.integers(1, 6)]
        tokens = {tuple(sorted(rng.choice(list(names), rng.integers(1, len(names) + 1), replace=False).tolist())): int(rng.integers(1, 900)) for _ in range(6)}
        alive = sorted({s for p in tokens for s in p})
        weights = rng.random(len(alive)) + 0.05
        targets, repeats = dict(zip(alive, weights / weights.sum())), {s: int(rng.integers(1, 4)) for s in alive}

        def fits(t):
            q = {s: int(t * w) for s, w in targets.items()}
            return mixing.min_cost_flow(mixing._network(tokens, q, repeats), "in", "out")[0] == sum(q.values())

        drawn = sum(mixing.flows(tokens, targets, repeats).values())
        lo, hi = 0, 100_000
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if fits(mid) else (lo, mid)
        assert abs(drawn - sum(int(lo * w) for w in targets.values())) <= 2 * len(alive) + lo * 1e-9


def test_tokens_of_whole_texts(monkeypatch):
    import base64
    import random
    import re

    import tiktoken

    with open(mixing.TOKENIZER, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    e = tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert mixing.count_tokens(e, "a" + " " * 300_000 + "b") == 300_001  # the pattern alone can't take it
    monkeypatch.setattr(mixing, "BLANKS", re.compile(r"\s{3,}"))
    pick = random.Random(2)
    for _ in range(500):
        text = "".join(pick.choice("ab  \n\t.1'") for _ in range(pick.randint(0, 60)))
        assert mixing.count_tokens(e, text) == len(e.encode_ordinary(text))


def test_mixing(spark):
    pytest.importorskip("tiktoken")
    rows = [(i, "a", f"text number {i} of the first source") for i in range(300)] + [(1000 + i, "b", f"second source text {i}") for i in range(20)] + [(2000, "b", "shared words"), (2001, "a", "shared words"), (2001, "a", "shared words"), (2002, "a", None), (2003, None, "x"), (2004, "c", ""), (2005, "zz", "never drawn")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, None)], "source string, target_share double, max_repeats int")
    drawn, wanted = mixing.draw(docs, targets)
    out = drawn.collect()
    assert all(1 <= r.repeats <= {"a": 1, "b": 3}[r.source] for r in out) and len({(r.doc_id, r.source) for r in out}) == len(out)
    got = {r.source: r for r in mixing.shares(drawn, wanted).collect()}
    assert abs(got["a"].actual_share - 5 / 9) < 0.03 and abs(got["b"].actual_share - 4 / 9) < 0.03 and got["c"].actual_share == 0
    assert sorted(r.doc_id for r in mixing.draw(docs, targets)[0].collect()) == sorted(r.doc_id for r in out), "seeded"
    assert mixing.draw(docs.limit(0), targets)[0].count() == 0 and mixing.draw(docs, targets.limit(0))[0].count() == 0


def test_sentences():
    text = "# Head\n\nHi Bo,\n\nOne thing is here. Two are\nthere.\n\n- [9:30] tapha: a bullet one.\n[00:10] Speaker 2: said it.\n\nKind regards\nAnn"
    assert subjects.sentences(text) == ["One thing is here.", "Two are there.", "a bullet one.", "said it."] and subjects.sentences(None) == []


def test_subjects(spark):
    topic = {"food": ["soup", "oven", "recipe"], "law": ["court", "judge", "verdict"]}
    rows, labels = [], []
    for i in range(60):
        s = ("food", "law")[i % 2]
        rows.append((i, f"The {topic[s][i % 3]} came back twice. We moved the {topic[s][(i + 1) % 3]} again. They kept the list.", s))
        if i < 40:
            labels += [(i, f" {s.upper()} ", 1), (i, s, 2), (i, None, 3), (i, "bogus", 4)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "They kept the list. All was well.", "x"), (103, "The soup was cold. The judge left us. No more to say.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    lab = spark.createDataFrame([*labels, (102, "none", 1)], "doc_id long, subject_label string, rater int")
    areas = spark.createDataFrame([(1, "food", ""), (2, "law", "")], "subject_id int, subject string, description string")
    got = {}
    for r in subjects.subjects(docs, lab, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert all(got[i] == {("food", "law")[i % 2]} for i in range(60)) and got[103] == {"food", "law"} and not {100, 101, 102} & set(got)
    assert subjects.subjects(docs, lab.limit(0), areas).count() == 0 and subjects.subjects(docs.limit(0), lab, areas).count() == 0


def test_patterns_against_counting(spark):
    import itertools
    import random
    from collections import Counter

    pick = random.Random(4)
    words = "abcdefgh"
    rows = [(sorted(pick.sample(words, pick.randint(0, 5))), sorted(pick.sample(["=x", "=y"], pick.randint(0, 2)))) for _ in range(200)]
    rows += [([f"w{k:02}" for k in range(30)], ["=x"])] * 7  # 30 words together would be a billion sets
    want: Counter = Counter()
    for ws, heads in rows:
        for k in (2, 3):
            for c in itertools.combinations(ws, k):
                for h in ("", *heads):
                    want[(tuple(sorted(c)), h)] += 1
    got = {(tuple(r.words), r.label): r.n for r in subjects.patterns(spark.createDataFrame(rows, "words array<string>, labels array<string>"), 6, 3).collect()}
    assert got == {k: n for k, n in want.items() if n >= 6}
    assert subjects.patterns(spark.createDataFrame([], "words array<string>, labels array<string>"), 6, 3).count() == 0
