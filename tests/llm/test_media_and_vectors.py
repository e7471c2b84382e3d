"""Media files, personal data and nearest neighbours."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest

from cragline.llm import ann, avi, pii


def payload(text):
    raw = (text or "").encode()
    return raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")


def test_media_round_trip(spark):
    texts = [None, "", "a", "x" * 576, "é" * 1000, "".join(map(chr, range(1, 2000))), "b" * 100_000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "a", "c")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in avi.media_table(df).collect()}
    for i, t in enumerate(texts):
        p = payload(t)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[None].media_sha256 == got[2].media_sha256 and got[0].media_sha256 == got[1].media_sha256
    assert avi.media_table(df.limit(0)).count() == 0


def test_pictures_are_ordinary_jpeg():
    x = np.random.default_rng(1).integers(0, 256, 576, dtype=np.uint8)
    frame = avi.encode_frames(x)[0]
    assert (avi.decode_lossless(avi.parse_picture(frame)).ravel() == x).all() and (avi.decode_frame(frame).ravel() == x).all()
    with pytest.raises(ValueError):
        avi.decode_frame(b"nothing")


def baseline(image, restart=0):
    """A baseline picture of a grey image, with quantisation by 1 and the standard tables."""
    c = avi.cosines()
    tables = {k: {v: (n, code) for (n, code), v in avi.codes(*map(bytes.fromhex, avi.STANDARD[k, 0])).items()} for k in (0, 1)}
    bits, last, runs = "", 0, []
    put = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    sym = lambda k, s: format(tables[k][s][1], f"0{tables[k][s][0]}b")
    blocks = [(y, x) for y in range(0, image.shape[0], 8) for x in range(0, image.shape[1], 8)]
    for n, (y, x) in enumerate(blocks):
        if restart and n and n % restart == 0:
            runs, bits, last = [*runs, bits], "", 0
        z = np.rint(c.T @ (image[y : y + 8, x : x + 8] - 128.0) @ c).astype(int).ravel()[avi.ZIGZAG]
        bits += sym(0, int(abs(z[0] - last)).bit_length()) + put(int(z[0] - last))
        last, zeros = z[0], 0
        end = max([0, *np.flatnonzero(z)])
        for v in z[1 : end + 1]:
            if v == 0:
                zeros += 1
                continue
            bits += sym(1, 0xF0) * (zeros // 16) + sym(1, zeros % 16 << 4 | int(abs(v)).bit_length()) + put(int(v))
            zeros = 0
        bits += sym(1, 0) if end < 63 else ""
    runs.append(bits)
    data = b""
    for i, b in enumerate(runs):
        b += "1" * (-len(b) % 8)
        data += int(b, 2).to_bytes(len(b) // 8, "big").replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + i % 8]) if i < len(runs) - 1 else b"")
    sof = avi.marker(0xC0, struct.pack(">BHHBBBB", 8, *image.shape, 1, 1, 0x11, 0))
    dri = avi.marker(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + avi.marker(0xDB, b"\x00" + b"\x01" * 64) + sof + dri + avi.marker(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_baseline_pictures(restart):
    y, x = np.mgrid[0:24, 0:32]
    image = ((x * 7 + y * y) % 256).astype(np.uint8)
    got = avi.decode_frame(baseline(image, restart)).astype(int)
    assert got.shape == image.shape and np.abs(got - image).max() <= 2


def test_shots_and_files_without_index(spark):
    grey = lambda v, n: [np.full(576, v, np.uint8)] * n
    frames = avi.encode_frames(np.concatenate([*grey(20, 10), *grey(200, 15), *grey(90, 5)]))
    data = avi.write_avi(frames)
    cut = data[: data.rindex(b"idx1")]
    for d in (data, cut):
        assert avi.parse_avi(d).frames == frames and avi.parse_avi(d).rate == avi.RATE
    rows = avi.shot_rows(spark.createDataFrame([(1, bytearray(data), 5), (2, None, 6)], "id int, media binary, shot int")).orderBy("start_s").collect()
    assert [(r.id, r.shot, r.first_frame, r.end_frame, r.brightness) for r in rows] == [(1, 0, 0, 10, 20.0), (1, 1, 10, 25, 200.0), (1, 2, 25, 30, 90.0)] and rows[1].start_s == 0.4
    assert avi.clips(avi.parse_avi(avi.write_avi([])), []) == []
    with pytest.raises(ValueError):
        avi.parse_avi(b"RIFFxxxx")


# ---------------------------------------------------------------- personal data


def plainly(t):
    d = lambda m: sum(c in "0123456789" for c in m.group())
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= d(m) <= 19 and pii.luhn(re.sub(r"[ -]", "", m.group()))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= d(m) <= 15])


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    for _ in range(20000):
        s = "".join(rng.choice("ab@@..112 3-+()%_\né") for _ in range(rng.randrange(30)))
        assert plainly(s) == pii.base_spans(s), s


def test_gradients():
    m = pii.Tagger(1)
    ids, gold = pii.as_arrays(pii.made_samples(3, 5))
    ids, gold = ids[:, :30], gold[:, :30]
    _, g = m.loss_and_gradient(ids, gold)
    for name, at in [("xf", (2, 7)), ("hb", (3, 50)), ("cf", (5,)), ("out", (4, 0)), ("step", (0, 1)), ("start", (0,)), ("embed", (int(ids[0, 0]), 2))]:
        kept, side = m.p[name][at], []
        for e in (1e-5, -1e-5):
            m.p[name][at] = kept + e
            side.append(m.loss_and_gradient(ids, gold)[0])
        m.p[name][at] = kept
        assert np.isclose((side[0] - side[1]) / 2e-5, g[name][at], rtol=1e-3, atol=1e-4), name


@pytest.mark.parametrize("fast", [True, False])
def test_quick_scores_are_those_of_training(monkeypatch, fast):
    """Windows of many lengths over several tiles; without tanh where numpy would take it value by value."""
    m = pii.Tagger(2)
    rng = np.random.default_rng(4)
    lengths = -np.sort(-np.r_[rng.integers(1, 40, 598), 40, 40])
    ids = np.where(np.arange(40) < lengths[:, None], rng.integers(1, pii.SYMBOLS, (600, 40)), 0)
    want = m.scores(ids).transpose(0, 2, 1)
    monkeypatch.setattr(pii, "fast_tanh", lambda: fast)
    if not fast:
        monkeypatch.setattr(np, "tanh", None)
    got = m.quick_scores(ids, lengths)
    live = np.broadcast_to((ids.T > 0)[:, None], want.shape)
    assert got.shape == want.shape and np.allclose(got[live], want[live], atol=1e-6)


def test_the_network_finds_what_patterns_miss(spark):
    m = pii.default_tagger()
    test = pii.made_samples(300, 77)
    tags = m.decode(pii.as_arrays(test)[0])
    hit = wrong = missed = 0
    for (text, spans), t in zip(test, tags, strict=True):
        got = set(pii.read_spans(t[: len(text)].tolist(), 0))
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert 2 * hit / (2 * hit + wrong + missed) > 0.9
    filler = "and the other thing " * 30
    texts = ["write to (555) 123-4567 now", filler + "mail joe@x.org or anna.lee@mail.example.com" + filler, filler, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df, m).collect()}
    assert got[1].n_email == 2 and got[1].base_sha256 == hashlib.sha256(pii.as_text(pii.base_spans(texts[1])).encode()).hexdigest()
    assert pii.as_text(pii.base_spans(texts[1])) in got[1].spans
    assert all(got[i].spans == "" and got[i].n_added == 0 for i in (2, 3, 4))
    assert pii.find(df.limit(0), m).count() == 0


def test_long_and_spelt_out_addresses_are_read_whole(spark):
    m, filler = pii.default_tagger(), "the other thing and that was all " * 4
    known = ["alexandra.featherstonehaugh at mail dot com", "john [at] long-department-name-of-the-institute.example.com", "maximiliana.oberschlesinger-weissmann (at) mail (dot) com", "anna.lee at mail.example.com", "name at mail.example.com", "jane AT mailbox.org", "jane -at- mailbox -dot- org", "jane_at_mailbox_dot_org"]
    texts = [*(filler + x + " " + filler for x in known), *known, (filler + "we met at home. Then we left. ") * 3]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    whole = [f"email:{t.index(x)}:{t.index(x) + len(x)}" in got[i].split(",") for i, (t, x) in enumerate(zip(texts, known * 2))]
    # a model that learned: nearly all within a text, most without anything around them
    assert sum(whole[: len(known)]) >= len(known) - 1 and sum(whole[len(known) :]) >= len(known) // 2, (whole, got)
    assert got[len(texts) - 1] == ""


def test_best_paths_are_those_of_plain_decoding():
    m = pii.default_tagger()
    samples = [x for x in pii.made_samples(80, 91) if x[0]]
    ids = pii.as_arrays(samples)[0]
    got, (step, start) = m.decode(ids), m.steps()
    assert (got > 0).any()
    for row, tags in zip(ids, got, strict=True):
        n = int((row > 0).sum())
        s = m.scores(row[None, :n])[:, 0].astype(float)
        v, back = s[0] + start, []
        for t in range(1, n):
            x = v[:, None] + step
            back.append(x.argmax(0))
            v = x.max(0) + s[t]
        worth = s[0][tags[0]] + start[tags[0]] + sum(step[a, b] + s[t][b] for t, a, b in zip(range(1, n), tags, tags[1:n]))
        assert np.isclose(worth, v.max(), atol=1e-2) and not tags[n:].any()


def test_joined_windows_are_one_long_window(monkeypatch):
    """Spans read window by window, against the same text decoded as one window."""
    m = pii.default_tagger()
    texts = [" and some more words here ".join(x for x, _ in pii.made_samples(30, 200 + i)) for i in range(20)]
    got = pii.added_spans(texts, [[] for _ in texts], m)
    assert all(len(t) > 3 * pii.WINDOW for t in texts)
    monkeypatch.setattr(pii, "WINDOW", max(map(len, texts)))
    one = pii.added_spans(texts, [[] for _ in texts], m)
    same = sum(len(set(a) & set(b)) for a, b in zip(got, one, strict=True))
    assert sum(map(len, one)) > 200 and same >= 0.97 * max(sum(map(len, got)), sum(map(len, one)))


@pytest.mark.parametrize("lengths", [[0], [1, 0, 447, 448, 511, 512, 513, 960, 961, 3000], []])
def test_windows_cover_every_place_once(lengths):
    class Marks:
        def decode(self, ids):
            return (ids > 0).astype(np.int8)

    tags, begins = pii.tagged(["x" * n for n in lengths], Marks())
    assert tags.all() and len(tags) == sum(lengths) and len(begins) == len(lengths)
    for n in lengths:
        w = pii.windows(n)
        assert not len(w) if n == 0 else w[-1] < n <= w[-1] + pii.WINDOW and (np.diff(w) == pii.STEP).all()


def test_very_long_texts_and_parts(spark):
    """A part of very many digits, and a text of 10 million characters with very many spans, in time that grows with it."""
    m = pii.default_tagger()
    digits = "1.2.3." + "0" * 5000 + "1"
    assert pii.base_spans(digits) == [(0, 1, len(digits))] and not pii.base_spans("1.2.3." + "7" * 5000)
    unit = "call +1 555 123 4567 or (555) 123-4567, write a.b@c.org or mia (at) mail (dot) com. "
    took = []
    for n in (1000, 8000):
        text = unit * n
        base = pii.base_spans(text)
        began = time.process_time()
        found = pii.added_spans([text], [base], m)[0]
        took.append(time.process_time() - began)
        assert len(base) == 2 * n and len(found) >= 1.9 * n and text[found[-1][0] : found[-1][2]]
    assert took[1] < 16 * took[0]
    rows = [(1, unit * 120_000), (None, unit), (None, unit), (2, digits)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()
    assert sorted(r.n_email for r in got) == [0, 1, 1, 120_000] and got[1] == got[2]


# ---------------------------------------------------------------- neighbours


def all_pairs(rows, top=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-float(v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w))), i) for i, w in good if i != q and len(w) == len(v))[:top]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def neighbours(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbour_table(df).orderBy("query_id", "rank").collect()]


def test_recall(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(3000, 32)))]
    want, got = all_pairs(rows), neighbours(spark, rows)
    assert len(got) == len(want) and len({x[:1] + x[2:3] for x in got} & {x[:1] + x[2:3] for x in want}) >= 0.9 * len(want)


def test_recall_when_few_probes_are_allowed(spark, monkeypatch):
    """As on a large table: the wanted number of projections is too many for the probes, so fewer are taken; blocks on both sides."""
    monkeypatch.setattr(ann, "PROBES", 60)
    monkeypatch.setattr(ann, "hashes_for", lambda n: 8)
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "ASKED", 7)
    rng = np.random.default_rng(12)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)))]
    sample = ann.unit(np.array([v for _, v in rows]))
    spread, wanted = ann.aimed_distance(sample, 5), 1 - 0.015 ** (1 / ann.TABLES)
    k = ann.affordable(8, sample, spread, wanted)
    assert 1 <= k < 8 and ann.affordable(k, sample, spread, wanted) == k
    want, got = all_pairs(rows), neighbours(spark, rows)
    assert len(got) == len(want) and len({x[:1] + x[2:3] for x in got} & {x[:1] + x[2:3] for x in want}) >= 0.9 * len(want)


def test_queries_that_meet_the_cap_are_compared_with_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(500, 64)))]
    # many projections kept although they are too many, a sample of few of the rows, and many blocks
    monkeypatch.setattr(ann, "affordable", lambda k, *_: 8)
    monkeypatch.setattr(ann, "SAMPLE", 50)
    monkeypatch.setattr(ann, "BLOCK", 40)
    found, reached = ann.probes(ann.Hashing(64, 8).places(ann.unit(np.array([rows[0][1]])))[0, 0], 1.14, 0.65)
    assert len(found) == ann.PROBES and reached < 0.65
    got, want = neighbours(spark, rows), all_pairs(rows)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [3.0, 0.0]), (1, [0.5, 0.0]), (7, [0.0, 1.0]), (8, [-1.0, 0.0]), (9, None), (10, []), (11, [0.0, 0.0]), (12, [float("nan"), 1.0]), (13, [None, 1.0]), (14, [float("inf"), 1.0]), (None, [1.0, 0.0]), (15, [1.0, 2.0, 3.0]), (100, None)]
    got = neighbours(spark, rows)
    assert [x[:3] for x in got] == [x[:3] for x in all_pairs(rows)] and np.allclose([x[3] for x in got], [x[3] for x in all_pairs(rows)])
    assert neighbours(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])]) == [(0, 1, 1, pytest.approx(0.8))]
    assert neighbours(spark, []) == []


def test_a_hot_vector(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).astype(np.float32).tolist()) for i in range(900)]
    got = neighbours(spark, rows)
    want = all_pairs(rows)
    hot = [x[:3] for x in want if x[0] % 150 == 0]
    assert [x[:3] for x in got if x[0] % 150 == 0] == hot


def test_probes_come_in_falling_order():
    places = np.array([0.2, 3.7, -1.4])
    found, total = ann.probes(places, 0.8, 0.999)
    chance = lambda b: np.prod([dict((s, c) for c, s in ann.slot_chances(p, 0.8))[s] for p, s in zip(places, b, strict=True)])
    values = [chance(b) for b in found]
    assert len(set(found)) == len(found) and total >= 0.999 and all(a >= b - 1e-12 for a, b in zip(values, values[1:])) and np.isclose(sum(values), total)
