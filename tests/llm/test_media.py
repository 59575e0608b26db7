"""Fingerprints of texts and of audio, and archives."""

import hashlib
import io
import random
import zipfile

import numpy as np
import pytest

from weftline.llm import chroma, edit_fingerprint as E, wacz


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_edited_is_what_brute_force_gives(spark):
    r = random.Random(0)
    texts = [prose(r, r.choice([1, 3, 40, 200])) for _ in range(60)] + ["", "", "é😀x", None, "y" * 30000]
    rows = [(3 * i + 5, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, fingerprint string")
    got = {x["doc_id"]: x for x in E.edited(df).collect()}
    order = [(i, t or "") for i, t in rows]
    for (i, t), (_, o) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        changed = t[: len(t) - h] + o[:h]
        a, b, c = E.fingerprints([t, changed, o])
        x = got[i]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (x["fingerprint"], x["edited_fingerprint"]) == tuple(E._string(np.stack([a, b])))
        assert x["near_edited"] == pytest.approx(E.likeness_of(a[None], b[None])[0]) and x["near_next"] == pytest.approx(E.likeness_of(a[None], c[None])[0])


def test_edited_edge_tables(spark):
    one = E.edited(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert E.edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "n"), (2**60 + 1, "aa"), (2**60 + 1, "aa"), (2**60 + 1, "bb")]
    got = E.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] or 0 for x in got) == [0, 2**60 + 1, 2**60 + 1, 2**60 + 1]


def test_likeness_follows_edit_distance():
    r = random.Random(1)
    base = prose(r, 400)
    prints = [E.fingerprints([base])[0]]
    for k in (5, 50, 500):
        t = list(base)
        for _ in range(k):
            p = r.randrange(len(t))
            t[p : p + 1] = r.choice([[], ["z"], [t[p], "q"]])
        prints.append(E.fingerprints(["".join(t)])[0])
    prints.append(E.fingerprints([prose(r, 400)])[0])
    likes = [E.likeness_of(prints[0][None], p[None])[0] for p in prints]
    assert likes[0] == 1 and likes[1] > likes[2] > likes[3] >= likes[4] - 0.1 and likes[1] > 0.8 and likes[4] < 0.25


def test_plain_walk_equals_vector_walk(monkeypatch):
    r = random.Random(2)
    texts = [prose(r, n) for n in (1, 20, 90, 3)] * 20
    a = E.fingerprints(texts)
    monkeypatch.setattr(E, "FEW", 0)
    assert np.array_equal(a, E.fingerprints(texts))


def test_near_classes(spark):
    r = random.Random(3)
    base = prose(r, 300)
    rows = [(0, base), (1, base), (2, base[:500] + "x" + base[501:]), (3, prose(r, 300)), (4, None)]
    got = {x["doc_id"]: x["near_class"] for x in E.near_classes(E.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[0] == got[1] == got[2] != got[3]


@pytest.mark.parametrize("leaf", [3, 2048])
def test_near_classes_are_those_of_brute_force(spark, leaf):
    """All pairs of fingerprints, whether bands are crowded or not; the walk itself is checked step by step above."""
    r = random.Random(2)
    rows = []
    for _ in range(25):
        t = "".join(r.choice("abcdefghij ") for _ in range(r.choice([40, 300, 900])))
        rows.append(t)
        for _ in range(r.randrange(5)):
            k = r.randrange(len(t))
            t = t[:k] + r.choice("abcxyz") + t[k + r.randrange(2) :]
            rows.append(t)
    rows += ["", "", None, rows[0]]
    df = E.fingerprint(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "1 as `x.y`", "2 as near_class"))
    got = E.near_classes(df, 0.8, leaf=leaf)
    assert got.columns == ["doc_id", "text", "x.y", "fingerprint", "near_class", "near_links"]
    got = {x["doc_id"]: (x["near_class"], x["near_links"]) for x in got.collect()}
    digits = E.fingerprints(rows)
    parent, linked = list(range(len(rows))), set()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (digits[i] == digits[j]).all()
            if same or (rows[i] and rows[j] and E.likeness_of(digits[i : i + 1], digits[j : j + 1])[0] >= 0.8 - 1e-9):
                parent[root(i)] = root(j)
                linked |= set() if same else {i, j}
    assert {i for i, x in got.items() if x[1]} == linked
    classes = {}
    for i, (c, _) in got.items():
        classes.setdefault(c, set()).add(root(i))
    assert all(len(x) == 1 for x in classes.values()) and len(classes) == len({root(i) for i in range(len(rows))})


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_is_read_in_place(zip64):
    members = [("archive/a.bin", bytes(range(256)) * 10), ("indexes/é.txt", b""), ("x", b"PK\x05\x06 not the end")]
    data = b"".join(wacz.zip_bytes(members, zip64))
    assert [(i.filename, i.file_size) for i in zipfile.ZipFile(io.BytesIO(data)).infolist()] == [(n, len(d)) for n, d in members]
    z = wacz.ZipMembers(io.BytesIO(data), len(data))
    assert z.names() == [n for n, _ in members]
    for n, d in members:
        assert z.read(*z.locate(n)) == d


def test_foreign_zips():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("stored"), b"plain")
        z.writestr("packed", b"x" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a note with PK\x05\x06 in it"
    z = wacz.ZipMembers(out, len(out.getvalue()))
    assert z.read(*z.locate("stored")) == b"plain"
    with pytest.raises(ValueError, match="compressed"):
        z.locate("packed")
    for broken in (b"", b"PK", out.getvalue()[:40]):
        with pytest.raises(ValueError):
            wacz.ZipMembers(io.BytesIO(broken), len(broken))


def test_archives_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, None), (8, "http://c/ d", ""), (2, "http://e/", "é" * 9), (7, "u", "x\r\n\r\ny" * 50000), (3, "http://b/", "same"), (None, "n", "same"), (11, "r", "\u0000WARC/1.1\r\n")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, payload_bytes int")
    manifest = wacz.write(wacz.assign(df), f"file://{tmp_path}/w", roll_bytes=200)
    assert sum(x["records"] for x in manifest.collect()) == len(rows)
    got = wacz.read(manifest, payloads=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(h or "", i)
    for x in got:
        t = next((h or "") for i, _, h in rows if i == x["page_id"])
        assert (x["payload_bytes"], x["payload_digest"]) == (len(t.encode()), wacz.digest(t.encode()))
        lead = first[t] == x["page_id"]
        assert x["record_type"] == ("response" if lead else "revisit") and x["refers_to"] == (None if lead else first[t])
        assert x["payload"] == (t.encode() if lead else None)
    big = wacz.round_trip(df, f"file://{tmp_path}/m", min_bytes=5).where("page_id = 5").first()
    assert big["record_type"] == "response"
    assert wacz.round_trip(df.limit(0), f"file://{tmp_path}/z").count() == 0


def test_audio_alignment():
    r = np.random.default_rng(0)
    tune = [chroma.melody(r.normal(size=64).tolist()) for _ in range(4)]
    a, rate = chroma.pcm(tune[0])
    base = chroma.fingerprint(tune[0])
    noisy = chroma.fingerprint(chroma.wav(a + r.normal(scale=300, size=len(a)), rate))
    assert chroma.align(base, noisy)[0] == 0
    late = chroma.fingerprint(chroma.wav(np.concatenate([chroma.pcm(tune[1])[0][: 10 * chroma.HOP], a]), rate))
    offset, error = chroma.align(base, late)
    assert offset == 10 and error < 0.1
    assert chroma.align(base, chroma.fingerprint(tune[2])) is None
    for bad in (None, b"", b"RIFF", chroma.wav(np.zeros(10)), tune[3][:60]):
        assert len(chroma.fingerprint(bad)) == 0 and chroma.align(base, chroma.fingerprint(bad)) is None
    assert len(set(chroma.fingerprint(chroma.wav(np.zeros(60000))).tolist())) == 1


def test_recordings_of_other_rates_and_widths_align():
    """One tune at five rates, and in samples of 8, 24 and 32 bits."""
    import io
    import wave

    r = np.random.default_rng(4)
    notes = 220 * 2 ** (r.integers(0, 24, 60) / 12)

    def tune(rate, width=2):
        t = np.arange(int(0.2 * rate)) / rate
        x = np.concatenate([(np.sin(2 * np.pi * f * t) + 0.3 * np.sin(4 * np.pi * f * t)) * np.hanning(len(t)) for f in notes]) * 0.5
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(rate)
            whole = np.round(x * (2 ** (8 * width - 1) - 1)).astype("<i8")
            if width == 1:
                w.writeframes((whole + 128).astype(np.uint8).tobytes())
            else:
                w.writeframes(whole.view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
        return chroma.fingerprint(out.getvalue())

    base = tune(8000)
    for rate in (11025, 16000, 22050, 44100):
        other = tune(rate)
        assert abs(len(other) - len(base)) <= 1 and chroma.align(base, other)[0] == 0
    for width in (1, 3, 4):
        assert chroma.align(base, tune(8000, width))[0] == 0


def test_audio_search_is_brute_force(spark):
    r = np.random.default_rng(1)
    tunes = [r.normal(size=64) for _ in range(12)]
    clips = [chroma.melody(t.tolist()) for t in tunes]
    a = chroma.pcm(clips[0])[0]
    clips += [clips[0], chroma.wav(np.concatenate([chroma.pcm(clips[5])[0][: 8 * chroma.HOP], a])), None, chroma.wav(np.zeros(60000)), chroma.wav(np.zeros(60000)), clips[3][:90000]]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(clips)], "id long, media binary")
    got = {x["id"]: x for x in chroma.search(chroma.with_fingerprint(df), df["id"] % 5 == 0, "id").collect()}
    prints = [chroma.fingerprint(c) for c in clips]
    for i, p in enumerate(prints):
        hits = [j for j in range(0, len(clips), 5) if chroma.align(prints[j], p)]
        assert got[i]["n_links"] == len(hits), i
        assert got[i]["class_id"] == min(j for j, q in enumerate(prints) if np.array_equal(p, q)) and got[i]["frames"] == len(p)
    assert (got[13]["best_query"], got[13]["offset"]) == (0, 8)


def test_sonify_keeps_ids(spark):
    rows = [(2**60 + 1, [0.1, 0.5, -1.0]), (None, None), (3, []), (4, [1.0, 1.0])]
    got = chroma.sonify(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [x["vec_id"] for x in got] == [2**60 + 1, None, 3, 4] and all(x["media"][:4] == b"RIFF" for x in got)


def test_fingerprints_of_what_the_worker_plays(spark):
    """The same as of a column of recordings; and the query has no step in which the JVM holds recordings."""
    r = random.Random(6)
    vectors = [[r.random() for _ in range(64)] for _ in range(40)] + [None, [], [1.0] * 40, [None, float("nan"), 2.0] * 20]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    played = chroma.with_fingerprint(df, "embedding", chroma.melody)
    assert played.columns == ["vec_id", "print"]
    made = chroma.with_fingerprint(chroma.sonify(df).select("vec_id", "media"))
    assert sorted((x["vec_id"], bytes(x["print"])) for x in played.collect()) == sorted((x["vec_id"], bytes(x["print"])) for x in made.collect())
