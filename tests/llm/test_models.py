"""Language ID, quality, mixing: held-out accuracy, targets and edge rows."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import gam_quality, language_id, mixing

LETTERS = {"aa": "abcdefgh", "bb": "klmnopqr", "cc": "stuvwxéà"}


def speak(r, lang, n):
    return " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_language_held_out_accuracy_and_edges(spark):
    r = random.Random(0)
    rows = [(i, speak(r, lang := r.choice(list(LETTERS)), r.choice([2, 5, 80])), lang) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 3 <> 0"))
    assert model.languages == ("aa", "bb", "cc")
    got = language_id.predict(df.where("doc_id % 3 = 0").withColumn("score", F.lit("old")), model).collect()
    assert sum(x["lang"] == x["lang_pred"] for x in got) >= 0.98 * len(got)
    assert all(0 <= x["score"] <= 1 for x in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "ABC abc"), (None, "x" * 300000), (4, "ABC abc")], "doc_id long, text string")
    answers = collections.defaultdict(list)
    for x in language_id.predict(odd, model).collect():
        answers[x["doc_id"]].append((x["lang_pred"], x["score"]))
    assert answers[1] == answers[2] == answers[3] == [("und", 0.0)]
    assert answers[4][0] == answers[4][1] and answers[4][0][0] == "aa" and answers[None][0][0] == "cc"
    assert language_id.predict(odd.limit(0), model).count() == 0


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == () and language_id.predict(df, model).first()["lang_pred"] == "und"


def test_bundles_are_sums_of_bound_vectors():
    """The batched counts give what adding one vector per occurrence gives."""
    p = language_id.Profiler()
    text = "ab cab"
    ids = [0, *p.letter_ids(np.array([ord(c) for c in text], dtype=np.uint32)).tolist(), 0]
    want = np.zeros(language_id.DIM)
    for k in range(len(ids) - 2):
        if ids[k + 1]:
            want += np.roll(p.letters[ids[k]], 2).astype(int) * np.roll(p.letters[ids[k + 1]], 1) * p.letters[ids[k + 2]]
    got = p.vectors(["", text, "zz", None])
    assert np.array_equal(got[1], want) and not got[0].any() and not got[3].any()


def test_gam_learns_main_effects_and_interactions():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.3) | ((x[:, 1] > 0) == (x[:, 2] > 0))).astype(float)
    model = gam_quality.train(x[:3000], y[:3000])
    right = ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean()
    assert right > 0.95
    assert {frozenset(p[:2]) for p in model.pairs} >= {frozenset({1, 2})}


def test_gam_on_texts(spark):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["the", "river", "runs", "down", "slowly."]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY!!", "$$$", "NOW###", "click|"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(400)]
    described = gam_quality.describe(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    model = gam_quality.fit(described.where("doc_id < 300"), "quality")
    got = gam_quality.score(described, model).where("doc_id >= 300").collect()
    assert all(x["predicted"] == x["quality"] for x in got)
    odd = gam_quality.describe(spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200000), (4, "\n" * 5)], "doc_id long, text string"))
    assert all(0 <= x["score"] <= 1 for x in gam_quality.score(odd, model).collect())
    assert gam_quality.score(odd, gam_quality.Gam()).first()["score"] == 0.5
    assert gam_quality.score(odd.limit(0), model).count() == 0
    assert len(gam_quality.fit(described, "quality", most_rows=50).tables) == len(gam_quality.FEATURES)


def water(sources, share=1.5, cap=2.0):
    """Targets by resharing the excess round after round."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, open_, pool = {}, set(order), share * sum(sources.values())
    while open_:
        level = pool / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sources[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = cap * sources[s]
            pool -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", [0, 1])
def test_mix_meets_targets(spark, seed):
    r = random.Random(seed)
    names = [f"s{i}" for i in range(7)] + [None, "é"]
    rows = [(i, " ".join("w" * 3 for _ in range(int(r.lognormvariate(3, 1)))), names[0] if i % 3 == 0 else r.choice(names)) for i in range(900)]
    rows += [(1000, None, "s1"), (1001, "", "s2"), (1002, " \t\n", "s2"), (7, rows[7][1], rows[7][2]), (1003, " nbsp", "empty"), (1004, None, "void")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda x: (x["doc_id"], x["th"] or 0, x["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").replace(" ", "x").split())
    want, taken = water(sizes), collections.Counter()
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]]) and x["taken"] == x["copies"] * x["size"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 3), s
    copies = collections.Counter()
    for x in got:
        copies[x["doc_id"]] += x["copies"]
    spread = collections.Counter(x["doc_id"] for x in mixing.replicate(df).collect())
    assert spread == +copies


def test_rates_are_exponential_tilts(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 17)), "abc"[i % 3]) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        points = {x["size"]: x["rate"] for x in got if x["source"] == s and x["rate"] < 2}
        slopes = [np.log(v) / k for k, v in points.items()]
        assert not slopes or np.ptp(slopes) < 1e-6
        assert sum(x["rate"] * x["size"] for x in got if x["source"] == s) == pytest.approx(next(x["target"] for x in got if x["source"] == s), rel=1e-6)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.replicate(df).count() == 0


def test_large_bins_are_ranked_in_parts(spark, monkeypatch):
    """The parts of a bin give as many copies as the whole, and reruns agree."""
    rows = [(i, "one two three" if i % 2 else f"w{i} x", "a" if i % 3 else "b") for i in range(400)] + [(7, "one two three", "a")] * 3 + [(900 + i, None, "a") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = []
    for part in (50_000, 10, 10):
        monkeypatch.setattr(mixing, "PART", part)
        out = mixing.mix(df).collect()
        assert len(out) == len(rows)
        sums.append((sorted((x["source"], x["size"]) for x in out for _ in range(x["copies"])), sorted((x["doc_id"], x["copies"]) for x in out)))
    assert sums[0][0] == sums[1][0] and sums[1] == sums[2]


def test_clashing_column_names(spark):
    """Columns of any name come through the operators that carry their input."""
    from weftline.llm import edit_fingerprint, line_dedup, paragraph_dedup, simhash_dedup

    rows = [(i, f"a b c d e f g h {i // 2}\nx\ny\nz", "s", *range(9)) for i in range(6)]
    names = ["x.y", "__id", "__h", "__th", "__copies", "node", "comp", "key", "a`b"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n.replace('`', '``')}` long" for n in names))
    for out in (line_dedup.dedup_lines(df), mixing.replicate(df), simhash_dedup.keep_one(df), paragraph_dedup.remove(df), edit_fingerprint.near_classes(edit_fingerprint.fingerprint(df))):
        assert set(df.columns) <= set(out.columns)
        for x in out.collect():
            assert [x[n] for n in names] == list(range(9))

