"""Near-dedup, paragraph dedup and line dedup against brute force, and their edge cases."""

import collections
import random

import numpy as np
import pytest

from weftline.llm import candidates, components, line_dedup, paragraph_dedup, shingles, simhash_dedup

WORDS = ["".join(random.Random(i).choice("abcdefghij") for _ in range(3 + i % 6)) for i in range(3000)]


def prose(r, n, per_line=40):
    w = [r.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + per_line]) for i in range(0, n, per_line))


def edit(r, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def sets(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows, at_least=0.8):
    """id -> least id of its component, by comparing all that share a shingle."""
    s, parent, by_shingle = {i: sets(t) for i, t in rows}, {i: i for i, _ in rows}, collections.defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in s.items():
        shared = collections.Counter(j for g in x for j in by_shingle[g])
        for g in x:
            by_shingle[g].append(i)
        for j, n in shared.items():
            if n / (len(x) + len(s[j]) - n) >= at_least:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in s}


def corpus(seed=0, groups=12):
    r = random.Random(seed)
    rows = [prose(r, r.choice([8, 30, 120, 400])) for _ in range(120)]
    for _ in range(groups):
        base = prose(r, r.choice([60, 200, 600]))
        rows += [base] * r.choice([1, 3]) + [edit(r, base, max(1, len(base.split()) // 60)) for _ in range(r.choice([2, 6, 25]))]
    rows += ["one", "one", "two words", "", "  ", "a b c d e", "a  b c d\te"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [0, 1])
def test_simhash_classes_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash_dedup.near_duplicates(df).collect()}
    want = brute_classes(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert sum(r["kept"] for r in got.values()) == len(set(want.values()))
    sizes = collections.Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got.values())


def test_simhash_chain_and_hot_group(spark):
    """A chain links texts that aren't alike themselves; a third of all rows are copies."""
    r = random.Random(5)
    chain = [prose(r, 300)]
    for _ in range(6):
        chain.append(edit(r, chain[-1], 6))
    hot = prose(r, 100)
    rows = list(enumerate([*chain, *[hot] * 40, *[prose(r, 80) for _ in range(60)]]))
    got = {x["doc_id"]: x["class_id"] for x in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_simhash_edge_rows(spark):
    rows = [(1, None, 5), (2, None, 5), (None, "a b c d e f", 5), (3, "a b c d e f", 5), (3, "a b c d e f", 5), (4, "", 5), (5, "", 5), (2**60 + 1, "big id stays exact here now", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = simhash_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["class_id"], r["class_size"], r["kept"]))
    assert by[1] == [(1, 1, True)] and by[2] == [(2, 1, True)]
    assert by[3] == [(3, 3, True)] * 2 and by[None] == [(3, 3, False)]
    assert by[4] == [(4, 2, True)] and by[5] == [(4, 2, False)] and by[2**60 + 1] == [(2**60 + 1, 1, True)]
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in simhash_dedup.keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, None), (2, None), (3, "a b c d e f"), (4, ""), (2**60 + 1, "big id stays exact here now")], key=repr)
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_simhash_counts_a_repeated_shingle_once():
    r = random.Random(6)
    line, rest = " ".join(r.choice(WORDS) for _ in range(14)), prose(r, 100)
    sigs, counts = simhash_dedup.simhashes([f"{rest}\n{line}", "\n".join([rest, *[line] * 300])])
    assert candidates.distance(sigs[:1], sigs[1:])[0] <= simhash_dedup.most_bits()
    assert counts.tolist() == [len(sets(f"{rest}\n{line}")), len(sets("\n".join([rest, line, line])))]


def test_rungs_meet_the_recall():
    for n in (1, 10**3, 10**6, 10**10):
        steps = simhash_dedup.rungs(n)
        for depth, tries in steps:
            assert 1 - (1 - (1 - simhash_dedup.bit_error(0.8)) ** depth) ** tries >= simhash_dedup.RECALL
        assert [d for d, _ in steps] == sorted({d for d, _ in steps})
        assert n / 2 ** steps[0][0] <= simhash_dedup.PER_PREFIX
    r = np.random.default_rng(3)
    sig = r.integers(0, 2**64, size=(2000, 4), dtype=np.uint64)
    flips = np.packbits(r.random((2000, 256)) < simhash_dedup.bit_error(0.8), axis=1).view(np.uint64)
    one, two = simhash_dedup._bits(sig), simhash_dedup._bits(sig ^ flips)
    depth, tries = simhash_dedup.rungs(10**6)[0]
    met = np.zeros(2000, dtype=bool)
    for t in range(tries):
        met |= simhash_dedup._permuted(one, t, depth) == simhash_dedup._permuted(two, t, depth)
    assert met.mean() >= 0.997
    masks = simhash_dedup._masks(depth, 3)
    for t in range(3):
        assert (((sig ^ sig[:1]) & masks[t]).any(axis=1) == (simhash_dedup._permuted(one, t, depth) != simhash_dedup._permuted(one[:1], t, depth))).all()


def _signatures(spark, sig, comp=None):
    rows = [(i, int(comp[i]) if comp is not None else i, 50, *map(int, s)) for i, s in enumerate(sig.view(np.int64))]
    return spark.createDataFrame(rows, "node long, comp long, n long, s0 long, s1 long, s2 long, s3 long")


def _crowd(seed, n):
    """n signatures whose leading bits in every trie are those of one text, and the last row equal to the first."""
    r = np.random.default_rng(seed)
    sig = r.integers(0, 2**64, size=(1, 4), dtype=np.uint64) ^ np.packbits(r.random((n, 256)) < 0.02, axis=1).view(np.uint64)
    far = np.packbits(r.random((n, 256)) < 0.5, axis=1).view(np.uint64)
    used = np.bitwise_or.reduce(simhash_dedup._masks(4, 2), axis=0)
    sig = (sig[:1] & used) | (far & ~used)
    sig[-1] = sig[0]
    return sig


def test_crowded_prefix_finds_the_twin(spark, monkeypatch):
    """12,000 unlike signatures under one prefix in every trie; the last is equal to the first. No rung can split them, so all are compared in cells."""
    monkeypatch.setattr(simhash_dedup, "rungs", lambda *_: [(4, 2)])
    sig = _crowd(0, 12_000)
    found = {(x["a"], x["b"]) for x in simhash_dedup.climb(_signatures(spark, sig), 12_000, 0.8, 0.999, 1000).collect()}
    d = lambda a, b: int(np.bitwise_count(sig[a] ^ sig[b]).sum())
    assert (11_999, 0) in found and all(d(a, b) <= simhash_dedup.most_bits() for a, b in found)


@pytest.mark.parametrize("leaf", [7, 60, 10_000])
def test_every_cut_of_a_crowded_bucket_gives_all_pairs(spark, leaf):
    """Pairs of different classes within the distance, by brute force, whether the bucket is cut into cells or not."""
    sig = _crowd(1, 260)
    sig[130:] = sig[:130] ^ np.uint64(1)
    comp = np.array([i if i % 3 else 0 for i in range(260)])
    got = [(x["a"], x["b"]) for x in simhash_dedup.climb(_signatures(spark, sig, comp), 200, 0.8, 0.999, leaf).collect()]
    want = {(i, j) for i in range(260) for j in range(i) if comp[i] != comp[j] and np.bitwise_count(sig[i] ^ sig[j]).sum() <= simhash_dedup.most_bits()}
    near = {p for p in want if np.bitwise_count(sig[p[0]] ^ sig[p[1]]).sum() <= 1}
    assert len(got) == len(set(got)) and set(got) <= want and near <= set(got)
    rows = _signatures(spark, sig, comp).selectExpr("*", "node % 2 key")
    full = {(i, j) for i in range(260) for j in range(i) if comp[i] != comp[j] and i % 2 == j % 2}
    for f in (candidates.within, lambda *a: candidates.within_crowded(*a, leaf=leaf)):
        pairs = [(x["a"], x["b"]) for x in f(rows, 0.8).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == full


def test_templated_texts_in_crowded_prefixes(spark):
    """Texts that share 70 % of their shingles, among them near copies: the classes are those of brute force, on small leaves too."""
    r = random.Random(21)
    base = prose(r, 120, 1000).split()
    rows = []
    for i in range(500):
        w = base[:100] + [r.choice(WORDS) for _ in range(20 + r.randrange(3))]
        rows.append(" ".join(w))
        if i % 25 == 0:
            rows.append(" ".join(w[:-1] + [r.choice(WORDS)]))
    rows = list(enumerate(rows))
    got = {x["doc_id"]: x["class_id"] for x in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=64).collect()}
    assert got == brute_classes(rows)


def test_similar_counts_shared_shingles():
    r = np.random.default_rng(5)
    pool = np.sort(r.integers(0, 2**63, 400).astype(np.uint64))
    held = {i: np.unique(r.choice(pool, r.integers(1, 200))) for i in range(40)}
    a, b = np.nonzero(np.triu(np.ones((40, 40)), 1))
    want = [len(np.intersect1d(held[x], held[y])) / len(np.union1d(held[x], held[y])) for x, y in zip(a.tolist(), b.tolist())]
    for at in (0.1, 0.2, 0.3):
        assert candidates.similar(held, a, b, at).tolist() == [x >= at for x in want]


def test_shingle_hashes_follow_words():
    r = random.Random(2)
    texts = [prose(r, n) for n in (0, 1, 4, 5, 6, 50)] + [None, "x" * 100000, "a b c d e f"]
    for t, s in zip(texts, shingles.shingle_sets(texts)):
        assert len(s) == len(sets(t))
    a, b = texts[5], edit(r, texts[5], 2)
    x, y = shingles.shingle_sets([a, b])
    assert shingles.jaccard(x, y) == len(sets(a) & sets(b)) / len(sets(a) | sets(b))


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + k) for k in range(1, 400)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {i: root(i) for i in parent if any(i in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def _passages(rows):
    """(id, first word, words) -> (line or None, text) of all lines and units, by the operator's own cuts."""
    out = {}
    for i, t in rows:
        n = (t or "").split()
        for w, k, line, _ in zip(*(x.tolist() for x in paragraph_dedup.passages([t])[1:5])):
            out[i, w, k] = (line if line >= 0 else None, " ".join(n[w : w + k]))
    return out


def brute_repeats(rows, least):
    """(id, word, words) -> (place of the cluster's first, removed), all steps written out over brute-force classes of all passages."""
    cuts = sorted(_passages(rows).items(), key=lambda x: (x[0][0], x[0][1], -x[0][2]))
    numbers = {k: i for i, (k, _) in enumerate(cuts)}
    cls = brute_classes([(numbers[k], t) for k, (_, t) in cuts])
    comp = {k: cls[i] for k, i in numbers.items()}

    def repeated(places):
        n = collections.Counter(comp[k] for k in places)
        return [k for k in places if n[comp[k]] > 1]

    ends, apart = {}, []
    for k, _ in cuts:
        if k[1] >= ends.get((k[0], comp[k]), 0):
            ends[k[0], comp[k]] = k[1] + k[2]
            apart.append(k)
    covered = collections.defaultdict(set)
    apart = repeated(apart)
    for i, w, n in apart:
        covered[i] |= set(range(w, w + n))

    def run(i, w):
        a = b = w
        while a - 1 in covered[i]:
            a -= 1
        while b + 1 in covered[i]:
            b += 1
        return b - a + 1

    kept = repeated([k for k in apart if run(k[0], k[1]) >= least])
    heads = {}
    for k in sorted(kept):
        heads.setdefault(comp[k], k)
    return {k: (heads[comp[k]], heads[comp[k]] != k) for k in kept}


@pytest.mark.parametrize("least", [5, 25])
def test_repeats_are_those_of_brute_force(spark, least, monkeypatch):
    """A mixed corpus: equal and edited paragraphs, short lines, passages set into other text, spam, a text given twice."""
    monkeypatch.setattr(paragraph_dedup, "LEAF", 1 if least == 5 else 256)  # buckets by classes, or all with all
    r = random.Random(3)
    shared = [prose(r, n, n) for n in (7, 12, 26, 60, 90)]
    inner = [prose(r, n, n) for n in (55, 60, 120)]
    rows = []
    for i in range(150):
        lines = [prose(r, r.choice([3, 10, 30, 60]), 60) for _ in range(r.randrange(5))]
        if i % 3 == 0:
            p = shared[i % len(shared)]
            lines.insert(r.randrange(len(lines) + 1), edit(r, p, 1) if i % 2 else p)
        if i % 7 == 0:
            w = prose(r, 70, 1000).split()
            k = r.randrange(70)
            w[k:k] = edit(r, inner[i % 3], i % 2).split()
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, rows[0][1]), (504, "buy now " * 90), (505, "it is\nso we all may buy now " + "buy now " * 70)]
    want = brute_repeats(rows, least)
    df = spark.createDataFrame([(*x, "z", "u") for x in [*rows, rows[3]]], "doc_id long, text string, cluster string, `x.y` string")
    found = paragraph_dedup.repeats(df, least=least).collect()
    got = {(x["doc_id"], x["start_word"], x["n_words"]): (x["first_doc_id"], x["removed"]) for x in found}
    assert got == {k: (h[0], gone) for k, (h, gone) in want.items()} and len(found) == len(got)
    clusters = collections.defaultdict(list)
    for x in found:
        clusters[x["cluster"]].append(x["removed"])
    assert all(v.count(False) == 1 and len(v) > 1 for v in clusters.values())
    lines = {k: line for k, (line, _) in _passages(rows).items()}
    assert all(x["paragraph"] == lines[x["doc_id"], x["start_word"], x["n_words"]] and x["kind"] == ("unit" if x["paragraph"] is None else "paragraph") for x in found)
    kept = paragraph_dedup.remove(df.where("doc_id <> 3"), least=least)
    assert kept.columns == df.columns
    rest = {x["doc_id"]: x["text"] for x in kept.collect()}
    gone = collections.defaultdict(list)
    for (i, w, n), (_, removed) in brute_repeats([x for x in rows if x[0] != 3], least).items():
        if removed:
            gone[i].append((w, n))
    assert rest == {i: t if not gone[i] else paragraph_dedup.without(t, gone[i]) for i, t in rows if i != 3}


def test_alike_lines_are_found_whatever_their_hashes(spark):
    """Pairs of lines over the threshold whose hashes begin with the same six bits."""
    r = random.Random(12)
    pairs = []
    while len(pairs) < 12:
        w = prose(r, 60, 10**6).split()
        pair = [" ".join(w), " ".join([*w[:30], "other", *w[31:]])]
        a, b = (int(paragraph_dedup.passages([t])[4][0]) >> 58 for t in pair)  # the line comes first
        pairs += [pair] if a == b else []
    rows = [(2 * k + j, t) for k, pair in enumerate(pairs) for j, t in enumerate(pair)]
    found = paragraph_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("paragraph = 0").collect()
    clusters = {x["doc_id"]: x["cluster"] for x in found}
    assert len(clusters) == len(rows) and all(clusters[i] == clusters[i - i % 2] for i in clusters)
    assert len(set(clusters.values())) == len(pairs)


def test_each_text_is_cut_once(spark):
    """One Python pass gives the passages with all that they are compared by; ids stay exact beside nulls."""
    texts = ["a b c d e f g", None, "x\n" + "p q r s t " * 9, ""]
    tuned = [paragraph_dedup.schemes()[0], None]
    rows = spark.createDataFrame(list(zip([2**53 + 1, None, None, 3], texts)), "doc_id long, text string")
    got = paragraph_dedup._occurrences(rows, "text", tuned).collect()
    keys, at, (i, w, n, p, h, *_), count, sketch = paragraph_dedup.banded([t or "" for t in texts], tuned)
    held = [sorted(keys[at == x].view(np.int64).tolist()) for x in range(len(i))]
    want = sorted(zip(h.view(np.int64).tolist(), w.tolist(), n.tolist(), p.tolist(), count.tolist(), sketch.view(np.int64).tolist(), held))
    assert sorted((x["ph"], x["word"], x["n_words"], x["line"], x["n"], x["s0"], sorted(x["keys"])) for x in got) == want
    assert {x["id"] for x in got} == {2**53 + 1, None}


def test_no_two_alike_units_miss_each_other():
    """Units against units that differ in a shingle on each side, against shorter and longer lines, and among units that repeat themselves: at 0.8, not only at 11/13."""
    r = random.Random(13)
    texts = []
    for _ in range(1500):
        w = prose(r, 21, 10**6).split()
        texts += [w[:16], w[1:17], [*w[:15], "x"], w[:19], ["x", *w[:16], "y", "z"], w[:14], w[:15], w[:18]]
    for _ in range(40):
        w = prose(r, 10, 10**6).split()
        texts += [[*w, *w][:16], ([*w, *w][:16])[1:] + ["x"], w + w[:5]]
    texts = [" ".join(w) for w in texts]
    assert len(sets(texts[4])) == paragraph_dedup.WIDEST and len(sets(texts[4]) & sets(texts[0])) == 12
    keys, at, found, _, _ = paragraph_dedup.banded(texts, [(1, 1), None])
    held = collections.defaultdict(set)
    for k, x in zip(keys.tolist(), at.tolist()):
        held[int(found[0][x])].add(k)
    missed = []
    for block, step in ((range(0, 12000, 8), 8), (range(12000, 12120, 3), 3)):
        for s in block:
            for a in range(s, s + step):
                for b in range(s, a):
                    x, y = sets(texts[a]), sets(texts[b])
                    if min(len(x), len(y)) <= 12 and len(x & y) >= 0.8 * len(x | y) and 10 <= min(len(x), len(y)) and not held[a] & held[b]:
                        missed.append((a, b))
    assert not missed


def test_repeats_of_nothing(spark):
    assert paragraph_dedup.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert paragraph_dedup.repeats(spark.createDataFrame([(None, None), (1, "a b c d e f")], "doc_id long, text string")).count() == 0


def test_set_in_passages_are_found(spark):
    """Every passage of 51 words and more that is set into other text is found, and its neighbours are left alone."""
    r = random.Random(8)
    inner = [prose(r, n, n) for n in (51, 55, 60, 80, 120)]
    rows = []
    for i in range(200):
        w = prose(r, r.choice([20, 90, 300]), 1000).split()
        if i % 2:
            k = r.randrange(len(w))
            w[k:k] = inner[i // 2 % 5].split()
        rows.append((i, " ".join(w)))
    found = paragraph_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in found} == {i for i, _ in rows if i % 2}


def test_units_do_not_depend_on_what_stands_around():
    r = random.Random(9)
    for n in (51, 60, 120):
        p = prose(r, n, 1000).split()
        for _ in range(20):
            a, b = prose(r, 40, 99).split(), prose(r, 33, 99).split()
            texts = [" ".join([*prose(r, 40, 99).split(), *p, *b]), " ".join([*a, *p, *prose(r, 20, 99).split()])]
            one, two = ({h for w, k, x, h in zip(*(c.tolist() for c in paragraph_dedup.passages([t])[1:5])) if x < 0} for t in texts)
            assert one & two
    assert len(paragraph_dedup.unit_starts(*shingles.word_hashes(["the " * 400]))) > 0
    assert paragraph_dedup.without("a b\nc  d", [(1, 2)]) == "a \nd"


def test_lines_of_five_words_are_paragraphs():
    i, w, n, p = (x.tolist() for x in paragraph_dedup.passages(["x\n", "a b c d\nq a line of five\n\n" + "w " * 24, None, "a b c d e"])[:4])
    assert [x for x in zip(i, w, n, p) if x[3] >= 0] == [(1, 4, 5, 1), (1, 9, 24, 3), (3, 0, 5, 0)]


def test_band_minima_are_those_of_each_passage():
    """The keys of a passage inside a text are the keys of its words alone."""
    r = random.Random(10)
    texts = [prose(r, n) for n in (0, 4, 5, 24, 25, 26, 90, 300)] + [None, "the " * 90]
    found = paragraph_dedup.passages(texts)
    keys = paragraph_dedup.band_keys(found, 4, 2)
    for i, w, n, h, k in zip(*(c.tolist() for c in (found[0], found[1], found[2], found[4])), keys.tolist()):
        alone = [" ".join(texts[i].split()[w : w + n])]
        sets_ = shingles.shingle_sets(alone)[0]
        again = []
        for b in range(4):
            key = np.uint64(0)
            for row in range(2):
                key = key * np.uint64(31) + ((sets_ * paragraph_dedup._ODD[b * 2 + row]).min() >> np.uint64(8))
            again.append(int(paragraph_dedup.mix64(np.array([key + np.uint64(b)]))[0]))
        assert k == again
        assert h in paragraph_dedup.passages(alone)[4].tolist()


def test_sketches_never_differ_more_than_the_sets():
    r = random.Random(11)
    base = prose(r, 80)
    texts = [base, edit(r, base, 1), edit(r, base, 9), prose(r, 30), "the " * 90, "a b c d e f g " * 6, None]
    found = paragraph_dedup.passages(texts)
    n, sketch = paragraph_dedup.sketches(found)
    held = [sets(" ".join(texts[i].split()[w : w + k])) for i, w, k in zip(*(x.tolist() for x in found[:3]))]
    assert n.tolist() == [len(x) for x in held]
    for i, x in enumerate(held):
        for j, y in enumerate(held):
            assert int(sketch[i] ^ sketch[j]).bit_count() <= len(x ^ y)


def test_bands_are_tuned():
    for (bands, rows), at, hashes in zip(paragraph_dedup.schemes(), (0.8, 11 / 13), (paragraph_dedup.HASHES, paragraph_dedup.UNIT_HASHES)):
        assert 1 - (1 - at**rows) ** bands >= paragraph_dedup.RECALL and bands * rows <= hashes


def brute_lines(rows):
    first, gone = {}, collections.defaultdict(set)
    for key, lines in sorted(((i, t.split("\n")) for i, t in rows if t is not None), key=lambda x: x[0]):
        for p in range(len(lines) - 2):
            if first.setdefault(tuple(lines[p : p + 3]), (key, p)) != (key, p):
                gone[key] |= {p, p + 1, p + 2}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_windows(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice("abcd") * r.choice([1, 2]) for _ in range(r.randrange(9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x\nx\nx\nx\nx"), (103, "p\nq"), (104, "p\nq"), (105, "k\n" * 3000), (106, "é" * 50000 + "\n1\n2"), (107, "0\n" + "é" * 50000 + "\n1\n2")]
    df = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, n_removed int")
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(df).collect()}
    want = brute_lines(rows)
    assert {i: x["clean_text"] for i, x in got.items()} == want
    for i, t in rows:
        assert got[i]["n_lines"] == (0 if t is None else len(t.split("\n")))
    assert got[102]["clean_text"] == "x"
    kept = {line for t in want.values() if t for line in t.split("\n")}
    assert kept == {line for _, t in rows if t for line in t.split("\n")} - ({""} - kept)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_windows_with_repeated_rows_and_null_ids(spark):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "z\na\nb\nc")]
    got = sorted((x["doc_id"] or 0, x["clean_text"]) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "a\nb\nc"), (1, "d"), (1, "d"), (2, "z")]
