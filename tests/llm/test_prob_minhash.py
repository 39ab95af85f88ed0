import random

import numpy as np
import pytest

from quillon.llm import prob_minhash as p
from quillon.llm.components import components
from tests.llm.frames import bounded, listed, no_documents, odd_documents, wide_documents


def sets(rng, n, share):
    a = rng.integers(0, 2 ** 63, n).astype(np.uint64)
    b = np.concatenate([a[:int(n * share)], rng.integers(0, 2 ** 63, n - int(n * share)).astype(np.uint64)])
    w = rng.integers(1, 4, n)
    out = []
    for x, y in ((a, w), (b, np.where(np.arange(n) % 5 == 0, w + 2, w))):
        order = np.argsort(x)
        out.append((x[order], y[order]))
    return out


def brute_similarity(a, b):
    x, y = dict(zip(*a)), dict(zip(*b))
    every = {*x, *y}
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


@pytest.mark.parametrize("n", [1, 2, 9, 60])
def test_probability_jaccard(n):
    rng = np.random.default_rng(n)
    for share in (0, .5, .9, 1):
        a, b = sets(rng, n, share)
        assert p.probability_jaccard(a, b) == pytest.approx(brute_similarity(a, b), abs=1e-12)
        assert p.probability_jaccard(a, a) == pytest.approx(1)


@pytest.mark.parametrize("n", [3, 40, 600])
def test_sketch_estimates_it(n):
    rng, error = np.random.default_rng(n), []
    for _ in range(60):
        a, b = sets(rng, n, .8)
        error.append((p.sketch(*a) == p.sketch(*b)).mean() - p.probability_jaccard(a, b))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def family(rng, vocabulary, size, copies, edits):
    base = rng.choices(vocabulary, k=size)
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


def brute_classes(rows, threshold=0.8):
    shingles = [p.weighted_shingles(p.words_of(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or p.probability_jaccard(shingles[i], shingles[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    return sorted((doc_id, smallest[find(i)]) for i, (doc_id, _) in enumerate(rows))


def test_classes_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [t for size, copies, edits in ((200, 60, 6), (30, 5, 1), (400, 20, 12), (80, 2, 1)) for t in
             family(rng, vocabulary, size, copies, edits)]
    texts += family(rng, vocabulary, 50, 1, 0) * 3 + [" ".join(rng.choices(vocabulary, k=100)) for _ in range(40)] + ["a b", "a b c"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert listed(p.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute_classes(rows), key=str)


def test_test_tables_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert listed(p.near_duplicates(docs)) == sorted(brute_classes(rows), key=str)


def test_odd_rows(spark):
    docs = odd_documents(spark, clashes=True)
    found = listed(p.near_duplicates(docs))
    assert len(found) == docs.count()
    by_id = {}
    for doc_id, class_id in found:
        by_id.setdefault(doc_id, set()).add(class_id)
    # the copies and repeats of the prose; longer by three words of 44 is alike too; a null id has the class of its text
    assert by_id[5] == by_id[6] == by_id[7] == {5} and 5 in by_id[None] and by_id[0] == {0} and by_id[4] == {4}
    kept = p.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [0, 1, 2, 3, 4, 4, 5, 8, 9, 10, None]))


def test_keep_one_of_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words are here now ok"), (2, "a b c d e f g")],
                                  "doc_id long, text string")
    assert listed(p.keep_one(frame)) == [(1, "a b c d e f g"), (1, "other words are here now ok")]


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(0, i) for i in range(1, 50)]
    links = [(b, a) if rng.random() < .5 else (a, b) for a, b in chain + star + [(7, 7), (0, 1)]]
    out = dict(listed(components(spark.createDataFrame(links, "a long, b long"))))
    assert out == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_documents(spark):
    assert p.near_duplicates(no_documents(spark)).count() == 0
    assert p.keep_one(no_documents(spark)).count() == 0


def test_a_pair_of_one_bucket_is_compared(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(7)]
    texts.append(texts[0].rsplit(" ", 1)[0] + " other")
    # rows 1 to 6 are unlike all others and lie in more buckets, so that they are the heads; 0 and 7 share one bucket
    rows = [(i, i, p.node_of(i, t, p.words_of(t)), [0, 1, 2, 3] if 0 < i < 7 else [0]) for i, t in enumerate(texts)]
    drawn = spark.createDataFrame(rows, "doc_id long, text_key long, node binary, bands array<long>")
    monkeypatch.setattr(p, "sketches", lambda docs, size: drawn)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert listed(p.near_duplicates(docs)) == [*((i, i) for i in range(7)), (7, 0)]


def near_threshold(rng, weighted):
    """Families of nodes whose pairs lie on both sides of the threshold, as sets of ``probability_jaccard``."""
    out = []
    for _ in range(4):
        base = [rng.randrange(1, 2 ** 62) for _ in range(rng.choice([5, 30, 60]))]
        for _ in range(12):
            keys = {k: rng.randrange(1, 4) if weighted else 1 for k in base if rng.random() > 0.08}
            keys |= {rng.randrange(1, 2 ** 62): rng.randrange(1, 4) if weighted else 1 for _ in range(rng.randrange(4))}
            out.append((np.array(sorted(keys), np.uint64), np.array([keys[k] for k in sorted(keys)])))
    return [s for s in out if len(s[0])]


@pytest.mark.parametrize(("cell", "small"), [(1, 0), (3, 20), (1000, 0), (1000, 1000)])
@pytest.mark.parametrize("weighted", [False, True])
def test_cross_pairs_miss_no_link(spark, cell, small, weighted):
    rng = random.Random(7)
    every = near_threshold(rng, weighted)
    names = [bytes([i]) for i in range(len(every))]
    members = [(band, n, 1) for n in names for band in rng.sample(range(6), 3)]
    root = {n: names[i // 12 * 12] if rng.random() < 0.4 else n for i, n in enumerate(names)}
    labels = spark.createDataFrame([(n, r) for n, r in root.items() if n != r], "node binary, root binary")
    sets = spark.createDataFrame([(n, len(h), int(c.sum()), p.parity(h)) for n, (h, c) in zip(names, every)],
                                 "node binary, size long, mass long, signature binary")
    found = p.cross_pairs(spark.createDataFrame(members, "band long, node binary, weight long"), sets, labels, cell=cell, small=small)
    got = sorted((bytes(r.a), bytes(r.b)) for r in found.collect())
    bands = {n: {b for b, m, _ in members if m == n} for n in names}
    share = [(a, b) for a in names for b in names if a < b and root[a] != root[b] and bands[a] & bands[b]]
    links = [(a, b) for a, b in share if p.probability_jaccard(every[a[0]], every[b[0]]) >= 0.8]
    assert len(set(got)) == len(got) and set(links) <= set(got) <= set(share)
    assert links and len(got) < len(share)


def test_bound_by_signatures():
    """No pair above the threshold is ruled out, and most others are; also between signatures of unlike lengths."""
    rng = random.Random(8)
    every = near_threshold(rng, True) + near_threshold(rng, False)
    every += [(h[:n], c[:n]) for h, c in [sets(np.random.default_rng(3), 900, 1)[0]] for n in (900, 880, 500, 130, 120, 3)]
    known = [(len(h), int(c.sum()), p.parity(h)) for h, c in every]
    facts = p.Facts(*map(list, zip(*known)))
    assert len(facts.rows) > 3
    alike = np.array([[p.probability_jaccard(a, b) for b in every] for a in every])
    for bound in (0.5, 0.8, 0.95):
        passed = np.array([facts.may_link(*one, bound) for one in known])
        links = alike >= bound
        assert passed[links].all() and links.sum() >= len(every)
        assert (passed & ~links).mean() < 0.15


def test_a_large_family_makes_few_cross_pairs(spark):
    """Templates with a variable part above the threshold, and some below it: nearly all share buckets, few pairs are made."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(200):
        words = list(base)
        for at in rng.sample(range(300), 12 if i % 2 else 4):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []

    def counted(pairs, *args, real=p.verified):
        seen.append(pairs.count())
        return real(pairs, *args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(p, "verified", counted)
        assert listed(p.near_duplicates(docs)) == sorted(brute_classes(list(enumerate(texts))), key=str)
    assert seen[1] < 2 * len(texts)


@pytest.mark.parametrize("cell", [700, 1 << 20])
@pytest.mark.parametrize("weighted", [False, True])
def test_cross_links_join_what_all_links_join(spark, cell, weighted):
    rng = random.Random(7)
    every = near_threshold(rng, weighted)
    names = [bytes([i]) for i in range(len(every))]
    members = [(band, n) for n in names for band in rng.sample(range(6), 3)]
    root = {n: names[i // 12 * 12] if rng.random() < 0.4 else n for i, n in enumerate(names)}
    labels = spark.createDataFrame([(n, r) for n, r in root.items() if n != r], "node binary, root binary")
    rows = [(n, h.astype(np.int64).tolist(), c.tolist() if c.max() > 1 else None, len(h), int(c.sum()), p.parity(h)) for n, (h, c) in zip(names, every)]
    sets = spark.createDataFrame(rows, "node binary, hashes array<long>, counts array<int>, size long, mass long, signature binary")
    found = p.cross_links(spark.createDataFrame(members, "band long, node binary"), sets, labels, cell=cell)
    got = [(bytes(r.a), bytes(r.b)) for r in found.collect()]
    bands = {n: {b for b, m in members if m == n} for n in names}
    links = [(a, b) for a in names for b in names if a < b and root[a] != root[b] and bands[a] & bands[b]
             and p.probability_jaccard(every[a[0]], every[b[0]]) >= 0.8]
    assert links and {(min(x), max(x)) for x in got} <= set(links) and len(got) < len(members)

    def joined(more):
        rows = [(a, b) for a, b in [*root.items(), *more] if a != b]
        return {(bytes(a), bytes(b)) for a, b in listed(components(spark.createDataFrame(rows, "a binary, b binary")))}
    assert joined(got) == joined(links) != joined([])


def test_two_families_closely_below_the_threshold_make_rows_for_their_nodes(spark, monkeypatch):
    """Every text of one is 0.7994 like every text of the other: no table between has more rows than the texts have bands."""
    texts = []
    for i in range(160):
        words = [f"w{k}" for k in range(300)]
        for at in (10, 20, 30, 2) if i % 2 else (40, 50, 60):
            words[at] = f"x{i} {at}".replace(" ", "x")
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []

    def counted(frame, label, real=p.written):
        out = real(frame, label)
        if label in ("pairs", "links"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(p, "written", counted)
    assert listed(p.near_duplicates(docs)) == sorted(((i, i % 2) for i in range(160)), key=str)
    assert max(seen) < p.BANDS * len(texts)


def test_texts_go_to_python_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(p, "with_python", bounded(p.with_python))
    docs = wide_documents(spark)
    docs = docs.union(docs.where("doc_id < 100").withColumn("doc_id", docs.doc_id + 10_000)).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    assert p.keep_one(docs).count() == 1500
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
