"""Near copies of the pipeline against brute-force Jaccard similarity of five-word shingles."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from ruleweave.llm import near_copies, simhash
from ruleweave.llm.common import read


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = find(a), find(b)
        if x != y and (sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))):
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def corpus(seed):
    """Chains of near copies, dissimilar texts around common passages, a large group of near copies, copies and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    text = lambda n: [word() for _ in range(n)]
    out = []
    for n in (60, 100, 300, 1000):
        for _ in range(3):
            base = text(n)
            out.append(base)
            for _ in range(4):
                base = list(base)
                for _ in range(rng.randrange(1, max(2, n // 40))):
                    base[rng.randrange(n)] = word()
                out.append(base)
    passage = text(40)
    out += [passage + text(rng.choice((1, 4, 8, 30))) for _ in range(60)]
    base = text(80)
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(80)] = word()
        out.append(copy)
    out += [text(k) for k in (1, 2, 4, 5, 6)] + [base, base, [], []]
    rng.shuffle(out)
    return [(i + 1, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "limit", "leaders"), [(1, 32, 4), (2, 3, 0), (3, 3, 2)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, limit, leaders):
    monkeypatch.setattr(near_copies, "SMALL", limit)
    monkeypatch.setattr(near_copies, "LEADERS", leaders)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == brute(rows)


@pytest.mark.parametrize(("block", "leaders"), [(300, 8), (300, 0), (1500, 1)])
def test_groups_of_several_blocks(spark, monkeypatch, block, leaders):
    monkeypatch.setattr(near_copies, "SMALL", 2)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "LEADERS", leaders)
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == brute(rows)


def crowd(n):
    """n near copies of one text of which a tenth differ by so much that they are linked to few others or none."""
    rng = random.Random(n)
    base, out = [f"w{rng.randrange(5000)}" for _ in range(120)], []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.choice((5, 6)) if i % 10 == 0 else rng.randrange(3)):
            copy[rng.randrange(120)] = f"w{rng.randrange(5000)}"
        out.append((i + 1, " ".join(copy)))
    return out


@pytest.mark.parametrize("block", [10**6, 20_000])
def test_rows_grow_with_a_group_not_with_its_pairs(spark, monkeypatch, block):
    """The tables written for a group of near copies hold few rows for each of them, however many there are."""
    monkeypatch.setattr(near_copies, "BLOCK", block, raising=False)
    written, write = {}, near_copies.materialize

    def counted(df, label, *more):
        out = write(df, label, *more)
        written.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    rows = crowd(600)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) > 1
    assert sum(sum(n) for label, n in written.items() if label in ("shingle-pairs", "shingle-likely", "shingle-dealt", "shingle-links")) < 20 * len(rows)


def test_classes_of_a_block():
    sets = [np.unique(np.array(s, np.int64)) for s in (range(10), range(1, 10), range(100, 110), [*range(2, 10), 50, 51], [5], range(101, 111))]
    found = near_copies.block_classes(sets).tolist()
    assert found[0] == found[1] != found[3] and found[2] == found[5] and len(set(found)) == 4
    seeks = np.array([False, True, False, False, False, False])
    assert near_copies.block_links(sets, np.arange(6), seeks) == [(1, 0)]
    assert near_copies.block_links(sets, np.array([0, 0, 2, 3, 4, 5]), seeks) == []


def test_sketches_discard_no_near_copy():
    rows = corpus(6)
    sets = [near_copies.shingle_set(t) for _, t in rows if t]
    sketches = np.array([np.bincount((s % np.uint64(near_copies.SKETCH)).astype(np.int64), minlength=near_copies.SKETCH) for s in sets])
    kept = near_copies.may_have_copies(np.array([len(s) for s in sets]), sketches)
    linked = [any(i != j and 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert not (np.array(linked) & ~kept).any() and not kept.all()


def test_stage_drops_copies_that_fingerprints_miss(spark, small):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    copy = [*base[:50], "changed", *base[51:]]
    schema = read(spark, small, "documents").schema
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in ((1, base), (2, copy), (3, base[::-1]))], schema)
    prints = [simhash.fingerprint(" ".join(t)) for t in (base, copy)]
    assert (prints[0] ^ prints[1]).bit_count() > simhash.RADIUS
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == [1, 3]


def test_stage_on_documents(spark, small):
    docs = read(spark, small, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == sorted(i for i, c in want.items() if i == c)


def test_stage_drops_what_fingerprints_link(spark, small):
    """A text whose three-word shingles hardly change the fingerprint is dropped, though its similarity is below 0.8."""
    base = ["a", "b", "c"] * 30
    copy = [*base, "d", "e"]
    assert simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(copy)) == 0
    assert len(shingle_set(" ".join(base)) & shingle_set(" ".join(copy))) < 0.8 * len(shingle_set(" ".join(base)) | shingle_set(" ".join(copy)))
    schema = read(spark, small, "documents").schema
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in ((1, base), (2, copy), (3, ["x", *base[::-1]]))], schema)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()}
    assert 1 in got and 2 not in got
