import hashlib

import numpy as np

from matchloom.llm.common import shingle_sets
from matchloom.llm.fingerprint import Sketch, compare_edited, fingerprints, in_order_with_next, merge_fingerprints


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 100_000, size=n))


def test_estimates_against_full_sets():
    a, b, c = text(1, 3000), text(2, 3000), text(3, 1000)
    one, two = (a + " " + b).encode(), (a + " " + c).encode()
    s, t = shingle_sets([one, two], 5)
    x, y = Sketch.of([one, two], 5, 512)
    both = len(np.intersect1d(s, t))
    assert abs(x.resemblance(y) - both / len(np.union1d(s, t))) < 0.08
    assert abs(x.containment(y) - both / len(s)) < 0.1 and abs(x.distinct() / len(s) - 1) < 0.15
    assert str(x.merge(y)) == str(Sketch(np.union1d(s, t), 512)) and str(Sketch.parse(str(x))) == str(x)


def test_small_and_empty_sketches():
    none, one = Sketch.of([b"", b"just three words"], 5)
    assert none.distinct() == 0 and one.distinct() == 1
    assert none.resemblance(none) == 1 and none.resemblance(one) == 0 and none.containment(one) == 1


def test_edited_texts_and_order(docs):
    rows = [(i * 3, ("é🙂 " if i % 4 else "") + text(i, i % 13 * 4)) for i in range(150)]
    got = {r.doc_id: r for r in compare_edited(docs(rows), rows_per_range=10).collect()}
    assert len(got) == 150
    prints = {r.doc_id: r.fingerprint for r in fingerprints(docs(rows)).collect()}
    for (i, t), (j, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.fingerprint == prints[i]
        full = shingle_sets([t.encode(), edited.encode()], 5)
        both, union = len(np.intersect1d(*full)), len(np.union1d(*full))
        exact = both / union if union else 1.0
        assert abs(r.near_edited - exact) <= (0 if union <= 128 else 0.2)  # at most 128 hashes are no estimate
        assert r.edited_fingerprint == str(Sketch.of([edited.encode()], 5)[0]) and r.near_next == Sketch.parse(prints[i]).resemblance(Sketch.parse(prints[j]))


def test_awkward_rows(docs, awkward):
    got = compare_edited(docs(awkward), rows_per_range=2).collect()
    assert len(got) == len(awkward) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    alone = compare_edited(docs([(1, "abcdef")])).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert compare_edited(docs(awkward).where("false")).count() == 0
    extreme = compare_edited(docs([(-(2**63), "ab"), (2**63 - 1, "cd"), (0, "ef")])).collect()
    assert {r.doc_id: r.edited_sha256 for r in extreme}[2**63 - 1] == hashlib.sha256(b"ca").hexdigest()


def test_merging_over_rows(spark, docs):
    rows = [(i, text(i, 200)) for i in range(40)]
    merged = merge_fingerprints(fingerprints(docs(rows)).selectExpr("doc_id % 2 AS k", "fingerprint"), ["k"]).collect()
    for r in merged:
        want = np.unique(np.concatenate([s for (i, _), s in zip(rows, shingle_sets([t.encode() for _, t in rows], 5), strict=True) if i % 2 == int(r.k)]))
        assert r.fingerprint == str(Sketch(want))


def test_likeness_of_long_texts_against_full_sets(docs):
    rows = [(i, text(i, 1500 + 100 * i)) for i in range(20)]
    got = {r.doc_id: r for r in compare_edited(docs(rows)).collect()}
    off = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = shingle_sets([t.encode(), (t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()], 5)
        off.append(got[i].near_edited - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(off)) < 0.03 and np.max(np.abs(off)) < 0.15


def test_hot_and_far_ids_are_dealt_to_many_ranges(docs):
    rows = [(None, f"null {i} text") for i in range(200)] + [(7, f"seven {i % 90} text") for i in range(200)] + [(i, f"id {i} text") for i in range(100, 300)] + [(2**62, "far away text")]
    dealt = in_order_with_next(docs(rows), "doc_id", "text", rows_per_range=20).collect()
    sizes = {}
    for r in dealt:
        sizes[r.bucket] = sizes.get(r.bucket, 0) + r.own
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) <= 90
    got = compare_edited(docs(rows), rows_per_range=20).collect()
    assert len(got) == len(rows)
    # Every row is the successor of just one.
    follows = {}
    for t in (t for _, t in rows):
        follows[t] = follows.get(t, 0) + 1
    half = lambda t, after: hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and 100 <= r.doc_id < 300}
    assert all(by_id[i].edited_sha256 == half(f"id {i} text", f"id {i + 1} text") for i in range(100, 299))
    assert by_id[299].edited_sha256 == half("id 299 text", "far away text")
    last = next(r for r in got if r.doc_id == 2**62)
    assert last.edited_sha256 in {half("far away text", t) for i, t in rows if i is None}
    ends = [r.text for r in dealt if not r.own]
    assert len(ends) == len(sizes)
