import random
import re

import numpy as np

from matchloom.llm.neardup import connected_components, drop_near_duplicates, linked, near_duplicates, superminhash


def shingles(text, w):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + w]) for i in range(max(1, len(words) - w + 1))} if words else set()


def brute(rows, w):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, w)) for i, t in rows if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(n=60):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n // 6):
        base = [random.choice(vocabulary) for _ in range(random.choice([6, 40, 200]))]
        for _ in range(6):
            own = list(base)
            for _ in range(random.choice([0, 1, 2, 6])):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(own).upper() if g % 2 else " ".join(own)))
    return rows


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        n = 400
        both = rng.integers(0, 2**63, size=int(n * share)).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, size=n - len(both)).astype(np.uint64)]) for _ in range(2))
        sig = superminhash([a, b], 512)
        assert abs((sig[0] == sig[1]).mean() - len(both) / (2 * n - len(both))) < 0.08


def test_signature_slots_are_permutations():
    one = superminhash([np.array([12345], dtype=np.uint64)], 64)[0] >> np.uint64(32)
    assert sorted(one.tolist()) == list(range(64))  # one element offers each step to its own slot
    alone, batched = superminhash([np.arange(9, dtype=np.uint64)], 96), superminhash([np.arange(50, dtype=np.uint64), np.arange(9, dtype=np.uint64)], 96)
    assert (alone[0] == batched[1]).all()


def test_linked_finds_a_spanning_forest():
    sets = [np.arange(a, b, dtype=np.uint64) for a, b in ((0, 100), (5, 105), (10, 110), (200, 300), (0, 50))]
    # 0, 1 and 2 are linked with each other; the search starts at 0 and needs no third link.
    assert [tuple(map(int, x)) for x in linked(sets, 80, 100)] == [(0, 1), (0, 2)]


def test_against_brute_force(spark, docs):
    rows = corpus()
    for width in (4, 5):
        want = brute(rows, width)
        for blocks in (1_000_000, 300):
            got = near_duplicates(docs(rows), width=width, block_shingles=blocks).collect()
            assert {r.doc_id: r.component_id for r in got} == want
            assert all(r.n_shingles == len(shingles(dict(rows)[r.doc_id], width)) and r.kept == (r.component_id == r.doc_id) for r in got)


def test_recall_by_similarity(docs):
    """All links of edited copies are found, from just 0.8 up; pairs just below stay apart."""
    random.seed(9)
    rows, bands = [], {}
    for i in range(400):
        base = [f"w{random.randrange(5000)}" for _ in range(random.choice([60, 150, 300]))]
        own = list(base)
        for _ in range(random.randrange(1, 2 + len(base) // 28)):
            own[random.randrange(len(own))] = "edited"
        a, b = shingles(" ".join(base), 4), shingles(" ".join(own), 4)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(own))]
        bands.setdefault(100 * len(a & b) // len(a | b) // 5 * 5, []).append(2 * i + 1)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(rows), width=4).collect()}
    recall = {at: sum(got[i] == i - 1 for i in ids) / len(ids) for at, ids in bands.items()}
    assert all(len(bands[at]) >= 20 for at in (75, 80, 85, 90)) and all(r == (at >= 80) for at, r in recall.items())


def test_a_large_group_is_dealt_to_many_tasks(docs):
    """Near copies of one text, and others that share its bands with few of them, in blocks of few shingles."""
    random.seed(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        own = list(base)
        for at in random.sample(range(120), random.choice([1, 2, 3, 5, 8, 11])):
            own[at] = f"x{random.randrange(40)}"
        rows.append((i, " ".join(own)))
    want = brute(rows, 4)
    assert len(set(want.values())) > 5
    for block in (1_000_000, 3_000, 500):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs(rows), width=4, block_shingles=block).collect()} == want


def test_dropping_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, 2, {"x": 1}), (2, "a b c d e f", 3, 4, None), (2, "a b c d e f", 3, 1, None), (2, "a b c d e f", 0, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _matchloom_id long, _ROW long, _group map<string,int>")
    assert [r.doc_id for r in drop_near_duplicates(df).collect()] == [1] and drop_near_duplicates(df).columns == df.columns
    kept = {drop_near_duplicates(df.where("doc_id = 2").repartition(n)).first()["_matchloom_id"] for n in (1, 2, 3)}
    assert len(kept) == 1


def test_awkward_rows(spark, docs, awkward):
    got = near_duplicates(docs(awkward), width=4).collect()
    assert len(got) == len(awkward)
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[(1, 0)].component_id == 1 and by[(2, 0)].kept and by[(3, 0)].component_id == 3
    assert by[(5, 1)].component_id == 4 and not by[(5, 1)].kept
    assert sum(r.doc_id is None for r in got) == 2 and all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_duplicates(docs(awkward).where("false")).count() == 0


def test_a_repeated_id_joins_its_texts(docs):
    rows = [(1, "a b c d e f"), (9, "a b c d e f"), (9, "p q r s t u"), (4, "p q r s t u"), (9, "k l m n o"), (6, "k l m n o")]
    assert {r.component_id for r in near_duplicates(docs(rows)).collect()} == {1}


def test_dropping_keeps_one_of_each_group_and_all_columns(docs):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (2, "x y z"), (None, "a b c d e f"), (8, "")]
    kept = drop_near_duplicates(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (8, "")]


def test_dropping_keeps_unlike_texts_of_one_id(docs):
    clean = "a long clean text of many words that is no copy"
    rows = [(7, ""), (7, clean), (7, clean), (7, ""), (9, "p q r s t u"), (9, "k l m n o"), (3, "k l m n o"), (None, ""), (None, "")]
    for partitions in (1, 4):
        kept = drop_near_duplicates(docs(rows, partitions=partitions))
        assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, ""), (-1, ""), (3, "k l m n o"), (7, ""), (7, clean), (9, "p q r s t u")]
        assert kept.columns == docs(rows).columns


def test_components_of_long_chains(spark):
    n = 300
    order = list(range(n))
    random.seed(5)
    random.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(n)} == {0} and {got[i] for i in (1000, 1001, 1002)} == {1000}
