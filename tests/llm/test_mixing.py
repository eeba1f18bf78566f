import math
import re

import pytest

from matchloom.llm.mixing import draw_mix, mix_sources, water_filled_targets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Round by round: give by weight, cap, and share what is over again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        over = 0.0
        for s in sorted(open_, key=str):
            got[s] += left * w[s] / total
        for s in list(open_):
            if got[s] >= cap * sizes[s] - 1e-12:
                over += got[s] - cap * sizes[s]
                got[s] = cap * sizes[s]
                open_.discard(s)
        left = over
    return got


def corpus():
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 7}" if i % 3 else "hot") for i in range(400)]
    rows += [(1000 + i, "w " * 50, None) for i in range(30)] + [(2000, "w " * 9000, "s1"), (2001, None, "s2"), (2002, " ", "only empty"), (7, "repeated row", "s1"), (7, "repeated row", "s1"), (None, "no id", "s3")]
    return rows


def test_targets(spark):
    sizes = {"a": 100, "b": 5000, "c": 40, "d": 700, None: 90, "é": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in water_filled_targets(df, 1.5, 2.0, [5, 2, 1]).collect()}
    for s, t in targets(sizes).items():
        assert got[s] == pytest.approx(t, abs=1e-6)


def test_budgets_are_met_and_reruns_agree(docs):
    rows = corpus()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    want = targets(sizes)
    got = mix_sources(docs(rows)).collect()
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        taken = sum(r.taken for r in own)
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size for r in own)
        assert math.floor(want[s] + 1e-9) - 2 <= taken <= want[s] + 1e-6  # equal hashes round down together
        assert sum(r.taken % r.size > 0 for r in own if r.size) <= 3
    again = mix_sources(docs(rows, partitions=7)).collect()
    key = lambda r: (str(r.doc_id), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix_sources(docs(rows).where("false")).count() == 0


def test_thresholds_are_nested(docs):
    rows = [(i, "w " * 10, f"s{i % 2}") for i in range(200)]
    small, large = ({r.doc_id: r.taken for r in mix_sources(docs(rows), budget_share=b).collect()} for b in (0.3, 0.6))
    assert all(large[i] >= small[i] for i in small)


def test_drawn_rows_are_whole(docs):
    rows = corpus()
    source = docs(rows)
    drawn = draw_mix(source)
    assert drawn.columns == source.columns
    taken = {}
    for r in mix_sources(source).collect():
        if r.size:
            taken.setdefault((r.doc_id, r.size), []).append(int(math.floor(r.taken / r.size + 0.5)))
    out = {}
    for r in drawn.collect():
        k = (r.doc_id, len(WORDS.findall(r.text)))
        out[k] = out.get(k, 0) + 1
    assert out == {k: sum(v) for k, v in taken.items() if sum(v)}
