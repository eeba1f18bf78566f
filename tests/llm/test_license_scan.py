import re


from matchloom.llm import license_scan
from matchloom.llm.license_scan import PHRASES, license_spans, scan_licenses, template_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in PHRASES for q in [p.split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


PARTS = ["GNU General Public License", "apache-license", "CC BY", "cc", "by", "MIT", "license", "mit license", "words", "É", "the", "\n", "gnu general", "public license", "9"]


def test_base_places_against_brute_force(docs):
    import random

    random.seed(4)
    rows = [(i, random.choice([" ", ", "]).join(random.choice(PARTS) for _ in range(random.randrange(0, 40)))) for i in range(150)]
    for r in scan_licenses(docs(rows)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(dict(rows)[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1




def test_neighbouring_diagonals_merge(spark, docs):
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    changed = notice.replace("free of charge", "wholly free of any charge").replace("obtaining a copy", "obtaining copy")
    t = template_table(spark, [("notice", notice, "mit")])
    spans = license_spans(spark.createDataFrame([("k", "intro words " + changed + " outro")], "row_key string, text string"), t).where("kind <> 'end'").collect()
    assert len(spans) == 1 and spans[0].start == 2 and 0.6 <= spans[0].seen / spans[0].n_grams < 1 and spans[0].exact == []
    rows = scan_licenses(docs([(1, "Hereby granted, " + changed), (2, notice), (3, "permission is granted")])).collect()
    assert {r.doc_id: (r.labels, round(r.score, 3)) for r in rows} == {1: ("", 0.733), 2: ("mit", 1.0), 3: ("", 0.067)}
    assert {r.doc_id: r.labels for r in scan_licenses(docs([(1, changed)]), coverage=0.7).collect()} == {1: "mit"}


def test_awkward_rows(docs, awkward):
    rows = awkward + [(50, "MIT License"), (50, "MIT License"), (51, "mit license " * 3)]
    got = scan_licenses(docs(rows)).collect()
    assert len(got) == len(rows)
    assert all(r.n_base == 1 for r in got if r.doc_id == 50) and [(r.n_base, r.first_word, r.last_word) for r in got if r.doc_id == 51] == [(3, 0, 4)]
    assert all((r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0) for r in got if r.doc_id in (1, 2, 3))
    assert scan_licenses(docs(rows).where("false")).count() == 0


def test_many_templates_are_joined_by_shuffle(docs, monkeypatch):
    rows = [(i, " ".join([PARTS[i % len(PARTS)], "mit license", PARTS[i * 3 % len(PARTS)], "Kelvin wor\u212a"])) for i in range(120)] + [(500, None), (501, "")]
    few = {r.doc_id: tuple(r) for r in scan_licenses(docs(rows)).collect()}
    monkeypatch.setattr(license_scan, "BROADCAST_GRAMS", 3)
    assert {r.doc_id: tuple(r) for r in scan_licenses(docs(rows)).collect()} == few and len(few) == len(rows)


def test_only_ascii_is_lower_cased(docs):
    t = [("this wor\u212a is", "x")]
    assert [r.labels for r in scan_licenses(docs([(1, "THIS WORK IS")]), phrases=t, notices=[("no such words", "y")]).collect()] == [""]
    assert [r.n_base for r in scan_licenses(docs([(1, "THIS WOR\u212a IS")]), phrases=t, notices=[("no such words", "y")]).collect()] == [1]


def test_only_what_can_hit_leaves_a_text(docs, monkeypatch):
    t = template_table(docs([]).sparkSession, [("base", "mit license", "mit"), ("notice", "under the mit license", "mit")])
    rows = docs([(1, "plain words " * 5000 + "under the MIT license"), (2, "the license mit"), (3, "Kelvin " * 3), (4, None)])
    assert sorted(tuple(r) for r in license_scan._entries(rows, t, ["doc_id"], "text").collect()) == [
        (1, 10000, "under the"), (1, 10001, "the mit"), (1, 10002, "mit license"), (1, 10004, ""), (2, 0, "the license"), (2, 3, ""), (3, 3, ""), (4, 0, "")]
    few = {r.doc_id: tuple(r) for r in scan_licenses(rows).collect()}
    monkeypatch.setattr(license_scan, "LISTED_GRAMS", 1)
    assert license_scan._entries(rows, t, ["doc_id"], "text").count() == 10003 + 1 + 2 + 1 + 2 + 1 + 1
    assert {r.doc_id: tuple(r) for r in scan_licenses(rows).collect()} == few
