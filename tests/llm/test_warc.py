import hashlib

import pytest
from pyspark.sql import functions as F

import matchloom.llm.warc as warc
from matchloom.llm.warc import _placed, audit, manifest, merkle_levels, places, read_warc, warc_record, write_warc


def pages(spark, rows):
    return spark.createDataFrame([(k, f"http://x/{k}", h, 1, "z") for k, h in rows], "page_id long, url string, html string, key int, hash string").repartition(3)


def found(spark, a, b):
    differing, roots = audit(*(manifest(pages(spark, x), "page_id", F.coalesce("html", F.lit(""))) for x in (a, b)))
    return {r.key: r.status for r in differing.collect()}, {r.side: r.hash for r in roots.collect()}


def test_locates_every_damage(spark):
    a = [(k, f"page {k} " * (k % 7)) for k in range(1, 700, 2)]
    b = [(k, h + "!" if k == 101 else h) for k, h in a if k not in (5, 333)] + [(1000, "extra")]
    got, roots = found(spark, a, b)
    assert got == {101: "changed", 5: "missing", 333: "missing", 1000: "extra"} and roots["primary"] != roots["replica"]


def test_equal_replicas_stop_at_the_root(spark):
    a = [(k, f"p{k}") for k in range(300)]
    got, roots = found(spark, a, list(reversed(a)))
    assert got == {} and roots["primary"] == roots["replica"]


def test_awkward_rows(spark):
    a = [(None, None), (1, ""), (1, ""), (-5, "x"), (2**62 + 1, "y" * 100_000)]
    assert found(spark, a, a)[0] == {}
    assert found(spark, a, a[:1] + a[2:])[0] == {1: "missing"} and found(spark, a[:1] + a[2:], a)[0] == {1: "extra"}
    assert found(spark, a, a[:4] + [(2**62 + 2, "y" * 100_000)])[0] == {2**62 + 1: "missing", 2**62 + 2: "extra"}
    assert found(spark, a, [])[0] == {None: "missing", 1: "missing", -5: "missing", 2**62 + 1: "missing"}
    assert set(found(spark, [], a)[0].values()) == {"extra"} and found(spark, [], []) == ({}, {})
    assert found(spark, [(None, "a")], [(None, "b")])[0] == {None: "changed"}


def test_hot_keys_and_records_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 20)
    monkeypatch.setattr(warc, "CHUNK", 8)
    a = [(None, f"null {i}") for i in range(300)] + [(7, f"seven {i % 50}") for i in range(300)] + [(k, f"page {k}") for k in range(0, 4000, 40)] + [(9, "same")] * 200
    assert found(spark, a, a)[0] == {}
    b = [x for x in a if x != (None, "null 17") and x != (7, "seven 3")] + [(7, f"new {i}") for i in range(100)] + [(5, "extra")] * 3 + [(9, "same")]
    assert found(spark, a, b)[0] == {None: "missing", 7: "changed", 5: "extra", 9: "extra"}
    differing, _ = audit(*(manifest(pages(spark, x), "page_id", F.col("html")) for x in (a, b)))
    lost = {(r.key, r.hash): r.lost for r in differing.where("lost > 0").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert lost == {(None, sha("null 17")): 1, (7, sha("seven 3")): 6}


def test_tree_by_hand(spark):
    m = manifest(pages(spark, [(k, str(k)) for k in range(0, 4000, 1000)]), "page_id", F.substring("html", 1, 1))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    one = [f"{1000 * k}:1:{sha(str(k))}:1" for k in range(4)]
    two = [sha(sha(",".join(one[i : i + 2]))) for i in (0, 2)]
    levels = merkle_levels(_placed(m).withColumn("chunk", F.lit(0)), 2, fanout=2)
    assert [r.hash for r in levels[0].orderBy("node").collect()] == two
    assert levels[1].first().hash == sha(f"0:2:{two[0]},1:2:{two[1]}")


def test_places_match_the_written_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 7)
    rows = [(k, f"päge {k}\r\n\r\n" * (k % 5)) for k in range(40)] + [(40, None), (2**61, "far"), (3, "other"), (3, "third"), (None, "no key"), (None, "none")] + [(5, "repeated")] * 20
    df = pages(spark, rows)
    write_warc(df, str(tmp_path / "w"), file_records=16)
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    want = sorted((r.file_no, r.offset, r.length, r.hash) for r in places(manifest(df, "page_id", record), 16).collect())
    got = read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((int(r.path.split("file_no=")[1].split("/")[0]), r.offset, r.length, hashlib.sha256((r.headers + "\r\n\r\n").encode() + bytes(r.payload)).hexdigest()) for r in got) == want
    assert len(got) == len(rows) and max(f for f, *_ in want) == 4 and sorted(bytes(r.payload).decode() for r in got) == sorted(h or "" for _, h in rows)


def test_empty_files_and_tables(spark, tmp_path):
    (tmp_path / "none.warc").write_bytes(b"")
    assert read_warc(spark, str(tmp_path)).count() == 0
    write_warc(pages(spark, []), str(tmp_path / "w"))
    assert places(manifest(pages(spark, []), "page_id", F.col("html"))).count() == 0


def test_malformed_files_are_named(spark, tmp_path):
    (tmp_path / "bad.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")
    with pytest.raises(Exception, match="cut short"):
        read_warc(spark, str(tmp_path)).collect()
