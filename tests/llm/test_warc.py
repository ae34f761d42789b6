import gzip
import hashlib

import pytest

from groundcheck.llm import _shared
from groundcheck.llm.warc import IndexReader, look_up, make_record, page_of, parse_record, record_id, reversed_host_key, write_archives

BIG = "<p>" + "same words again " * 20 + "</p>"
PAGES = [(k, f"http://www{k % 2 or ''}.host{k % 7}.example.org:80/a/{k % 5}?q={k}#x", f"<html>{k}</html>" if k % 3 else BIG) for k in range(40)]
PAGES += [(40, None, BIG), (41, "not a url", None), (42, "https://ümlaut.example/ä b", ""), (43, "http://h.example/\r\nX: y", "é" * 60), (44, "http://[bad", "x"), (45, "http://host1.example.org/a/1?q=1", "<b/>" * 30), (46, "http://host1.example.org/a/1?q=1", "<b/>" * 30)]
SCHEMA = "page_id long, url string, html string, key string, page long, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 9, "f") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    first, out = {}, []
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        data = (html or "").encode()
        own = first.setdefault(data, i)
        again = len(data) >= 100 and own != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", own if again else None))
    return out


def test_round_trip(spark):
    df = pages(spark, PAGES)
    found = look_up(write_archives(df, block=4), df).collect()
    assert sorted((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == brute(PAGES)


def test_lookups_of_a_key(spark):
    index = write_archives(pages(spark, PAGES), block=3)
    reader = IndexReader(index)
    key = reversed_host_key("http://host1.example.org/a/1?q=1")
    want = sorted(i for i, url, _ in PAGES if reversed_host_key(url) == key)
    assert [line[1] for line in reader.captures(key)] == want and len(want) == 3
    assert list(reader.captures("no,such)/")) == [] and list(reader.captures("")) and [x[1] for x in reader.captures("", 40)] == [40]
    record = reader.record(next(reader.captures(key, 45)))
    assert record.payload == b"<b/>" * 30 and record.uri == "http://host1.example.org/a/1?q=1"


def test_archives_are_standard_members(spark):
    index = write_archives(pages(spark, PAGES[:5]))
    reader = IndexReader(index)
    name = next(reader.captures(reversed_host_key(PAGES[1][1]), 1))[2]
    with reader.store.open_input_file(f"{reader.top}/{name}") as f:
        text = gzip.decompress(f.read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: re") and text.endswith(b"\r\n\r\n")


def test_repeated_rows_and_null_id(spark):
    rows = [*PAGES[:3], PAGES[0], (None, "http://a.example/", BIG)]
    df = pages(spark, rows)
    found = look_up(write_archives(df), df).collect()
    kinds = sorted((r.page if r.page is not None else -1, r.record_type, r.refers_to) for r in found)
    assert kinds == [(-1, "response", None), (0, "revisit", None), (0, "revisit", None), (1, "response", None), (2, "response", None)]


def test_one_row_for_every_row(spark):
    """Urls that differ but have one key, under one id, bring no more rows than there are."""
    rows = [(1, "http://www.x.org/", BIG), (1, "http://x.org/", BIG), (2, "http://x.org/", BIG), (2, "http://x.org/", "other"), (3, "http://x.org/", "other")]
    df = pages(spark, rows)
    found = look_up(write_archives(df), df).collect()
    assert sorted((r.page, r.record_type, r.refers_to, r.payload_bytes == 5) for r in found) == [(1, "response", None, False)] * 2 + [(2, "response", None, True), (2, "revisit", 1, False), (3, "response", None, True)]


def test_a_hot_payload(spark):
    """Most pages have one body: all revisit the first, wherever they lie."""
    rows = [(k, f"http://h{k % 9}.example/{k}", BIG if k % 4 else f"<p>{k}</p>" * 20) for k in range(600)]
    df = pages(spark, rows)
    found = look_up(write_archives(df), df).collect()
    assert sorted((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == brute(rows)


def test_shared_folder(spark, tmp_path, monkeypatch):
    """A folder without scheme is one of Spark's file system; a cluster without a folder is refused."""
    from types import SimpleNamespace

    conf = {"spark.checkpoint.dir": f"{tmp_path}/shared/"}
    as_if = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), _jvm=spark._jvm, _jsc=spark._jsc)
    assert _shared.shared_dir(as_if("spark://h:7077")) == f"file://{tmp_path}/shared"
    conf.clear()
    for master in ("spark://h:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            _shared.shared_dir(as_if(master))
    assert _shared.shared_dir(as_if("local[4]")).startswith("file:///")


def test_empty(spark):
    df = pages(spark, [])
    index = write_archives(df)
    assert index.files == [] and look_up(index, df).collect() == [] and list(IndexReader(index).captures("x")) == []


@pytest.mark.parametrize("url, key", [("http://www.Example.org:80/a?b#c", "org,example)/a?b"), ("https://x.y.z:8443", "z,y,x:8443)/"), (None, ""), ("plain", "plain")])
def test_keys(url, key):
    assert reversed_host_key(url) == key


def test_records():
    data = make_record(-5, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, "2000-01-01T00:00:00Z")
    r = parse_record(data)
    assert (r.page, r.kind, r.payload) == (-5, "response", b"abc") and page_of(record_id(-5)) == -5
    with pytest.raises(ValueError):
        parse_record(data.replace(b"abc", b"abd"))
