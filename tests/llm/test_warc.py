"""The external merge: order over all ranges and runs, numbers of captures, and the edges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from opslens.llm import warc

DDL = "page_id long, url string, html string, digest string, offset long"
TIME = "timestamp_seconds(page_id % 50)"


def stored(spark, rows, tasks=5):
    return spark.createDataFrame(rows, DDL).repartition(tasks)


@pytest.fixture
def small(monkeypatch):
    """Executors run the package as it is, so only sizes that the driver hands over may be changed here."""
    monkeypatch.setattr(warc, "_SAMPLED", 1000)


def test_histories_are_in_order_and_numbered(spark, small):
    """A third of all pages have one URL, so its captures spread over several ranges."""
    r = random.Random(5)
    hot = "http://www.hot.example.net/en/1#top"
    urls = [hot if i % 3 == 0 else f"https://h{r.randint(0, 20)}.example.com/{r.randint(0, 30)}/?b=2&a=1" for i in range(6000)]
    rows = [(i, u, f"<p>{i % 700}", "clash", -1) for i, u in enumerate(urls)]
    folder = warc.shared_dir(spark, "warc-test")
    blocks = warc.write_archives(stored(spark, rows, 7), folder, F.expr(TIME))
    assert blocks.count() > 20
    index = warc.merge_index(blocks, folder, ranges=13).collect()
    assert len(index) == 6000 and len({x.range for x in index}) == 13
    index.sort(key=lambda x: (x.range, x.place))
    keys = [(x.url_key, x.ts, x.page_id, x.file, x.offset) for x in index]
    assert keys == sorted(keys)
    want = [n for _, part in itertools.groupby(keys, lambda k: k[0]) for n, _ in enumerate(part, 1)]
    assert [x.capture for x in index] == want
    assert len({x.range for x in index if x.url_key == warc.url_key(hot)}) > 3
    one = warc.merge_index(blocks, folder, ranges=1).collect()
    assert sorted(map(tuple, (x[2:] for x in one))) == sorted(map(tuple, (x[2:] for x in index)))


def test_runs_come_back_block_by_block(tmp_path):
    store, path = warc.open_store(str(tmp_path))
    r = random.Random(1)
    rows = [(f"k{r.randint(0, 99)}", "", i, "f", i, "é퟿", "response", "d", 1) for i in range(3 * warc.BLOCK_ROWS + 7)]
    blocks = warc.write_run(store, path, list(rows))
    assert len(blocks) == 4
    assert list(warc.read_run(store, path, blocks[0][0], [b[1:3] for b in blocks])) == sorted(rows)
    assert list(warc.read_run(store, path, blocks[0][0], [blocks[2][1:3]])) == sorted(rows)[512:768]
    assert [b[3:8] for b in blocks] == [x[:5] for x in sorted(rows)[::256]]


def test_edges(spark):
    rows = [(5, "http://b.org/x", "<p>", None, None), (2, None, None, "x", 1), (None, "http://a.org/", "<p>", "x", 1),
            (7, "http://a.org", "long " * 300_000, "x", 1), (7, "http://a.org", "long " * 300_000, "x", 1), (8, "http://[bad", "", "x", 1)]
    index, records = warc.archive_round_trip(stored(spark, rows, 2), F.timestamp_seconds("page_id"))
    got = sorted(((r.page_id, r.record_type, r.payload_bytes, r.refers_to, r.url_key, r.ts, r.capture) for r in records.collect()), key=str)
    assert got == sorted([
        (5, "response", 3, None, "org,b)/x", "19700101000005", 1), (2, "response", 0, None, "", "19700101000002", 1),
        (None, "revisit", 3, 5, "org,a)/", "", 1), (8, "revisit", 0, 2, "http://[bad", "19700101000008", 1),
        (7, "response", 1_500_000, None, "org,a)/", "19700101000007", 2),
        (7, "response", 1_500_000, None, "org,a)/", "19700101000007", 3)], key=str)
    assert index.count() == 6
    index, records = warc.archive_round_trip(stored(spark, []), F.expr(TIME))
    assert index.count() == 0 and records.count() == 0
