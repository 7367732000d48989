"""The paged feed against a file that plays the service: it counts pulls, fails on demand and grows."""

import json
import os
from urllib.parse import parse_qs, urlparse

import pytest

from panelyst.sources.paged import Page, PagedFeed, Pages, _StreamReader

SIZE = 3


def served(url: str) -> str:
    """A page of the feed in the folder that is the URL's path; each file ``fail-<page>`` makes one pull of the page fail."""
    u = urlparse(url)
    folder, page = u.path, int(parse_qs(u.query)["page"][0])
    with open(f"{folder}/pulls", "a") as f:
        f.write(f"{page}\n")
    try:
        os.remove(f"{folder}/fail-{page}")
    except FileNotFoundError:
        pass
    else:
        raise OSError("connection reset")
    if os.path.exists(f"{folder}/broken-{page}"):
        return "<html>busy</html>"
    with open(f"{folder}/count") as f:
        n = int(f.read())
    return json.dumps({"count": n, "page_size": SIZE, "products": [{"code": i} for i in range((page - 1) * SIZE, min(n, page * SIZE))]})


def feed(folder, n):
    (folder / "count").write_text(str(n))
    return {"base": f"http://x{folder}", "opener": "tests.test_paged.served", "page_size": str(SIZE), "pause_s": "0.01"}


def pulls(folder):
    got = list(map(int, (folder / "pulls").read_text().split()))
    (folder / "pulls").write_text("")
    return got


def codes(df):
    return sorted(json.loads(r.raw)["code"] for r in df.collect())


def test_batch_pulls_each_page_once(spark, tmp_path):
    spark.dataSource.register(PagedFeed)
    options = feed(tmp_path, 10)
    df = spark.read.format("paged_feed").options(**options).load()
    assert codes(df) == list(range(10))
    assert sorted(pulls(tmp_path)) == [1, 2, 3, 4]
    assert codes(spark.read.format("paged_feed").options(**options, page_start="2", pages="2").load()) == list(range(3, 9))
    feed(tmp_path, 0)
    assert codes(spark.read.format("paged_feed").options(**options).load()) == []


def test_pulls_that_fail_are_tried_again(spark, tmp_path):
    spark.dataSource.register(PagedFeed)
    options = feed(tmp_path, 7)
    for page in (1, 2, 3):
        (tmp_path / f"fail-{page}").touch()
    assert codes(spark.read.format("paged_feed").options(**options).load()) == list(range(7))
    assert sorted(pulls(tmp_path)) == [1, 1, 2, 2, 3, 3]
    (tmp_path / "broken-2").touch()
    with pytest.raises(Exception, match="attempt|Expecting value|JSON"):
        spark.read.format("paged_feed").options(**options, attempts="2").load().collect()
    assert pulls(tmp_path).count(2) >= 2
    with pytest.raises(ValueError):
        Pages(options | {"attempts": "0"}).pull(1)


def test_offsets_count_products(tmp_path):
    r = _StreamReader(feed(tmp_path, 8))
    assert r.initialOffset() == {"at": 0} and r.latestOffset() == {"at": 8}
    assert r.partitions({"at": 0}, {"at": 8}) == [Page(1, 0, 3), Page(2, 0, 3), Page(3, 0, 2)]
    assert r.partitions({"at": 4}, {"at": 5}) == [Page(2, 1, 2)]
    assert r.partitions({"at": 8}, {"at": 8}) == [] and r.partitions({"at": 6}, {"at": 9}) == [Page(3, 0, 3)]
    with pytest.raises(ValueError, match="announced"):
        list(r.read(Page(3, 0, 3)))


def test_stream_stops_and_resumes(spark, tmp_path):
    """A stream that stops between pages and within one, while the feed grows, takes every product once."""
    spark.dataSource.register(PagedFeed)
    options = feed(tmp_path, 4)
    out, ck = f"file://{tmp_path}/out", f"file://{tmp_path}/ck"

    def run(**more):
        df = spark.readStream.format("paged_feed").options(**options, **more).load()
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert codes(spark.read.parquet(out)) == list(range(4))
    run()
    assert codes(spark.read.parquet(out)) == list(range(4))
    feed(tmp_path, 11)
    (tmp_path / "broken-3").touch()  # the stream stops once pages before this one were pulled
    with pytest.raises(Exception):  # noqa: B017
        run(attempts="1")
    feed(tmp_path, 13)
    os.remove(tmp_path / "broken-3")
    pulls(tmp_path)
    run()
    run()
    assert codes(spark.read.parquet(out)) == list(range(13))
    # pages that were taken in whole are not pulled again, but for the count on the first
    assert set(pulls(tmp_path)) <= {1, 2, 3, 4, 5}
