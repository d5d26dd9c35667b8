"""The address source: planned ranges, retries, errors as rows."""

import os
import sys

import pytest

from foliospark.sources import addresses

sys.path.insert(0, os.path.dirname(__file__))


def address(n):
    return f"http://host/{n}/full/full/0/default.jpg"


@pytest.mark.parametrize("step", [1, 7, 40, 41, 42, 1000, 10**6])
def test_every_line_is_in_one_range(tmp_path, step):
    (tmp_path / "a.txt").write_text("\n".join(address(n) for n in range(9)) + "\n\n  \n")
    (tmp_path / "b.txt").write_text(address(9))
    (tmp_path / "_log").write_text("x")
    (tmp_path / "empty.txt").write_text("")
    reader = addresses.Reader({"path": str(tmp_path), "rangeBytes": str(step)})
    assert sorted(x for p in reader.partitions() for x in reader._addresses(p)) == sorted(address(n) for n in range(10))


def test_nothing_to_read(tmp_path):
    reader = addresses.Reader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    assert list(reader.read(part)) == []


def test_retries_and_errors(tmp_path, monkeypatch):
    monkeypatch.setenv("FETCH_DIR", str(tmp_path))
    tried = lambda n, retries: addresses.Reader({"path": "/x", "wait": "0", "retries": str(retries)})._row(address(n), __import__("fetchers").flaky)
    assert tried(3, 1) == {"address": address(3), "height": None, "width": None, "content": None, "error": "OSError: busy"}
    assert tried(4, 2) == {"address": address(4), "height": 4, "width": 5, "content": b"image 4", "error": None}
    assert tried(7, 5)["error"].startswith("FileNotFoundError")
    assert "not an http address" in addresses.Reader({"path": "/x", "retries": "0"})._row("ftp://x/default.jpg", addresses.fetch_url)["error"]


def test_read_by_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", os.path.dirname(__file__))
    (tmp_path / "a.txt").write_text("\n".join(address(n) for n in range(1, 30)))
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "fetchers.py"))
    df = addresses.read_addressed_images(spark, str(tmp_path), fetcher="fetchers:fake", retries=0, rangeBytes=200)
    assert df.rdd.getNumPartitions() > 3
    rows = {r.address: r for r in df.collect()}
    assert set(rows) == {address(n) for n in range(1, 30)}
    for n in range(1, 30):
        r = rows[address(n)]
        assert (r.error is None) == (n % 7 > 0) and (r.height, r.width) == ((n, n + 1) if n % 7 else (None, None))
        assert (bytes(r.content) if r.content else None) == (f"image {n}".encode() if n % 7 else None)
    assert addresses.addressed_sizes(df).count() == 25
    sizes = addresses.read_addressed_images(spark, str(tmp_path), fetcher="fetchers:fake", retries=0, content=False)
    assert sizes.where("content is not null").count() == 0
