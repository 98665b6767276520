"""WARC files read back byte by byte, and searches against all scores."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from millrace.llm import kd_search, warc

from .conftest import collected

PAGES = [
    (5, "http://a/5", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (9, "http://a/9b", "<p>same</p>"),
    (1, "http://a/é b\r\nx", "own ünï\x00 \r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (3, "u", None), (4, "u", ""),
    (None, "u", "<p>same</p>"), (None, "u", "alone"), (7, "u", "x" * 3_000_000), (8, "u", "y"),
]
KIND = "page_id long, url string, html string, HTML string, path string, row int"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", "p", 1) for p in PAGES], KIND).repartition(3).cache()


def expected(least: int):
    groups: dict = {}
    for page_id, _, html in PAGES:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = Counter()
    for payload, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        order = sorted(ids, key=lambda i: (i is None, i))
        for n, page_id in enumerate(order):
            revisit = n > 0 and len(payload) >= least
            out[page_id, len(payload), digest, "revisit" if revisit else "response", first if revisit else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_pages_come_back(pages, least):
    assert Counter(collected(warc.archived(pages, least))) == expected(least)


def test_no_pages_no_files(spark):
    assert collected(warc.archived(spark.createDataFrame([], KIND))) == []


def test_archives_become_members(pages, tmp_path):
    whole = warc.write(pages, f"file://{tmp_path}/whole", archive_bytes=500)
    assert whole.count() > 3
    files = collected(warc.normalise(whole, f"file://{tmp_path}/records"))
    assert sum(n for *_, n in files) == len(PAGES)
    local = lambda uri: Path(uri.removeprefix("file://"))
    bodies = Counter()
    for path, index, n in files:
        data = local(path).read_bytes()
        entries = [json.loads(line) for line in local(index).read_text().splitlines()]
        assert len(entries) == n and sum(e["length"] for e in entries) == len(data)
        for e in entries:
            member = gzip.decompress(data[e["offset"] : e["offset"] + e["length"]])
            fields, _ = warc.parse(member)
            assert fields["warc-type"] == e["type"] and member.endswith(b"\r\n\r\n")
            bodies[member] += 1
    assert bodies == Counter(r for (path,) in collected(whole) for r in warc.records(iter([gzip.decompress(local(path).read_bytes())])))


def test_records_come_in_any_pieces():
    whole = b"".join(warc.page_record(i, "u", b"payload " * i, None, False) for i in range(5))
    for size in (1, 7, 1000):
        found = list(warc.records(whole[i : i + size] for i in range(0, len(whole), size)))
        assert b"".join(found) == whole and len(found) == 5
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(iter([whole[:-1]])))


def brute(rows, every, k):
    good = []
    for n, (vec_id, v) in enumerate(rows):
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((n, vec_id, [int(np.floor(np.float32(x).astype(float) * 1024)) for x in v]))
    out = Counter()
    for n, query, q in good:
        if query % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for m, i, v in good if m != n and len(v) == len(q))
            for rank, (score, i) in enumerate(scored[:k], 1):
                out[query, rank, i, -score] += 1
    return out


def vectors(seed: int, n: int, dims: int) -> list:
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [c + draw.gauss(0, 0.2) for c in draw.choice(centres)]) for i in range(n)]
    rows += [(i, list(rows[0][1])) for i in range(n, n + 30)]
    rows += [(n + 30, None), (n + 31, [None] * dims), (n + 32, [float("nan")] * dims), (n + 33, [float("inf")] * dims)]
    return [*rows, (None, rows[0][1]), (20, rows[5][1]), (20, rows[5][1]), (n + 35, [1.0]), (40 + 10 * n, [2.0]), (n + 50, [])]


@pytest.mark.parametrize(("seed", "shard"), [(1, 4096), (2, 40)])
def test_search_is_exact(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(kd_search, "LEAF", 8)
    rows = vectors(seed, 300, 6)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, VEC_ID string")
    monkeypatch.setattr(kd_search.trees, "__defaults__", (shard,))
    monkeypatch.setattr(kd_search.query_blocks, "__defaults__", (7,))
    assert Counter(collected(kd_search.top_k(df.repartition(3), every=10, k=10))) == brute(rows, 10, 10)


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert collected(kd_search.top_k(spark.createDataFrame([], kind))) == []
    assert collected(kd_search.top_k(spark.createDataFrame([(100, [1.0, 2.0])], kind))) == []
    few = spark.createDataFrame([(100, [1.0, -2.0]), (3, [0.5, 0.5])], kind)
    assert collected(kd_search.top_k(few)) == [(100, 1, 3, 1024 * 512 - 2048 * 512)]


def test_trees_look_into_few_leaves():
    draw = np.random.default_rng(3)
    own = draw.integers(-1000, 1000, size=(4000, 3))
    tree = kd_search.Tree.load(kd_search.Tree.build(np.arange(4000), np.arange(4000), own).dump())
    seen = []
    leaf = tree.leaf
    tree.leaf = lambda node, query, row: seen.append(node) or leaf(node, query, row)
    for query in own[:20]:
        best = tree.search(query, tree.bounds(query[None, :])[0], -1, 5, None)
        scores = own @ query
        assert [s for s, _ in best] == sorted(scores.tolist(), reverse=True)[:5]
    assert len(seen) < 20 * 64 / 4
