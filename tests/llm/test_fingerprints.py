"""SimHash grids and block tables against plain loops over all pairs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import xxhash

import corpus_pipeline
from millrace import storage
from millrace.llm import common, simhash_grid, simhash_tables
from millrace.llm.common import components

from .conftest import collected, odd_rows


def classes(items: list, linked) -> dict:
    root = {i: i for i in range(len(items))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def shingled(text: str | None) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_grid_components(odd):
    rows = odd_rows()
    fps = [shingled(r[1]) for r in rows]
    root = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(r[0], least.get(root[i], r[0]))
    expected = Counter((r[0], f"{fps[i]:016x}", least.get(root[i])) for i, r in enumerate(rows))
    assert Counter(collected(simhash_grid.near_duplicates(odd))) == expected


def test_links_join_what_is_two_bits_apart(spark):
    draw = random.Random(3)
    fps = {0, 2**63, 2**64 - 1}
    for _ in range(40):
        at = draw.getrandbits(64)
        for _ in range(draw.randrange(12)):
            fps.add(at)
            for _ in range(draw.randrange(5)):
                at ^= 1 << draw.randrange(64)
    items = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in items]
    df = spark.createDataFrame([(f,) for f in signed + signed[:5]], "fp long")
    rooted = dict(collected(simhash_grid.groups(df).select("fp", "root")))
    root = classes(items, lambda a, b: (a ^ b).bit_count() <= 2)
    groups: dict = {}
    for i, f in enumerate(signed):
        groups.setdefault(root[i], set()).add(f)
    assert len(groups) < len(items)
    found: dict = {}
    for f, r in rooted.items():
        found.setdefault(r, set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_one_of_each_group_stays(odd, none):
    kept = simhash_grid.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = collected(kept)
    fps = [shingled(r[1]) for r in odd_rows()]
    root = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(rows) == len(set(root.values()))
    assert Counter(rows) <= Counter(tuple(r) for r in odd_rows())
    assert collected(simhash_grid.one_of_each(none)) == [] == collected(simhash_grid.near_duplicates(none))


def test_pipeline_leaves_one_of_texts_with_most_sets_of_words_in_common(spark):
    draw = random.Random(12)
    texts, groups = [], []
    for g in range(30):
        words = [f"w{draw.randrange(10**5)}" for _ in range(draw.choice((60, 150, 400)))]
        for _ in range(4):
            own = list(words)
            own[draw.randrange(5, len(own) - 5)] = f"new{draw.randrange(10**6)}"
            texts.append(" ".join(own))
            groups.append(g)
    texts += ["a few words", "a few words more", None, ""]
    docs = [(i, t) for i, t in enumerate(texts)]
    fps = [shingled(t) for t in texts]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (t or "" for t in texts)]
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2 or len(sets[i] & sets[j]) >= 0.8 * max(1, len(sets[i] | sets[j]))
    root = classes(list(range(len(docs))), near)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, df, "").collect()}
    assert kept == set(root.values())
    assert len(kept) < len(collected(simhash_grid.one_of_each(df)))


def test_texts_of_the_near_dedup_go_before_its_result_is_written(spark):
    docs = spark.createDataFrame([(i, f"some words that are all the same but for {i // 2}") for i in range(20)], "doc_id long, text string")
    before = len(storage._PATHS)
    kept = simhash_grid.one_of_each(docs, by_words=True)
    assert not [p for p in storage._PATHS[before:] if "/documents-" in p]
    assert 0 < kept.count() <= 10


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 600), (600, 500), (7, 7), (600, 700)]
    found = dict(collected(components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {i: 0 for i in range(201)} | {500: 500, 600: 500, 700: 500}
    assert collected(components(spark.createDataFrame([], "a long, b long"))) == []


def test_components_of_near_copies_take_few_jobs(spark, monkeypatch):
    made, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, label: made.append(label) or stored(df, label))
    near = [(i, i % 3) for i in range(3, 900)] + [(i, 0) for i in range(1, 900, 7)]
    found = dict(collected(components(spark.createDataFrame(near + [(1, 0), (2, 0)], "a long, b long").repartition(4))))
    assert found == dict.fromkeys(range(900), 0) and len(made) <= 2


def test_components_of_links_in_many_batches(spark):
    draw = random.Random(17)
    nodes = draw.sample(range(-(10**15), 10**15), 300)
    edges = [tuple(draw.sample(nodes, 2)) for _ in range(200)] + list(zip(nodes[:60], nodes[1:60], strict=False))
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(size)
    spark.conf.set(size, "2")
    try:
        assert dict(collected(components(spark.createDataFrame(edges, "a long, b long")))) == root
    finally:
        spark.conf.set(size, usual)


def voted(text: str) -> int:
    votes, total = [0] * 64, 0
    for word in re.split("[ \t\n\x0b\x0c\r]", text):
        h, w = xxhash.xxh64_intdigest(word.encode(), 42), min(len(word), 12) ** 2
        total += w
        for b in range(64):
            votes[b] += w * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def test_fingerprints_of_edited_texts(odd):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    fps = [voted(t) for _, t in rows]
    expected = Counter()
    for i, (doc_id, text) in enumerate(rows):
        j, half = (i + 1) % len(rows), len(text) // 2
        edited = text[: len(text) - half] + rows[j][1][:half]
        own, other = fps[i], voted(edited)
        near = sum((own ^ f).bit_count() <= 3 for f in fps) - 1 if doc_id is not None and doc_id % 20 == 0 else None
        expected[
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:016x}", f"{other:016x}",
            1 - (own ^ other).bit_count() / 64, 1 - (own ^ fps[j]).bit_count() / 64, near,
        ] += 1
    assert Counter(collected(simhash_tables.fingerprinted(odd))) == expected


def test_fingerprints_of_few_documents(spark, none):
    assert collected(simhash_tables.fingerprinted(none)) == []
    alone = collected(simhash_tables.fingerprinted(spark.createDataFrame([(20, "abcd efg")], "doc_id long, text string")))
    assert [(r[0], r[1], r[6], r[7]) for r in alone] == [(20, 8, 1.0, 0)]


def test_fingerprints_use_no_python(odd):
    text = simhash_tables.compared(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_tables_find_all_within_the_radius(spark):
    draw = random.Random(5)
    fps = [draw.getrandbits(64) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(6))) for f in fps for _ in range(8)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for radius in (0, 1, 3):
        found = dict(collected(simhash_tables.near_counts(df, df, radius)))
        assert found == {s: sum((f ^ g).bit_count() <= radius for g in fps) for f, s in zip(fps, signed, strict=True)}
