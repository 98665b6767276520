"""Periodic runs, the prefix trie and the grid order join against brute force, on odd rows too."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import grid_order, periodic, prefix_trie

from .conftest import COLUMNS, collected, odd_rows


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- periodic runs


def all_runs(words: list) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            smallest = all(any(x != y for x, y in zip(own, own[d:], strict=False)) for d in range(1, q))
            if j > i and len(own) >= max(6, 4 * q) and smallest:
                found.append((i, len(own), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    draw = random.Random(3)
    texts = []
    for _ in range(1500):
        words = [draw.choice("abc"[: draw.randint(1, 3)]) for _ in range(draw.randint(0, 50))]
        if words and draw.random() < 0.6:
            a, p = draw.randrange(len(words)), draw.randint(1, 9)
            words[a:] = [words[a + (i - a) % p] for i in range(a, len(words))]
        if words and draw.random() < 0.3:
            words[draw.randrange(len(words))] = "x"
        texts.append(" ".join(words).encode())
    number = 0
    for text, (words, found) in zip(texts, periodic.of_texts(texts), strict=True):
        assert words == text.split() and found == all_runs(words)
        number += len(found)
    assert number > 500


def test_one_extension_per_run_of_any_length():
    words = np.concatenate([np.arange(7), np.zeros(300_000, dtype=np.int64), np.tile(np.arange(50), 4000), np.arange(100, 300)])
    assert periodic.runs(words) == all_found(words)


def all_found(words) -> list[tuple[int, int, int]]:
    # The 0 at the end of the first run begins the second one, whose period also holds it.
    return [(7, 300_001, 1), (300_007, 200_000, 50)]


def expected_digests(doc_id, text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = all_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *shown, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_digests_of_odd_rows(spark, odd):
    draw = random.Random(8)
    more = [(1000 + i, " ".join(draw.choice(("a", "b c", "d\te", "ü")) for _ in range(draw.randint(0, 80)))) for i in range(120)]
    more += [(2000, "la " * 9), (2001, "x y x y x y x y"), (None, "no " * 7)]
    every = odd_rows() + [(i, t, None, None, 0, "clash", 1, 2, "p", 3) for i, t in more]
    docs = [(r[0], r[1]) for r in every if len(r[1] or "") < 50_000]
    some = spark.createDataFrame([r for r in every if len(r[1] or "") < 50_000], COLUMNS).repartition(3)
    out = periodic.digests(some)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(collected(out), key=repr) == sorted((expected_digests(*d) for d in docs), key=repr)
    assert periodic.periodic(odd).count() == odd.count()


def test_runs_of_no_documents(none):
    assert collected(periodic.digests(none)) == []


# -- the trie


def brute_trie(sequences: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for c, own in sequences.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        here = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = here + sum(saved[c] for c in children[path])
    out = []
    for path, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(own), len(path), parent, len(own), len(children[path]), leaves[path], saved[path], sha(ends)))
    return out


def conversation_rows() -> list[tuple]:
    draw = random.Random(4)
    rows = []
    for c in [*range(0, 60), *range(95, 130), 200, 201, 305, 377, -1, -100, -150]:
        for turn in range(draw.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c, turn if draw.random() < 0.9 else None, draw.choice(("user", None, "bot")), draw.choice(("a", "bb", "", None, "ünï", "long text"))))
    rows += [(7, t, "user", "same") for t in range(300)] + [(8, t, "user", "same") for t in range(300)]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None), (50, 1, "user", "a"), (50, 1, "user", "a")]
    return [(*r, "clash", 1) for r in rows]


CONVERSATIONS = "conv_id long, turn long, role string, text string, TEXT string, part int"


def ordered(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(own)] for c, own in by.items()}


def rebuilt(own: dict[int, list]) -> dict[int, list]:
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def test_trie_of_odd_rows(spark):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    out = prefix_trie.rebuilt_trie(table)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(collected(out), key=repr) == sorted(brute_trie(rebuilt(ordered(rows))), key=repr)


@pytest.mark.parametrize(("cells", "most"), [(4, 2), (4, 64), (1, 1 << 20)])
def test_estimates_that_are_too_high_change_nothing(spark, monkeypatch, cells, most):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, CONVERSATIONS)
    screened = prefix_trie.screened
    monkeypatch.setattr(prefix_trie, "screened", lambda local: screened(local, cells, most))
    out = prefix_trie.trie(*prefix_trie.plain(table))
    assert sorted(collected(out), key=repr) == sorted(brute_trie(ordered(rows)), key=repr)


def test_tails_are_not_shuffled(spark):
    rows = [(c, t, "user", f"{c} {t}" if t else "hello") for c in range(40) for t in range(30)]
    local = prefix_trie.prefixes(prefix_trie.plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))[0])
    own = dict(collected(prefix_trie.screened(local).groupBy("d").agg(F.count(F.when(F.col("own"), 1)))))
    assert own[1] == own[2] == 0 and sum(own.values()) > 0.9 * 40 * 28


def test_a_hot_conversation_is_summed_in_pieces(spark):
    rows = [(5, t, "user", "x" * (t % 3)) for t in range(4000)] + [(6, t, "user", "x" * (t % 3)) for t in range(3999)] + [(4, 0, "", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    of, conversations = prefix_trie.plain(table)
    local = prefix_trie.prefixes(of)
    assert local.select("part").distinct().count() > 1 and prefix_trie.carries(local)
    assert sorted(collected(prefix_trie.trie(of, conversations)), key=repr) == sorted(brute_trie(ordered(rows)), key=repr)


def test_trie_without_turns(spark):
    table = spark.createDataFrame([], CONVERSATIONS)
    assert collected(prefix_trie.rebuilt_trie(table)) == []
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 3)
    table = spark.createDataFrame([(alone, 0, "user", "gone", "", 1)], CONVERSATIONS)
    assert collected(prefix_trie.rebuilt_trie(table)) == [(alone, 0, None, 1, 0, 1, 0, sha(str(alone)))]


# -- near vectors


def vector_rows() -> list[tuple]:
    draw = np.random.default_rng(2)
    rows = []
    for center in draw.normal(size=(6, 16)):
        for _ in range(12):
            rows.append(center + draw.normal(size=16) * draw.choice([0.0, 0.1, 0.3, 0.5]))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    # A chain each link of which is just above the bound, and one just below it.
    for k in range(8):
        angle = k * np.arccos(0.9000001)
        rows.append((100 + k, [0.0, float(np.cos(angle)), float(np.sin(angle))]))
        angle = k * np.arccos(0.8999999)
        rows.append((200 + k, [float(np.cos(angle)), float(np.sin(angle))]))
    rows += [
        (300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [float("inf")] + [1.0] * 15), (305, [None] + [1.0] * 15),
        (306, [-0.0, 1.0]), (307, [0.0, 5.0]), (308, [0.0, 5.0]), (309, [1e200, 1e200]), (None, [0.0, 5.0]), (None, None), (3, [3.0, 4.0]), (3, [4.0, 3.0]),
        (3, [4.0, 3.0]),
    ]
    return [(*r, "clash", 1, 2, 3) for r in rows]


VECTORS = "vec_id long, embedding array<double>, EMBEDDING string, row int, n int, part int"


def brute_links(rows: list[tuple]) -> list[tuple]:
    def sound(r):
        return r[0] is not None and r[1] and None not in r[1] and all(np.isfinite(r[1])) and 0 < sum(x * x for x in r[1]) < 1e300

    good = [r for r in rows if sound(r)]
    near = defaultdict(list)
    for i, a in enumerate(good):
        for j, b in enumerate(good):
            if i != j and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.9:
                    near[i].append(j)
    out = [(r[0], 0, r[0], True) for r in rows if not sound(r)]
    for i, a in enumerate(good):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(good[j][0] for j in seen)
        out.append((a[0], len(near[i]), least, a[0] == least))
    return out


def test_near_vectors_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(grid_order.blocks, "__defaults__", (5,))
    rows = vector_rows()
    out = grid_order.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    expected = brute_links(rows)
    assert sorted(collected(out), key=repr) == sorted(expected, key=repr)
    assert sum(r[1] for r in expected) > 100 and len({r[2] for r in expected if 100 <= (r[0] or 0) < 108}) == 1


def test_no_vectors(spark):
    assert collected(grid_order.near_duplicates(spark.createDataFrame([], VECTORS))) == []
    rows = [(1, None, "", 1, 1, 1)]
    assert collected(grid_order.near_duplicates(spark.createDataFrame(rows, VECTORS))) == [(1, 0, 1, True)]


def test_distant_blocks_are_skipped(spark):
    draw = np.random.default_rng(5)
    rows = []
    for k in range(8):
        center = np.zeros(8)
        center[k] = 1
        rows += [(100 * k + i, [float(x) for x in center + draw.normal(size=8) * 0.01]) for i in range(40)]
    table = grid_order.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumnRenamed("row", "node")
    distinct = table.select("embedding", "node", F.lit(1).cast("bigint").alias("weight"))
    epsilon = float(np.sqrt(0.2))
    order = ["size", *[F.col("cells")[k] for k in range(grid_order.AXES)], "node"]
    sequence = grid_order.blocks(grid_order.in_order(grid_order.placed(distinct, grid_order.axes(distinct), epsilon), *order), 10)
    n = sequence.count()
    pairs = grid_order.near_blocks(sequence, epsilon)
    assert n >= 32 and pairs.count() < n * (n + 1) / 4
    found = grid_order.matches(sequence, pairs, 0.9).groupBy("node").agg(F.sum("n")).collect()
    assert len(found) == 320 and {r[1] for r in found} == {39}
