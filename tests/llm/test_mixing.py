"""Targets by hand, roundings that keep words and expectations."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from millrace.llm import mixing

from .conftest import collected, odd_rows


def by_hand(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ones, left = {}, list(names), sum(sizes.values())
    while open_ones:
        shares = {s: left * weight[s] / sum(weight[o] for o in open_ones) for s in open_ones}
        over = [s for s in open_ones if shares[s] > most * sizes[s]]
        if not over:
            return target | shares
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_ones.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, None: 900, "d": 30}, {"x": 7}, {"b": 0, "a": 12}, {"é": 4, "z": 400, "Z": 1, "": 2}])
def test_targets(spark, sizes):
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes.items())]
    found = mixing.targets(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    target = {r["source"]: r["target"] for r in found.collect()}
    assert target == pytest.approx(by_hand(sizes))
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs):
    assert Counter((r[0], r[1], r[2]) for r in rows) == Counter(docs)
    sizes = Counter()
    for _, source, size in docs:
        sizes[source] += size
    wanted = by_hand(dict(sizes))
    for source, size in sizes.items():
        own = [r for r in rows if r[1] == source]
        assert all(r[3] == size and r[4] == pytest.approx(wanted[source]) for r in own)
        assert all(r[6] == r[5] * r[2] and 0 <= r[5] <= 3 for r in own)
        assert abs(sum(r[6] for r in own) - wanted[source]) <= max(r[2] for r in own)


def test_mix_of_odd_documents(odd, none):
    rows = collected(mixing.mixed(odd))
    check(rows, [(r[0], r[3], words(r[1])) for r in odd_rows()])
    assert Counter(rows) == Counter(collected(mixing.mixed(odd.repartition(7))))
    assert collected(mixing.mixed(none)) == [] == collected(mixing.repeated(none))


def test_a_large_source_goes_through_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 10)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    draw = random.Random(1)
    docs = [(i, "abcdef"[draw.choice((0, 0, 0, 1, 2, 3, 4, 5))], " w" * draw.choice((1, 3, 20, 21, 22, 25, 300))) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = collected(mixing.mixed(df))
    check(rows, [(i, s, words(t)) for i, s, t in docs])
    # A bucket's last document may miss by its own size; all buckets together do not.
    for source in "abcdef":
        own = [r for r in rows if r[1] == source]
        assert sum(r[6] for r in own) == pytest.approx(own[0][4], rel=0.05)


def test_rows_are_repeated_with_all_columns(odd):
    copies = Counter(tuple(r) for r in mixing.repeated(odd).collect())
    assert mixing.repeated(odd).columns == odd.columns
    decided = Counter()
    for doc_id, source, size, _, _, n, _ in collected(mixing.mixed(odd)):
        decided[doc_id, source, size] += n
    by_key = Counter()
    for row, n in copies.items():
        by_key[row[0], row[3], words(row[1])] += n
    assert +by_key == +decided and set(copies) <= {tuple(r) for r in odd_rows()}


def test_meetings_keep_words_and_expectations():
    draw = random.Random(2)
    for _ in range(300):
        a, b, p, q = draw.randrange(1, 50), draw.randrange(1, 50), draw.random(), draw.random()
        up, down = min(a - p * a, q * b), min(p * a, b - q * b)
        chance = down / (up + down)
        first, second = mixing.meet(p, a, q, b, 0.0), mixing.meet(p, a, q, b, 1 - 1e-12)
        for x, y in (first, second):
            assert x * a + y * b == pytest.approx(p * a + q * b)
            assert min(abs(x), abs(1 - x), abs(y), abs(1 - y)) < 1e-9 and -1e-9 <= min(x, y) and max(x, y) <= 1 + 1e-9
        assert chance * first[0] + (1 - chance) * second[0] == pytest.approx(p)
        assert chance * first[1] + (1 - chance) * second[1] == pytest.approx(q)
