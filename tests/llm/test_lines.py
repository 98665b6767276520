"""Line runs and passages against plain searches."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import line_runs, passages

from .conftest import ENGLISH, collected, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cleaned(docs: list[tuple], least: int) -> list[tuple]:
    """Texts in order without the lines of maximal repeated runs that stand further ahead, found by walking along equal lines."""
    lines, places, at = [], [], defaultdict(list)
    for d, (_, text) in enumerate(docs):
        for i, line in enumerate(text.split("\n") if text is not None else []):
            if WORD.search(line):
                at[line].append(len(lines))
                lines.append(line)
                places.append((d, i))
    gone = set()
    inside = lambda a, b: 0 <= a and b < len(lines) and lines[a] == lines[b]
    for same in at.values():
        for k, b in enumerate(same):
            for a in same[:k]:
                if inside(a - 1, b - 1) and places[a - 1][0] == places[a][0] and places[b - 1][0] == places[b][0]:
                    continue
                n = 0
                while inside(a + n, b + n) and places[a + n][0] == places[a][0] and places[b + n][0] == places[b][0]:
                    n += 1
                if sum(len(WORD.findall(line)) for line in lines[b : b + n]) >= least:
                    gone |= set(places[b : b + n])
    out = []
    for d, (doc_id, text) in enumerate(docs):
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in gone)
        out.append((doc_id, kept, sum(p[0] == d for p in places), sum(g[0] == d for g in gone)))
    return out


@pytest.mark.parametrize("words", [1, 3, 10])
def test_line_runs(spark, words):
    draw = random.Random(words)
    stock = [f"{'w' * (i % 4 + 1)} {i}" if i % 3 else f"single{i}" for i in range(12)] + ["", "  \t", "a long line of rather more than ten words in a row"]
    docs = [(i, "\n".join(draw.choices(stock, k=draw.randrange(14)))) for i in range(60)] + [(70, None), (71, ""), (72, "\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = collected(line_runs.without_copies(df, words).orderBy("doc_id"))
    assert found == cleaned(docs, words)


def whole_runs(docs: list[tuple], least: int) -> list[tuple]:
    """Texts without any line of a run, of whatever length, that stands further ahead already."""
    lines, places = [], []
    for d, (_, text) in enumerate(docs):
        own = [(i, line) for i, line in enumerate(text.split("\n")) if WORD.search(line)]
        lines += [line for _, line in own]
        places += [(d, i) for i, _ in own]
    seen, gone = set(), set()
    for a, (d, _) in enumerate(places):
        for b in range(a + 1, len(lines) + 1):
            if places[b - 1][0] != d:
                break
            run = "\n".join(lines[a:b])
            if len(WORD.findall(run)) >= least:
                gone |= set(places[a:b]) if run in seen else set()
                seen.add(run)
    return [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, (i, t) in enumerate(docs)]


@pytest.mark.parametrize("words", [1, 3, 10])
def test_all_lines_of_repeated_runs_go(spark, words):
    draw = random.Random(20 + words)
    stock = [f"{'w ' * (i % 4)}{i}" for i in range(9)] + ["", "a long line of rather more than ten words in a row"]
    ending = "ten words are in this first line of the run\nthree more words\nand two"
    docs = [(i, "\n".join(draw.choices(stock, k=draw.randrange(14)))) for i in range(60)]
    docs += [(70, ending), (71, f"own\n{ending}"), (72, f"{ending}\nother lines"), (73, ending)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = collected(line_runs.without_copies(df, words).select("doc_id", "text").orderBy("doc_id"))
    assert found == whole_runs(docs, words)
    assert found[-1] == (73, "") and found[-3] == (71, "own")


def test_line_runs_of_odd_documents(odd, none):
    out = line_runs.without_copies(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    rows = collected(out)
    order = sorted(odd_rows(), key=lambda r: (r[0] is None, r[0] or 0))
    # Of rows with one id any may come first; their texts together are the same.
    expected = Counter((r[0], r[1]) for r in cleaned([(r[0], r[1]) for r in order], 10) if r[0] not in (3, None))
    assert Counter((r[0], r[1]) for r in rows if r[0] not in (3, None)) == expected
    assert len(rows) == len(order) and Counter(r[2:10] for r in rows) == Counter(r[2:] for r in order)
    assert collected(line_runs.without_copies(none)) == []


def test_ranks_are_the_suffix_array(spark):
    text = [random.Random(4).choice("abc") for _ in range(60)] + list("abcabcabcabc")
    rows = [(i, len(text), ord(c), 0) for i, c in enumerate(text)]
    numbered = spark.createDataFrame(rows, "at long, end long, h1 long, h2 long")
    for k, level in enumerate(line_runs.suffix_ranks(numbered, 8)):
        blocks = {i: "".join(text[i : i + 2**k]) for i in range(len(text) - 2**k + 1)}
        count = Counter(blocks.values())
        found = {r["at"]: r["rank"] for r in level.collect()}
        assert set(found) == {i for i, b in blocks.items() if count[b] > 1}
        assert all((found[i] < found[j]) == (blocks[i] < blocks[j]) and (found[i] == found[j]) == (blocks[i] == blocks[j]) for i in found for j in found)


def repeated_paragraphs(texts: dict) -> dict:
    """``(id, start) -> class`` by comparing all paragraphs with all."""
    found = []
    for doc_id, text in texts.items():
        for m in re.finditer(r"(?s).+?(?:[.!?]+[ \t\r\n]+|\n[ \t\r\n]*|\Z)", text or ""):
            words = m[0].lower().split()
            if len(words) >= 5:
                found.append((doc_id, m.start(), words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, _, w in found]
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(found)):
        for j in range(i):
            if found[i][2] == found[j][2] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    size = Counter(find(i) for i in range(len(found)))
    return {found[i][:2]: find(i) for i in range(len(found)) if size[find(i)] > 1}


def near_texts() -> dict:
    draw = random.Random(11)
    base = [" ".join(prose(ENGLISH, 60, s).replace(".", "").split()).capitalize() + ". " for s in range(6)]
    texts = {}
    for i in range(60):
        parts = []
        for s in draw.sample(range(6), 2):
            words = base[s].split()
            for _ in range(draw.randrange(3)):
                words[draw.randrange(1, len(words) - 1)] = f"new{draw.randrange(10**6)}"
            parts.append(" ".join(words))
        texts[i] = "Own opening words " + str(i) + " here we go. " + " ".join(parts)
    return texts


def found_classes(df) -> list:
    parts = passages.units(df)
    roots = {r["node"]: r["root"] for r in passages.links(parts, passages.long_texts(df)).collect()}
    found = defaultdict(set)
    for r in parts.collect():
        found[roots.get(r["low"], r["low"])].add((r["doc_id"], r["start"]))
    return sorted(sorted(v) for v in found.values() if len(v) > 1)


def test_short_sentences_with_a_word_more_are_similar(spark):
    draw = random.Random(6)
    texts = {}
    for i in range(60):
        words = [f"w{draw.randrange(10**6)}" for _ in range(5 + i % 9)]
        texts[2 * i] = " ".join(words) + "\n"
        texts[2 * i + 1] = " ".join([*words, "more"] if i % 2 else ["more", *words]) + "\n"
    texts |= {200: "a a a a a a\n", 201: "a a a a a\n", 202: "x y x y x y\n", 203: "x y x y x y x\n"}
    wanted = defaultdict(set)
    for place, k in repeated_paragraphs(texts).items():
        wanted[k].add(place)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len(wanted) > 30 and found_classes(df) == sorted(sorted(v) for v in wanted.values())


def test_passages_are_all_that_repeat(spark):
    texts = near_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = repeated_paragraphs(texts)
    parts = passages.units(df)
    roots = {r["node"]: r["root"] for r in passages.links(parts, passages.long_texts(df)).collect()}
    found = defaultdict(set)
    for r in parts.collect():
        found[roots.get(r["low"], r["low"])].add((r["doc_id"], r["start"]))
    wanted = defaultdict(set)
    for place, k in expected.items():
        wanted[k].add(place)
    got = sorted(sorted(v) for v in found.values() if len(v) > 1)
    assert sum(map(len, got)) >= 0.99 * len(expected)
    assert got == sorted(sorted(v) for v in wanted.values())
    rows = collected(passages.repeats(df))
    first = min(texts)
    assert {r[0] for r in rows} == {d for d, _ in expected} and not any(r[4] for r in rows if r[0] == first)
    for doc_id, start, end, words, *_ in rows:
        assert words >= passages.LEAST and 0 <= start < end <= len(texts[doc_id])


def test_planted_passages_are_found_and_clean_texts_left(spark):
    draw = random.Random(8)
    texts = {i: prose(ENGLISH, 200, 1000 + i) for i in range(60)}
    planted = set()
    for k in range(10):
        passage = " ".join(prose(ENGLISH, 63, 5000 + k).split())
        for i in range(3 * k, 3 * k + 3):
            words = texts[i].split(" ")
            at = draw.randrange(len(words))
            texts[i] = " ".join([*words[:at], passage, *words[at:]])
            planted.add(i)
    rows = collected(passages.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {r[0] for r in rows} == planted and Counter(r[0] % 3 == 0 for r in rows if not r[4])[True] >= 10


def test_near_copies_meet_in_a_few_bands_only(spark, monkeypatch):
    draw, met = random.Random(5), []
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(words[:k] + [f"own{i}"] + words[k + 1 :])) for i in range(60) for k in [draw.randrange(200)]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counted = passages._met

    def noted(members, leaders):
        met.append(members.count())
        return counted(members, leaders)

    monkeypatch.setattr(passages, "_met", noted)
    roots = passages.links(passages.units(df).select("low", "bands"), passages.long_texts(df))
    assert len({r["root"] for r in roots.collect()}) == 1 and roots.count() == 60
    assert sum(met) <= 60 * passages.TRIAL + 60 < 60 * passages.bands(passages.SECOND)[0] / 4


def test_variants_that_are_not_similar_do_not_become_pairs(spark, monkeypatch):
    draw, made = random.Random(11), []
    words = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(words[:k] + [f"own{i}"] + words[k + 1 :]) for i in range(150) for k in [draw.randrange(40)]}
    # These two differ from the others alike, and from each other in the last word; Python parts words at the blank of the last two.
    texts |= {200: " ".join([*words[:20], "a", "b", *words[22:]]), 201: " ".join([*words[:20], "a", "b", *words[22:39], "last"])}
    texts |= {300: " ".join([*words[:9], "c\u2003d", *words[10:30]]), 301: " ".join([*words[:9], "c", "d", *words[10:30]])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    counted = passages._met

    def noted(members, leaders):
        pairs = counted(members, leaders)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(passages, "_met", noted)
    classes = found_classes(df)
    wanted = defaultdict(set)
    for place, k in repeated_paragraphs(texts).items():
        wanted[k].add(place)
    assert classes == sorted(sorted(v) for v in wanted.values()) and any((200, 0) in c and (201, 0) in c for c in classes)
    assert sum(made) <= 3 * len(texts)


def test_copies_in_a_slice_are_one_long_text(spark):
    line, other = ("\n".join(" ".join(f"{c}{i}" for i in range(12)) for c in cs) for cs in ("ab", "bc"))
    df = spark.createDataFrame([(i, line if i % 3 else other) for i in range(90)], "doc_id long, text string").coalesce(1)
    found = collected(passages.long_texts(df))
    parts = collected(passages.units(df).select("low").distinct())
    assert len(found) == 3 == len({t for _, t in found}) and {low for low, _ in found} == {low for (low,) in parts}


def test_later_links_join_classes_and_not_their_paragraphs(spark, monkeypatch):
    draw, similar, handed = random.Random(13), [], []
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(words[:k] + [f"own{i}"] + words[k + 1 :]) for i in range(120) for k in [draw.randrange(60)]}
    linked, components = passages._linked, passages.components

    def noted(pairs, all_texts):
        found = linked(pairs, all_texts)
        similar.append(found.count())
        return found

    monkeypatch.setattr(passages, "_linked", noted)
    monkeypatch.setattr(passages, "components", lambda edges: handed.append(edges.count()) or components(edges))
    classes = found_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    wanted = defaultdict(set)
    for place, k in repeated_paragraphs(texts).items():
        wanted[k].add(place)
    assert classes == sorted(sorted(v) for v in wanted.values())
    assert len(handed) > 1 and handed == [n for n in similar if n]


def test_sketches_differ_in_no_more_bits_than_sets():
    draw = random.Random(12)
    lists = [[f"w{draw.randrange(6)}" for _ in range(5 + i)] for i in range(60)]
    words, bounds = passages._words(pa.array([" ".join(w) for w in lists], pa.large_string()))
    sets, sketch = passages._sketches(words, bounds[:-1], np.diff(bounds))
    own = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lists]
    assert list(sets) == [len(s) for s in own]
    for i in range(60):
        for j in range(i):
            bits = sum(int(a ^ b).bit_count() for a, b in zip(sketch[i], sketch[j], strict=True))
            assert bits <= len(own[i] ^ own[j]) and bits % 2 == len(own[i] ^ own[j]) % 2


def test_passages_of_short_sentences(spark):
    draw = random.Random(9)
    short = lambda n: "".join(f"w{draw.randrange(10**6)}" + ("!! " if k % 4 else "\n") for k in range(n))
    copied, poem = short(150), short(26)
    stock = [f"s{k}!! " for k in range(30)]
    texts = {1: copied, 2: copied, 3: short(40) + poem + short(40), 4: "Own words of a line here.\n" + short(43) + poem + short(12)}
    texts |= {i: "".join(draw.choices(stock, k=100)) for i in range(10, 30)}
    texts |= {40: "one two three four five. No. six seven eight nine ten. Yes! " + " ".join(f"z{k}" for k in range(14)) + "."}
    texts[41] = texts[40]
    rows = collected(passages.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    later = {r[0]: r for r in rows if r[4]}
    assert set(later) == {2, 4, 41} and {r[0] for r in rows} == {1, 2, 3, 4, 40, 41}
    assert later[2][1:4] == (0, len(copied), 150) and later[41][3] == 24 + 2
    at = texts[4].index(poem)
    assert texts[4][later[4][1] : later[4][2]] == poem and later[4][1:4] == (at, at + len(poem), 26)


def test_passages_of_odd_documents(odd, none):
    rows = collected(passages.repeats(odd))
    assert {r[0] for r in rows if r[4]} >= {3, 60}
    assert collected(passages.repeats(none)) == []


def test_bands_find_pairs_at_the_threshold():
    for most in (passages.FIRST, passages.SECOND):
        count, size = passages.bands(most)
        assert count <= most and 1 - (1 - passages.SIMILAR**size) ** count >= 1 - passages.MISS
