"""Viterbi against trying all paths, and accuracy on documents that were held out."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import language

from .conftest import ENGLISH, FRENCH, collected, odd_rows, prose


def test_best_paths_are_best():
    draw = np.random.default_rng(1)
    sizes = np.array([0, 1, 5, 3, 0, 6, 2, 6])
    scores = draw.normal(size=(sizes.sum(), 3)).astype(np.float32) * 3
    path = language.best_paths(scores, sizes, switch=2.0)
    at = 0
    for n in sizes:
        own = scores[at : at + n]

        def value(states, own=own):
            return sum(own[i, s] for i, s in enumerate(states)) - 2.0 * sum(a != b for a, b in itertools.pairwise(states))

        best = max(map(value, itertools.product(range(3), repeat=n)))
        assert value(path[at : at + n].tolist()) == pytest.approx(best, abs=1e-4)
        at += n


def test_scripts():
    names = [*language._NAMES, "other"]
    found = language.scripts(np.array([ord(c) for c in "aéжλ한日のש1€"]))
    assert [names[i] for i in found] == ["latin", "latin", "cyrillic", "greek", "hangul", "han", "kana", "hebrew", "other", "other"]


def test_words_are_found_in_whole_texts():
    words, index, sizes = language.split(pa.array(["It's  A test", None, "", " 1 2! ", "été\nB", "́ x"]))
    spoken = [words[int(i)].as_py() for i in index]
    assert spoken == ["it", "s", "a", "test", "été", "b", "x"] and sizes.tolist() == [4, 0, 0, 0, 2, 1]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose((ENGLISH, FRENCH)[i % 2], 30 + i % 7, i), ("en", "fr")[i % 2], "s", 0) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_documents_are_told_apart(docs):
    rows = collected(language.identified(docs))
    assert all(held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, held, _, _ in rows)
    held = [(i, lang, score) for i, h, lang, score in rows if h]
    assert 60 < len(held) < 140
    assert np.mean([lang == ("en", "fr")[i % 2] for i, lang, _ in held]) > 0.99 and min(s for *_, s in held) > 0.8


def test_held_out_labels_teach_nothing(spark, docs):
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(collected(language.identified(other))) == sorted(collected(language.identified(docs)))
    assert "zz" not in language.learn(other).languages


def test_spans_of_mixed_texts(docs):
    model = language.learn(docs)
    mixed = pa.array([prose(ENGLISH, 90, 1) + "\n" + prose(FRENCH, 30, 2), prose(FRENCH, 90, 3) + " " + prose(ENGLISH, 30, 4)])
    names, scores = language.labelled(model, mixed)
    assert names == ["en", "fr"] and all(0.6 < s < 0.85 for s in scores)


def test_texts_in_scripts_that_no_language_uses(spark, docs):
    model = language.learn(docs)
    texts = ["这是 一个 中文 文本", "ένα κείμενο στα ελληνικά", "the with from 这是一个中文文本这是一个中文文本这是一个中文文本这是一个中文文本这是一个中文文本这是一个中文文本这是一个中文文本这是一个中文文本"]
    names, scores = language.labelled(model, pa.array(texts))
    assert names[2] == "en" and scores[:2].tolist() == [0, 0] and 0 < scores[2] < language.LEAST
    more = spark.createDataFrame([(1000 + i, t, None, "s", 0) for i, t in enumerate(texts)], docs.schema)
    assert {r[0] for r in collected(language.accepted(docs.unionByName(more)))} == set(range(400))


def test_odd_documents(odd, none):
    rows = collected(language.identified(odd))
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    assert len(rows) == len(odd_rows())
    learned = {"en", "fr", "xx"}
    for i, text, *_ in odd_rows():
        lettered = text is not None and any(c.isalpha() for c in text)
        assert all(r[2] in (learned if lettered else {"und"}) or i is None or i == 3 for r in by_id[i])
        assert all(0 <= r[3] <= 1 for r in by_id[i])
    assert all(by_id[i][0][2:] == ("und", 0.0) for i in (50, 51, 52, 53)) and by_id[0][0][2] == "en" and by_id[33][0][2] == "fr"
    assert collected(language.identified(none)) == [] == collected(language.accepted(none))


def test_without_labels_nothing_is_known(odd):
    from pyspark.sql import functions as F

    rows = collected(language.identified(odd.withColumn("lang", F.lit(None).cast("string"))))
    assert {r[2] for r in rows} == {"und"} and {r[3] for r in rows} == {0.0}


def test_accepted_rows_keep_their_columns(odd):
    kept = language.accepted(odd)
    assert kept.columns == odd.columns
    ids = [r[0] for r in collected(kept)]
    assert not {50, 51, 52, 53} & set(ids) and {r[0] for r in odd_rows() if r[0] is not None and r[0] < 50} <= set(ids)
    assert ids.count(3) == 4
