"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, fp long, row int, part string, score int"

ENGLISH = "the of and that with from have this they were been their which would there about could other these"
FRENCH = "le la les des une que pour dans qui sur avec elle était mais tout être nous sont cette même après"


def prose(words: str, n: int, seed: int) -> str:
    draw = random.Random(seed)
    out = []
    for i in range(n):
        word = "".join(draw.choice(words.split()) for _ in range(draw.choice((1, 1, 2))))
        out.append(word.capitalize() if i % 9 == 0 else word + "." if i % 9 == 8 else word)
    return "\n".join(" ".join(out[i : i + 27]) for i in range(0, n, 27))


def odd_rows() -> list[tuple]:
    """Null, empty and long texts, texts without words or letters, repeated rows, equal and null ids, null labels."""
    rows = [(i, prose(ENGLISH, 60 + i, i), "en", f"s{i % 3}") for i in range(24)]
    rows += [(30 + i, prose(FRENCH, 70 + i, 100 + i), "fr", "s1") for i in range(12)]
    rows += [
        (50, None, "en", "s0"), (51, "", "en", "s0"), (52, " \n\t ", None, None), (53, "!!! 123 ...", "en", "s2"),
        (54, "word", None, "s0"), (55, "Word  word\n\nword.", "fr", None), (56, prose(ENGLISH, 30_000, 7), "en", "s0"),
        (57, "日本語のテキスト。 текст по-русски", "xx", "s0"), (58, "it's he'll “quoted” a.b,c\tx\r\n  y <|endoftext|> z\x02", "en", "s1"),
        (59, "été ́ İstanbul ΑΣ a b c\x85d", "fr", "s1"),
        (None, prose(ENGLISH, 40, 900), "en", "s0"), (None, None, None, None), (None, None, None, None),
    ]
    rows += [rows[3], rows[3], (3, prose(ENGLISH, 50, 901), "en", "s0"), (60, rows[4][1], "en", "s1"), (61, rows[56 - 20][1], None, "s1")]
    # Near copies none of whose lines are equal.
    line = prose(ENGLISH, 300, 950).split()
    rows += [(70, " ".join(line), "en", "s2"), (71, " ".join(["Oneword", *line[1:150], "otherword", *line[151:]]), "en", "s2")]
    return [(*r, len(r[1]) if r[1] else 0, "clash", 1, 2, "p", 3) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def collected(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
