import random
from itertools import combinations

import numpy as np
import pytest

from ostinato.llm import bpe, cutting

tokenizers = pytest.importorskip("tokenizers")
WORDS = "the barrel pressure sensor delivers a signal that is proportional to its deflection and never touches housing".split()


def prose(n, seed=0):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        sentence = [rng.choice(WORDS) for _ in range(rng.randint(6, 18))]
        out += [sentence[0].title(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out)


@pytest.fixture(scope="module")
def count():
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


TEXTS = {
    1: "Title\n\nABSTRACT\n" + prose(900, 1) + "\n\nCLAIMS\n" + "\n".join(f"{i}. The device of claim {i - 1}, wherein the sensor is made of cane." for i in range(1, 60)),
    2: prose(3000, 2),
    3: "x" * 9000,
    4: "日本語の文章です。" * 500,
    5: "日本語" * 2000,
    6: "short",
    7: "",
    8: None,
    9: " " * 20000 + "end",
    10: "😀" * 3000,
    11: "a b " * 30000,
    12: "\n".join(f"{i}. " + prose(560, i).replace(".", "") + "." for i in range(1, 11)),  # ten claims, two of which never fit into a piece
}


@pytest.fixture(scope="module")
def pieces(spark):
    df = spark.createDataFrame([(k, v, 3, "z") for k, v in TEXTS.items()] + [(1, TEXTS[1], 3, "z")], "doc_id long, text string, piece int, cut string")
    out = {}
    for r in cutting.cut_texts(df).collect():
        out.setdefault(r["doc_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece"]) for k, v in out.items()}


def test_pieces_cover_their_texts(pieces, count):
    assert set(pieces) == {k for k, v in TEXTS.items() if v and count(v) > 1024}
    assert len(pieces[1]) % 2 == 0  # the repeated row is cut as well
    for k, rows in pieces.items():
        rows = rows[::2] if k == 1 else rows
        assert [r["piece"] for r in rows] == list(range(len(rows)))
        assert rows[0]["first_char"] == 0 and rows[-1]["last_char"] == len(TEXTS[k])
        assert rows[-1]["last_token"] == count(TEXTS[k])
        for r in rows:
            assert r["text"] == TEXTS[k][r["first_char"] : r["last_char"]]
            assert 64 < r["n_tokens"] <= 1024 and count(r["text"]) <= 1024
        for a, b in zip(rows, rows[1:], strict=False):
            assert b["first_token"] == a["last_token"] - 64
            assert a["first_char"] < b["first_char"] <= a["last_char"]


def test_cuts_are_natural_where_they_can_be(pieces):
    assert {r["cut"] for r in pieces[1]} <= {"section", "claim", "paragraph", "sentence", "end"}
    assert {r["cut"] for r in pieces[2]} <= {"sentence", "end"}
    assert {r["cut"] for r in pieces[4]} <= {"sentence", "end"}
    assert "token" in {r["cut"] for r in pieces[3]}
    assert [r["cut"] for r in pieces[12]] == ["claim"] * 9 + ["end"]


def test_full_pieces_end_between_characters():
    starts = np.zeros(5001, dtype=bool)
    starts[::3] = True
    first, ends = cutting._full_pieces(5000, starts, 1024, 64)
    assert first[0] == 0 and ends[-1] == 5000
    assert starts[first].all() and starts[ends[:-1]].all()
    assert ((ends - first) <= 1024).all() and ((ends[:-1] - first[1:]) >= 64).all() and ((ends[:-1] - first[1:]) <= 67).all()


def test_fewest_pieces():
    assert cutting.fewest_pieces(100, np.array([18, 35, 50, 66, 80, 95]), 20, 2) == 7
    assert cutting.fewest_pieces(100, np.array([18, 60]), 20, 2) is None


def test_best_ends_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, limit, overlap = int(rng.integers(40, 60)), 20, 4
        places = np.unique(rng.integers(overlap + 1, n, 12))
        cost = rng.random(len(places)).round(2)
        mid, rough = rng.random(len(places)) < 0.3, rng.random(len(places)) < 0.2
        for pieces in (3, 4):
            even = (n + overlap * (pieces - 1)) / pieces
            best = None
            for choice in combinations(range(len(places)), pieces - 1):
                ends = [*places[list(choice)], n]
                starts = [0, *[e - overlap for e in ends[:-1]]]
                spare = [0, *(cutting.SPARE * mid[c] for c in choice)]
                short = [*(cutting.SPARE * rough[c] for c in choice), 0]
                if any(e - s > limit - a - b or e - s <= overlap for s, e, a, b in zip(starts, ends, spare, short, strict=True)):
                    continue
                c = sum(cost[list(choice)]) + sum(((e - s - even) / even) ** 2 for s, e in zip(starts, ends, strict=True)) + cutting.PIECE * pieces
                best = c if best is None else min(best, c)
            got = cutting.best_ends(n, places, cost, mid, rough, limit, overlap, pieces)
            assert (got is None) == (best is None)
            if got:
                assert got[0] == pytest.approx(best)


def test_empty(spark):
    assert cutting.cut_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bound_is_the_optimum_without_sizes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, limit, overlap = int(rng.integers(40, 60)), 20, 4
        places = np.unique(rng.integers(overlap + 1, n, 12))
        cost = rng.random(len(places)).round(2)
        got = cutting.least_penalties(n, places, cost, limit, overlap, 6)
        for pieces in range(2, 7):
            best = np.inf
            for choice in combinations(range(len(places)), pieces - 1):
                ends = [*places[list(choice)], n]
                starts = [0, *[e - overlap for e in ends[:-1]]]
                if all(e - s <= limit for s, e in zip(starts, ends, strict=True)):
                    best = min(best, cost[list(choice)].sum())
            assert got[pieces] == pytest.approx(best)
