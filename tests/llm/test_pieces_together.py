"""New stretches merge together, as rows of an array, and give what the library gives."""

from __future__ import annotations

import hashlib
import random

import pytest

from clearbrook.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
ODD = ["", " ", "▁" * 50, " " * 47 + "x", "\n\n a\n", "日本語 abc 😀é", "ab" * 3000, "x" * 48, "x" * 49, "<0x41> <s>", "\x00 a"]


@pytest.fixture(scope="module")
def model():
    return pieces.load_model()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices("etaoinshrdlu éñ  .,\n▁E1日", k=draw.randint(0, 400))) for _ in range(n)]


def same(got: tuple, text: str, library) -> None:
    ids = library.encode(text)
    assert got[:3] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_words_merge_without_a_loop_for_each(model, library, monkeypatch):
    alone = []
    monkeypatch.setattr(pieces.PieceModel, "merged", lambda self, chars: alone.append(chars) or list(chars))
    rows = [" ".join(f"{w}{k}ation" for w in ("inter", "con", "zq")) for k in range(300)]
    for got, t in zip(model.digests(rows, pieces.Memory(model)), rows, strict=True):
        same(got, t, library)
    assert not alone


def test_rows_of_an_array_equal_the_plain_loop(model):
    words = sorted({s for t in [*ODD, *texts(60, 1)] for s in model.stretch.findall(model.normalise(t)[0]) if len(s) <= pieces.SCAN})
    done = {words[i]: [model.pieces[p] for p in row] for who, rows in model.merged_together(words) for i, row in zip(who, rows, strict=True)}
    assert done == {w: model.merged(w) for w in words if all(c in model.ids for c in w)} and len(done) > 300


@pytest.mark.parametrize(("remembered", "block"), [(1_500_000, 200_000), (5, 3)])
def test_any_block_and_memory_give_the_same(model, library, monkeypatch, remembered, block):
    monkeypatch.setattr(pieces, "REMEMBERED", remembered)
    monkeypatch.setattr(pieces, "BLOCK", block)
    memory = pieces.Memory(model)
    for rows in (ODD, texts(20, 2), [], ODD):
        for got, t in zip(model.digests(rows, memory), rows, strict=True):
            same(got, t, library)


def test_parts_hold_every_row_once():
    import pyarrow as pa

    for sizes in ([], [0] * 1200, [10, 2_000_000, 5, 600_000, 600_000]):
        parts = list(pieces._together(pa.array(["a" * n for n in sizes], pa.string())))
        assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes))) and all(0 < b - a <= 500 for a, b in parts)
        assert all(b - a == 1 or sum(sizes[a:b]) <= pieces.TOGETHER for a, b in parts)
