"""Induced sorting against sorting the suffixes themselves."""

import numpy as np
import pytest

from gneiss.llm import induced_sorting
from gneiss.llm.induced_sorting import Store, suffix_array


@pytest.fixture(autouse=True, params=["tuples", "scans"])
def to_the_end(request, monkeypatch):
    monkeypatch.setattr(induced_sorting, "FEW", 1)
    if request.param == "scans":
        monkeypatch.setattr(induced_sorting, "TUPLES", 0)


def check(body, top, room=1 << 30):
    text = np.append(np.asarray(body, np.int32) + 1, 0)
    store = Store(room)
    got = suffix_array(text, top + 1, store, min(room, 1 << 12)).tolist()
    store.close()
    plain = text.tolist()
    assert got == sorted(range(len(plain)), key=lambda i: plain[i:])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("small", [False, True])
def test_random_texts(seed, small, monkeypatch):
    if small:
        monkeypatch.setattr(induced_sorting, "RANGE", 16)
        monkeypatch.setattr(induced_sorting, "TAKEN", 8)
    rng = np.random.default_rng(seed)
    for top in (0, 1, 2, 25, 255):
        for n in (0, 1, 2, 3, 50, 700):
            check(rng.integers(0, top + 1, n), top, 0 if small and n < 60 else 1 << 30)
        piece = rng.integers(0, top + 1, 40)
        check(np.concatenate([piece, piece, piece[:20], piece]), top)


def test_runs_and_periods():
    check([3] * 500, 3)
    check([0, 1] * 300, 1)
    check(list(range(200)) + list(range(200, 0, -1)), 200)
    check([2, 1, 0] * 150 + [2, 2, 2], 2)


def test_arrays_on_disk_change_nothing(monkeypatch):
    monkeypatch.setattr(induced_sorting, "RANGE", 64)
    check(np.random.default_rng(9).integers(0, 4, 3000), 3, room=1)


def test_short_texts_by_doubling(monkeypatch):
    monkeypatch.setattr(induced_sorting, "FEW", 1000)
    check([3] * 500, 3)
    check(np.random.default_rng(4).integers(0, 3, 800), 2)
    check([], 0)
    check(np.random.default_rng(5).integers(0, 3, 3000), 2)
