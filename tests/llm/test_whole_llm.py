"""Training-data operators do the whole job: what a cut would lose."""

import random

import pytest

from sitegrid.llm import pii

PIECES = "4111 1111 10 0 255 7 a b c.d x@y.de + @ at dot plus one six [at] (dot) . , / _ - ( ) [ ] < > ／ ． ٣ а ​".split(" ") + [" ", "  ", "   ", "\t", ""]


@pytest.mark.parametrize("text", ["10 . 0 . 0 . 1", "10. 0. 0. 1", "4111/1111/1111/1111", "4111_1111_1111_1111", "4111  1111  1111  1111", "4111 - 1111 - 1111 - 1111", "4111, 1111, 1111, 1111"])
def test_odd_separators_need_no_other_hint(text):
    whole = f"see {text} x"
    assert [whole[a:b] for a, b, _ in pii.spans(whole)[1]] == [text]
    assert pii.masked(whole) in ("see <IP> x", "see <CARD> x")


def test_gate_loses_nothing(monkeypatch):
    rng, texts = random.Random(3), []
    for k in range(20_000):
        if k % 4 == 0:
            gap = rng.choice([" . ", ". ", " .", "/", " / ", "_", "  ", " - ", ", ", ","])
            parts = ["4111", "1111", "1111", "1111"] if rng.random() < 0.5 else ["10", "0", "0", "1"]
            texts.append(gap.join(parts))
        else:
            texts.append("".join(rng.choice(PIECES) + rng.choice(["", " ", "1"]) for _ in range(rng.randrange(1, 14))))
    gated = [pii.spans(t) for t in texts]
    monkeypatch.setattr(pii, "has_hint", lambda text: True)
    for t, g in zip(texts, gated, strict=True):
        assert g == pii.spans(t), t
