"""Insults that are all spelled out in single letters."""

import numpy as np
import pytest

from clademill.llm import toxicity


class Known(toxicity.Scorer):
    """Knows three insults."""

    def decide(self, some):
        return np.array([0.8 if u.strip("^$") in ("blorfnik", "zumpwad", "grackhole") else -0.9 for u in some])


@pytest.fixture
def scorer():
    return Known(np.zeros(toxicity.SYMBOLS**toxicity.LETTERS, np.float32), -1.0)


@pytest.mark.parametrize(
    ("text", "hits", "types", "words"),
    [
        ("you b l o r f n i k and z u m p w a d there", 2, 2, 5),
        ("you b l o r f n i k z u m p w a d there", 2, 2, 4),  # one run
        ("you b l o r f n i k and b l o r f n i k there", 2, 1, 5),
        ("you blorfnik and b l o r f n i k there", 2, 1, 5),
        ("you are h e l l o there", 0, 0, 4),
        ("you may do so if it is me there", 0, 0, 9),  # short words aren't letters
    ],
)
def test_each_spelled_insult_counts(scorer, text, hits, types, words):
    assert scorer.features([text])[0, :3].tolist() == [hits, types, words]


def test_spelled_insults_count_as_plain_ones(scorer):
    some = ["zumpwad", "grackhole", "blorfnik"]
    plain, gapped = (scorer.features([f"here come {' and '.join(w)} again"]) for w in (some, map(" ".join, some)))
    assert np.allclose(plain, gapped, atol=1e-6)
