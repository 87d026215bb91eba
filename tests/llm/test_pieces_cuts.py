"""Cuts of segments are merged once for all occurrences that skip the same merges, and equal the agenda's."""

import random

import numpy as np
import pytest

from flowspark.llm import pieces

pytest.importorskip("sentencepiece")


class Counted(pieces.Pieces):
    """Counts the segments it merges."""

    merged = 0

    def merge_rows(self, segments, *args, **kwargs):
        self.merged += len(segments)
        return super().merge_rows(segments, *args, **kwargs)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_every_occurrence_is_cut_as_the_agenda_cuts_it(rate):
    vocabulary = pieces.Pieces.load(pieces.MODEL)
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABC0123456789.,;-  \n\n\t\x00éß人\U0001f389"
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 200))) for _ in range(60)] + ["the people of the United States " * 20, "", "\x00", "y" * 60, "a  b   c"]
    docs = [draw.getrandbits(64) for _ in texts]
    encoder = pieces.Encoder(vocabulary, rate)
    for _ in range(2):  # the second time from remembered cuts
        for text, doc, ids in zip(texts, docs, encoder.encode(texts, docs)):
            words = vocabulary.segments.findall((pieces.SPACE + text).replace(" ", pieces.SPACE)) if text else []
            base = pieces.occurrence_bases(np.full(len(words), doc, np.uint64), np.arange(len(words)))
            assert ids == b"".join(pieces.packed(vocabulary.merge(w, rate, base=int(b))) for w, b in zip(words, base))


def test_occurrences_that_skip_the_same_merges_are_merged_once():
    vocabulary = Counted.load(pieces.MODEL)
    encoder = pieces.Encoder(vocabulary, 0.1)
    encoder.encode(["unbelievable " * 5000], [1])
    assert vocabulary.merged < 600
    before = vocabulary.merged
    encoder.encode(["unbelievable " * 5000], [1])
    assert vocabulary.merged == before


def test_an_encoder_forgets_its_cuts():
    vocabulary = Counted.load(pieces.MODEL)
    encoder = pieces.Encoder(vocabulary, 0.1)
    first = encoder.encode(["some words here"], [1])
    encoder.forget()
    assert not encoder.cuts.text and encoder.encode(["some words here"], [1]) == first
