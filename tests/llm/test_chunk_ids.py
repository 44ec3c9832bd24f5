"""Ids by chunks are the tokenizer's, and the chunks of a portion are cut together."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from modelframe.llm.packing import ChunkTokenizer

ODD = ["", " ", "\n\t", "a", "\x1c", "don't stop", "x<|y z", "<|endoftext|> a", "Éa,b", "naïve...", "日本 語!", "a-b_c", "(Hello)", "1,234.5", "\x0b\x0cq", "é" * 40, "A" * 300, "ǅ ß ÿ", "'s 't", "!!?? ..a"]


def test_one_cut_for_all_chunks():
    path = public_tokenizers.path("word_bpe_49k.json")
    ours = ChunkTokenizer(path)
    calls = []
    whole, single = ours.parts_and_ends, ours.parts
    ours.parts_and_ends = lambda t: calls.append(1) or whole(t)
    ours.parts = lambda t: calls.append(1) or single(t)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcXYZéß',.!-19") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    ids, ends = ours.encode(pa.array([" ".join(words[i : i + 50]) for i in range(0, 3000, 50)]))
    assert len(calls) == 1 and len(ends) == 61 and ends[-1] == len(ids)


@pytest.mark.parametrize("seed", range(20))
def test_ids_of_odd_texts(seed):
    ours = ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(rng.choice((1, 2, 40)))]
    if seed % 2:
        texts = [t.replace("<|", "<") for t in texts]
    for _ in range(2):
        ids, ends = ours.encode(pa.array([*texts, None, ""]))
        found = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
        assert found == [ours.model.encode(t, add_special_tokens=False).ids for t in [*texts, "", ""]]
    for t in ODD:
        ids, ends = ours.encode(pa.array([t]))
        assert ids.tolist() == ours.model.encode(t, add_special_tokens=False).ids and np.asarray(ends).tolist() == [0, len(ids)]
