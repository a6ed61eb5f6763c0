import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from curata.llm import bpe
from curata.llm import pieces as pc


def encoded(text, v):
    index, cps = pc.PieceIndex(), pc.points(text)
    starts = bpe.split(cps, np.zeros(1, np.int64))
    numbers = index.add(text, cps, starts, np.append(starts[1:], len(cps)))
    ids, sizes = bpe.encode_pieces(index, v)
    ends = np.cumsum(sizes)
    return [int(x) for k in numbers for x in ids[ends[k] - sizes[k] : ends[k]]]


@pytest.mark.parametrize("most", [1 << 19, 50, 0])
def test_remembered_pieces_give_the_librarys_ids(monkeypatch, most):
    monkeypatch.setattr(bpe, "MEMO", most)
    path = public_tokenizers.path(bpe.VOCABULARY)
    v = bpe.Vocabulary(path)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ids, special_tokens={})
    r = random.Random(2)
    words = ["".join(r.choices("abcdeéñ漢🙂xyz", k=r.randint(1, 90))) for _ in range(120)]
    for _ in range(8):
        text = " ".join(r.choices(words, k=60))
        assert encoded(text, v) == library.encode_ordinary(text)


def test_a_shared_hash_is_noticed():
    path = public_tokenizers.path(bpe.VOCABULARY)
    v, fresh = bpe.Vocabulary(path), bpe.Vocabulary(path)
    text = "qzxwvk jjqpzt wwkqzx"
    encoded(text, v)
    assert len(v.memo.hashes) > 1
    v.memo.begins, v.memo.sizes = v.memo.begins[::-1].copy(), v.memo.sizes[::-1].copy()
    assert encoded(text, v) == encoded(text, fresh)
