import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from curata.llm import bpe, token_counts
from tokenizers import Tokenizer

FIXED = [
    None, "", " ", "  \n ", "it's we'll they're I've 'sun 'tis ''s 're'r 'l 'v' 'r", "a'S  'll\n'll\t'd x'", "1234 56٣½ Ⅷ", "a  b   c \n\n d\t\te ", "😀😀 ñandú ÀÉ́ é ΑΣ ΟΔΟΣ İstanbul ǅ",
    "<|endoftext|> x<|startoftext|>y <|endoftext", "\x1c\x1f\x85\xa0 x y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "!!!'''s--''ll", "the " * 3000, "中文字符 測試ひらがな한국어 العربية हिन्दी",
]


def texts():
    r = random.Random(4)
    parts = ["'", "s", "re", "ll", "'ve", " ", "  ", "\n", "7", "é", "é", "the", "tion", "ing", "!", "$$$", "\t", "Σ", "ß", "😀", "​", "²", "A", "<|endoftext|>"]
    return FIXED + ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(1500)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "null id", "x", 1), (4, FIXED[4], "x", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)


def test_byte_bpe_equals_the_library(docs, monkeypatch):
    rows, df = docs
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((str(i), len(ids := lib.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(df, keep=["doc_id"]).collect()) == want
    both = bpe.decode(bpe.encode(df)).collect()
    assert len(both) == len(rows) and all(bytes(r.decoded) == (r.text or "").encode() and r.ids == lib.encode_ordinary(r.text or "") for r in both)
    assert bpe.digests(df.limit(0), keep=["doc_id"]).count() == 0


def test_counts_equal_the_library(docs):
    rows, df = docs
    lib = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    want = sorted((str(i), len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in token_counts.count(df, keep=["doc_id"]).collect()) == want
    assert token_counts.count(df.limit(0)).count() == 0


def test_automaton_counts_equal_merge_replay(monkeypatch):
    import numpy as np
    from curata.llm import automaton
    from curata.llm.replay import replay

    r = random.Random(9)
    for _ in range(30):
        pairs, tokens, spell = {}, 4, {k: (k,) for k in range(4)}
        for rank in range(r.randint(1, 40)):
            a, b = r.randrange(tokens), r.randrange(tokens)
            if (a, b) not in pairs and spell[a] + spell[b] not in spell.values():
                # As a learner would: both sides are what the merges so far make of them.
                table = automaton.PairTable(pairs) if pairs else None
                joined = np.array(spell[a] + spell[b], np.int32)
                if table is None or replay(joined, np.array([len(joined)]), table)[0].tolist() == [a, b]:
                    pairs[a, b], spell[tokens] = (rank, tokens), spell[a] + spell[b]
                    tokens += 1
        if not pairs:
            continue
        m = automaton.Automaton(pairs, np.arange(4))
        sizes = np.array([r.randint(1, 30) for _ in range(200)] + [600, 1500])
        symbols = np.array([r.randrange(4 if r.random() < 0.5 else 2) for _ in range(sizes.sum())], np.int32)
        monkeypatch.setattr(automaton, "PIECE", 64)
        monkeypatch.setattr(automaton, "WARM", 16)
        got, bad = m.counts(symbols, sizes)
        want = replay(symbols, sizes, m.table)[1]
        assert not bad[:200].any() and (got == want)[~bad].all()


def test_every_code_point_beside_letters_and_digits(spark):
    points = [i for i in range(0x20000) if not 0xD800 <= i < 0xE000] + [0x32808, 0x3D808, 0xE0100]
    rows = [(k, " ".join(f"a{chr(i)}b 1{chr(i)}2" for i in points[k : k + 64])) for k in range(0, len(points), 64)]
    lib = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    want = {k: len(lib.encode(t, add_special_tokens=False).ids) for k, t in rows}
    got = {x.doc_id: x.n_tokens for x in token_counts.count(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()}
    assert [hex(points[k]) for k in want if got[k] != want[k]] == []
