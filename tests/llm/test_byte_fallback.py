"""Token counts against the library's unigram model with byte fallback."""

import random

import pytest

from reliefgrid.llm import token_counts

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

BYTES = [(f"<0x{b:02X}>", 0.0) for b in range(256)]


def test_bytes_of_unknown_characters(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    t = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *token_counts.piece_scores(path), *BYTES], 0, True))
    r = random.Random(6)
    pool = "ab the1,日本語한🙂👩‍👧𓀀𓁐ሀሁꙮǅ龘"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(1, 30))) for _ in range(200)] + ["🙂", "𓀀𓀀𓀀", "龘" * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in token_counts.count_tokens(d, path, byte_fallback=True).collect()}
    assert got == {k: sum(len(t.encode("▁" + w).ids) for w in x.split(" ") if w) for k, x in enumerate(texts)}
    assert got[201] >= 12


def test_bytes_beside_tied_pieces():
    r = random.Random(3)
    for _ in range(200):
        pieces = [(p, float(-r.randint(1, 4))) for p in {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(10)}]
        t = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *pieces, *BYTES], 0, True))
        c = token_counts.Counter(pieces, True)
        for _ in range(20):
            w = "".join(r.choice("abcdé日🙂") for _ in range(r.randint(1, 12)))
            assert c.count(w) == len(t.encode(w).ids), (pieces, w)
