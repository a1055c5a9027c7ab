"""Operator 13 against plain alignments of both libraries' whole encodings."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from aerolith.llm import alignment
from aerolith.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    """Expected columns of each text: every overlap of two byte ranges is looked at."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    value = {c: bytes([i]) for i, c in enumerate(byte_symbols())}

    def cover(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    links, groups = [], []
    for text in texts:
        links.append([])
        groups.append(None)
        if not text:
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        u = [b"".join(value[c] for c in a.id_to_token(i)) for i in x]
        v = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        own = (" " + text).encode()
        if b"".join(u) != own or b"".join(v) != own:
            continue
        u, v = cover(u), cover(v)
        cuts = sorted({e for _, e in u} & {e for _, e in v})
        group = [[[i for i, (_, e) in zip(ids, spans) if low < e <= high] for ids, spans in ((x, u), (y, v))] for low, high in zip([0, *cuts], cuts)]
        k = 0
        for i, (s, e) in zip(x, u):
            while v[k][1] <= s:
                k += 1
            m = k
            while m < len(v) and v[m][0] < e:
                links[-1].append((i, y[m]))
                m += 1
        groups[-1] = (len(x), len(y), group)
    count = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for own, found in zip(links, groups):
        if found is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in found[2])
        out.append((found[0], found[1], len(found[2]), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest()))
    return out


def mixed(n, seed):
    rng = random.Random(seed)
    parts = [*"abcXYZ  \n\t\r.,'12é日本ñ🙂()=\"", " the", " and", "'s", "  ", "<|endoftext|>", "</s>", "▁", "\0", "\xa0", "\x1c", "İ", "ａ", ";\r", "’", " Straße", "пример"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(n)]


TEXTS = [None, "", " ", "a", "\n", " a", "a ", "▁x", "the  end", "<|endoftext|> <s>", "same text twice", "same text twice", "日本語" * 400, "x" * 5000, "word " * 3000, "a\xa0b c d", *mixed(400, 5)]


@pytest.mark.parametrize("stretch, most", [(1 << 16, 1_000_000), (30, 40), (30, 0)])
def test_alignment_is_that_of_whole_encodings(spark, monkeypatch, stretch, most):
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a string").repartition(3)
    rows = alignment.align(docs, A, B, most).collect()
    want = Counter(((None if i == 3 else i // 2), *row) for i, row in enumerate(plain(TEXTS)))
    assert Counter((r["doc_id"], *(r[c] for c in NAMES)) for r in rows) == want


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
