"""Code lengths against a plain context tree, and tables that hold one language each."""

import random
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pandas as pd

from aerolith.llm.language import _four_grams, _trees, code_lengths

TRAIN = {
    "xx": ["the cat sat on the mat. the cat ate", "a cat and a hat", "that is the thing"],
    "yy": ["der hund und die katze", "die maus und der hund", "Ärger über Öl"],
    "zz": ["日本語のテキスト", "日本の猫", "猫と犬"],
}


def tree(texts):
    """Counts of each context of 0 to 3 bytes, as the operator pads and folds."""
    counts = defaultdict(Counter)
    for t in texts:
        b = b"\n\n\n" + t.encode().lower() if t.isascii() else b"\n\n\n" + bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode())
        for i in range(3, len(b)):
            for k in range(4):
                counts[b[i - k : i]][b[i]] += 1
    return counts


def probabilities(counts, context):
    """Probability of each byte after ``context``: method C with exclusion, order by order."""
    p = dict.fromkeys(range(256), 1 / 256)
    for k in range(len(context) + 1):
        own = counts.get(context[len(context) - k :] if k else b"", None)
        if not own:
            continue
        total, kinds = sum(own.values()), len(own)
        left = sum(v for s, v in p.items() if s not in own)
        p = {s: own[s] / (total + kinds) if s in own else kinds / (total + kinds) * p[s] / left for s in range(256)}
    return p


def test_code_lengths_are_exact_in_tables_of_any_size():
    frame = pd.DataFrame([(lang, t) for lang, ts in TRAIN.items() for t in ts], columns=["lang", "text"])
    grams = pd.concat(list(_four_grams(iter([frame])))).groupby(["lang", "code"], as_index=False)["n"].sum()
    texts = ["the dog", "das ist es", "日本語", "Zebra! 123", "é", "katze und maus " * 3]
    folded = [b"\n\n\n" + bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode()) for t in texts]
    want = np.zeros((len(texts), len(TRAIN)))
    for k, lang in enumerate(sorted(TRAIN)):
        counts = tree(TRAIN[lang])
        want[:, k] = [sum(-log2(probabilities(counts, b[i - 3 : i])[b[i]]) for i in range(3, len(b))) for b in folded]
    for table_bytes, tables in ((1, 3), (48 << 20, 1)):
        trees = _trees(sorted(TRAIN), grams, table_bytes)
        assert len(trees.tables) == tables
        got = code_lengths(trees, [t.encode() for t in texts])
        assert np.abs(got - want).max() < 0.01, (got, want)


def test_no_context_is_lost_with_many_languages():
    rng = random.Random(4)
    rows = [(f"l{k:02d}", " ".join("".join(rng.choice("abcdefghijklmnop"[k % 8 : k % 8 + 8]) for _ in range(rng.randrange(2, 9))) for _ in range(60))) for k in range(40) for _ in range(5)]
    frame = pd.DataFrame(rows, columns=["lang", "text"])
    grams = pd.concat(list(_four_grams(iter([frame])))).groupby(["lang", "code"], as_index=False)["n"].sum()
    names = sorted(set(frame["lang"]))
    small, large = (_trees(names, grams, size) for size in (1 << 20, 1 << 30))
    assert len(large.tables) == 1 < len(small.tables)
    texts = [t.encode() for t in frame["text"][:20]]
    assert np.allclose(code_lengths(small, texts), code_lengths(large, texts), atol=0.05)
