"""Brute-force versions of the operators' results, over lists of rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

sha = lambda x: hashlib.sha256(x).hexdigest()


def raw(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def near(docs, width=4, percent=80):
    sets = {}
    for d, t in docs:
        w = raw(t).lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            for o in holders[x]:
                shared[o, d] += 1
            holders[x].append(d)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def quality(text):
    w = (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    at = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at), n < 50 or 100 * len(at) > 50 * n


def repeats(docs, width=100):
    first, out = {}, {}
    docs = sorted((d, raw(t)) for d, t in docs)
    for d, b in docs:
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], (d, i))
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] != (d, i):
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def line_repeats(docs, min_words=50):
    """n_lines, number of removed lines and digest of the rest: all lines of every run, of any length, that starts earlier too."""
    first, held, out = {}, {}, {}
    for d, t in sorted(docs):
        lines = [x.strip() for x in raw(t).split(b"\n")]
        n = [len(x.split()) for x in lines]
        held[d] = []
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if n[i] and n[j] and sum(n[i : j + 1]) >= min_words:
                    key = hash(tuple(lines[i : j + 1]))
                    first.setdefault(key, (d, i))
                    held[d].append((key, i, j))
    for d, t in docs:
        gone = {k for key, i, j in held[d] if first[key] != (d, i) for k in range(i, j + 1)}
        lines = (t or "").split("\n")
        out[d] = (0 if t is None else len(lines), len(gone), sha(raw("\n".join(x for i, x in enumerate(lines) if i not in gone))))
    return out


def contamination(docs, items, width=13):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw(t).lower())
    by = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            by[tuple(w[k : k + width])].add(str(i))
    sizes, out = {len(k) for k in by}, {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in by:
                    hit |= set(range(k, k + n))
                    found |= by[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def proximity(docs, items, width=13, span=26):
    """Items of which all words of a window stand within ``span`` consecutive words of a text."""
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw(t).lower())
    by = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            by[frozenset(w[k : k + width])].add(str(i))
    holders = defaultdict(list)
    for p in by:
        for w in p:
            holders[w].append(p)
    out = {}
    for d, t in docs:
        w, found = words(t), set()
        for k in range(len(w)):
            near = set(w[k : k + span])
            for p in holders.get(w[k], ()):
                if p <= near:
                    found |= by[p]
        out[d] = ",".join(sorted(found))
    return out


def secrets(text):
    text = text or ""
    found = [(m.start(), m.end(), "assign") for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort(key=lambda x: (x[0], ("assign", "access", "hex").index(x[2])))
    count = Counter(x[2] for x in found)
    return count["assign"], count["access"], count["hex"], sha(",".join(f"{k}:{s}:{e}" for s, e, k in found).encode())


def secret_spans(docs, live_owners=1, example_owners=3, live_docs=5, example_docs=20):
    """``spans, n_live, n_example`` of each (doc_id, text, owner), from values counted over all of them."""
    from math import log2

    def found(text):
        out = [(m.start(), m.end(), "assign", m[2]) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 8]
        out += [(m.start(), m.end(), "access", m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        out += [(m.start(), m.end(), "hex", m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        taken = {i for s, e, _, _ in out for i in range(s, e)}
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
            t, n = m[0], len(m[0])
            # a token is 20 to any number of characters with a digit and a letter, and of some variety
            if n >= 20 and any(c.isdigit() for c in t) and any(c.isalpha() for c in t) and -sum(t.count(c) / n * log2(t.count(c) / n) for c in set(t)) >= 3.5 and taken.isdisjoint(range(m.start(), m.end())):
                out.append((m.start(), m.end(), "owned", t))
        return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex", "owned").index(x[2])))

    holders, spans = defaultdict(set), [(d, found(t or "")) for d, t, _ in docs]
    for (d, _, owner), (_, some) in zip(docs, spans):
        for *_, value in some:
            holders[value].add((owner or "", d))

    def verdict(value):
        n_docs, n_owners = len(holders[value]), len({o for o, _ in holders[value]})
        if n_owners >= example_owners or n_docs >= example_docs:
            return "example"
        return "live" if n_owners <= live_owners and n_docs <= live_docs else "unclear"

    out = {}
    for d, some in spans:
        told = [(s, e, k, verdict(v)) for s, e, k, v in some]
        told = [x for x in told if x[2] != "owned" or x[3] == "live"]
        out[d] = ",".join(f"{k}:{s}:{e}" for s, e, k, _ in told), sum(x[3] == "live" for x in told), sum(x[3] == "example" for x in told)
    return out
