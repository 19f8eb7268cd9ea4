"""Plain versions of the pipeline's stages, on lists of (id, text)."""

import re
import zlib

import numpy as np
import xxhash
from tokenizers import Tokenizer

WORD = re.compile("[^\x20\x09-\x0D]+")
LETTERS = "abcdefghijklmnopqrstuvwxyz "


def edits_within(a: str, b: str, k: int) -> bool:
    """Edit distance by a column of bits at a time."""
    if abs(len(a) - len(b)) > k:
        return False
    if not a:
        return len(b) <= k
    at = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = mask, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(h | up)) & mask, up & h
        score += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & mask, minus << 1 & mask
        up, down = (minus | ~(x | plus)) & mask, plus & x
    return score <= k


def reach(a: str, b: str) -> int:
    return min(6, -(-min(len(a), len(b)) // 20))


def lines_lost(docs, reach=reach, min_chars=20):
    """{(id, text): (exact, near)}: numbers of the lines that go."""
    first = {}
    places = sorted({(d is not None, d or 0, xxhash_signed(t), i, x) for d, t in docs for i, x in enumerate(t.split("\n"))})
    for *place, x in places:
        if WORD.search(x):
            first.setdefault(x, tuple(place))
    lines = sorted((x for x in first if len(x) >= min_chars), key=first.get)
    counts = np.array([[x.count(c) for c in LETTERS] for x in lines]).reshape(-1, len(LETTERS))
    size = np.array([len(x) for x in lines])
    near = set()
    for i, x in enumerate(lines):
        if i:
            apart = np.abs(counts[:i] - counts[i]).sum(1)
            some = np.flatnonzero((apart <= 12) & (np.abs(size[:i] - size[i]) <= 6))
            if any(edits_within(x, lines[j], reach(x, lines[j])) for j in some):
                near.add(x)
    out = {}
    for d, t in docs:
        exact, close = [], []
        for i, x in enumerate(t.split("\n")):
            if x in first and first[x] != (d is not None, d or 0, xxhash_signed(t), i):
                exact.append(i)
            elif x in near:
                close.append(i)
        if exact or close:
            out[d, t] = exact, close
    return out


def xxhash_signed(text: str) -> int:
    """Spark's xxhash64 of a string."""
    n = xxhash.xxh64_intdigest(text.encode(), 42)
    return n - (n >> 63 << 64)


def without(text, lost):
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lost)


def fingerprint(text: str) -> int:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def one_of_each_component(docs):
    """Documents that stay after near-duplicate removal."""
    prints = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    best = {}
    for i, (d, t) in enumerate(docs):
        place = (d is None, d or 0, xxhash_signed(t), i)
        best[root(i)] = min(best.get(root(i), place), place)
    return [docs[p[-1]] for p in best.values()]


def redacted(text: str, spans: str) -> str:
    """``spans``: kind:start:end in order, comma-joined."""
    out, end, merged = [], 0, []
    for s in filter(None, spans.split(",")):
        kind, a, b = s.split(":")
        if merged and int(a) < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], int(b))
        else:
            merged.append([kind, int(a), int(b)])
    for kind, a, b in merged:
        out += [text[end:a], f"<{kind.upper()}>"]
        end = b
    return "".join(out) + text[end:]


def cut(docs, tokenizer_file, capacity=2048):
    """(id, piece, start, length, crc) of all pieces."""
    tokenizer = Tokenizer.from_file(tokenizer_file)
    out = []
    for d, t in docs:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for piece, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a:a + capacity], "<u4")
            out.append((d, piece, a, len(part), zlib.crc32(part.tobytes())))
    return out
