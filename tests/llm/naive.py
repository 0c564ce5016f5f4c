"""Plain definitions of the operators' results, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def _joined(found, kinds):
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0])))


def secrets(text):
    t = text or ""
    out = [("assign", *m.span()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
        if len(m.group(2)) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return _joined(out, ["assign", "access", "hex"])


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= len(digits(m.group())) <= 15]
    return _joined(out, ["email", "ip", "card", "phone"])


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def size(text):
    return len(SPACE_WORD.findall(text or ""))


def mix_targets(sizes: dict):
    """source -> target by sharing excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        out = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if out[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else out[s] for s in order}
        full |= over


def contamination(text, items, length=10):
    words = BENCH_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        w = BENCH_WORD.findall((body or "").translate(LOWER))
        n = min(length, len(w))
        if not n:
            continue
        wins = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                found |= {str(item)} if item is not None else set()
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()


def rules(text):
    t = text or ""
    words = SPACE_WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(tri)
    again = {j for i, w in enumerate(tri) if counts[w] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), failed


def fingerprint(text, k=3):
    words = SPACE_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(items, linked):
    """item -> smallest index reachable, by every pair."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def jaccard(a, b, k=7):
    x, y = ({t[i:i + k] for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)
