"""Plain-Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

import xxhash


def sha(text: str | bytes) -> str:
    return sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def fingerprint(text: str | None) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows: list[tuple[int, str | None]], bits: int = 4) -> list[tuple[int, str, int]]:
    prints = [(doc, fingerprint(text)) for doc, text in rows]
    of = list(range(len(prints)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= bits:
                of[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, f"{p:016x}", least.get(find(i))) for i, (doc, p) in enumerate(prints)]


def bench_words(text: str | None) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        for i in range(max(1, len(words) - 9)) if words else ():
            windows[tuple(words[i:i + 10])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words, hit, found = bench_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                of = windows.get(tuple(words[i:i + n]))
                if of:
                    hit.update(range(i, i + n))
                    found |= of
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def base_secrets(text: str | None):
    text = text or ""
    kinds = [
        ("assign", r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 6),
        ("access", r"(AKIA[A-Z0-9]+)", 1, 20), ("hex", r"([0-9a-f]+)", 1, 24),
    ]
    spans = [(m.start(), k, name, m.end()) for k, (name, pattern, group, least) in enumerate(kinds)
             for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    counts = Counter(s[2] for s in spans)
    told = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(spans))
    return counts["assign"], counts["access"], counts["hex"], sha(told)


def repeated_bytes(texts: list[str | None], length: int):
    starts = Counter()
    data = [(t or "").encode() for t in texts]
    for t in data:
        starts.update(t[i:i + length] for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if starts[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, sha(kept)))
    return out


def text_counts(text: str | None):
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if word.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)
