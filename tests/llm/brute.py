"""Plain versions of the operators' contracts, one row or all pairs at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

BLANK = "[^\x20\x09-\x0d]+"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def repeats(texts: list[str | None], length: int = 35) -> list[tuple[int, int, str]]:
    words = [re.findall(BLANK, t or "") for t in texts]
    seen = Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((len(w), sum(gone), digest(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def leaks(texts: list[str | None], items: list[tuple[int | None, str | None]], length: int = 10) -> list[tuple[int, int, int, str]]:
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - length + 1)) if w else ():
            windows[tuple(w[k : k + length])].add("" if i is None else str(i))
    out = []
    for t in texts:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [True] * n
                    found |= got
        out.append((len(w), sum(hit), len(found), digest(",".join(sorted(found)))))
    return out


def near(texts: list[str | None], items: list[tuple[int | None, str | None]], slop: int = 2, length: int = 10) -> list[int]:
    """Items with a proximity match, for each text: all starts are tried."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - length + 1)) if w else ():
            windows[tuple(w[k : k + length])].add("" if i is None else str(i))
    out = []
    for t in texts:
        w, at, found = words(t), defaultdict(set), set()
        for p, x in enumerate(w):
            at[x].add(p)
        for win, ids in windows.items():
            if all(x in at for x in win) and any(all(any(s + j + d in at[x] for d in range(-slop, slop + 1)) for j, x in enumerate(win)) for s in range(-slop, len(w) + slop)):
                found |= ids
        out.append(len(found))
    return out


def fingerprint(text: str | None, shingle: int = 4) -> int:
    w = re.findall(BLANK, lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + shingle]).encode(), 42) for k in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = re.findall(BLANK, lower(text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def similar(a: frozenset, b: frozenset) -> float:
    return 1.0 if a == b else len(a & b) / len(a | b)


def components(prints: list[int], radius: int = 4, sets: list[frozenset] | None = None, similarity: float = 0.8) -> list[int]:
    """The first row of each row's component, by fingerprints or, where given, by shingle sets."""
    parent = list(range(len(prints)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if similar(sets[a], sets[b]) >= similarity if sets else (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(prints))]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c)
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def pii(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    spans = lambda kind, pattern, good: [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group(), re.sub("[^0-9]", "", m.group()))]
    return (
        spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True) + spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split(".")))
        + spans("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and luhn(d)) + spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15)
    )


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    kinds = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
