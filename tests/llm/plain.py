"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import xxhash

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def quality(t):
    t = t or ""
    w = words(t)
    n = len(w)
    seen = defaultdict(list)
    for k in range(n - 4):
        seen[tuple(w[k : k + 5])].append(k)
    covered = {x for v in seen.values() if len(v) > 1 for k in v for x in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    good = [x for x in lines if line_passes(x)]
    failed = n < 10 or 100 * len(covered) > 20 * n
    lost = n - len(words("\n".join(good)))
    base = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    return base, failed, not failed and lost <= n * 0.5, "\n".join(good)


def line_passes(x):
    from clauseforge.llm import quality as Q

    n, symbols = len(words(x)), len(re.findall(Q.SYMBOLS, x))
    capitals = sum(unicodedata.category(c) == "Lu" for c in x)
    if n <= 3 and not re.search(Q.END_MARK, x):
        return False
    if symbols >= 3 and symbols * 10 > n:
        return False
    if re.search("!.*!.*!", x) and capitals * 2 > len(x):
        return False
    if re.search(Q.NAVIGATION, x) or re.search(Q.BOILERPLATE, x):
        return False
    return not (re.search(Q.STUTTER, x) and len(re.sub(Q.STUTTER, "", x)) < len(x) * (1 - Q.MAX_STUTTER))


def luhn(s):
    return sum(v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v for i, c in enumerate(reversed(s))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m[0])) <= 15),
]
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def spans(t, rules):
    """(kind number, kind, start, end) of all matches that pass."""
    return [(k, name, m.start(), m.end()) for k, (name, p, good) in enumerate(rules) for m in re.finditer(p, t or "") if good(m)]


def fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=2):
    """id -> least id reachable, for {id: fingerprint}."""
    ids = sorted(prints)
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeats(rows, length=50):
    """Per (id, text) row which bytes go."""
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append(gone)
    return out


def shingles(t, size=5):
    w = re.findall(r"\w+", (t or "").lower())
    size = min(size, len(w))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()


def alike(texts):
    """id -> least id that links of five-word similarity 0.8 lead to, for {id: text}."""
    words_of = {i: [w.lower() for w in words(t)] for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} for i, w in words_of.items()}
    top = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                u, v = sorted((top[a], top[b]))
                top = {i: u if r == v else r for i, r in top.items()}
    return top
