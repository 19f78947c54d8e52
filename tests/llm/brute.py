"""Plain Python versions of the corpus operators, for small inputs."""
import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1  # stands for a null id


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit |= {i, i + 1, i + 2}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines)}


def failed(c):
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def quality(rows, least_spread, tail_cut, near_cut, c_core, c_near, min_rows=50, core=0.75):
    """kept of each (lang, source, text), with numpy."""
    import numpy as np
    stats = [counts(t) for *_, t in rows]
    bad = [failed(c) for c in stats]
    x = np.array([[math.floor(v * 1024 + 0.5) for v in (
        math.log(max(c["word_chars"], 1) / max(c["n_words"], 1)), math.log(1 + 100 * c["n_symbols"] / max(c["n_words"], 1)),
        math.log(1 + 100 * c["n_dup_lines"] / max(c["n_lines"], 1)), math.log(1 + 100 * c["n_repeat_words"] / max(c["n_words"], 1)))] for c in stats], dtype=float).reshape(len(rows), 4)
    pair = [(a, b) for a, b, _ in rows]
    n = Counter(p for p, f in zip(pair, bad) if not f)
    pool = Counter()
    for (lang, _), k in n.items():
        pool[lang] += k if k < min_rows else 0
    group = [p if n[p] >= min_rows else (p[0], "*") if pool[p[0]] >= min_rows else "*" for p in pair]
    kept = [not f for f in bad]
    floor = np.diag(np.square(least_spread))

    def estimate(v, times):
        v = v / 1024
        m = v.mean(0)
        return m, times * ((v.T @ v) / len(v) - np.outer(m, m)) + floor

    def d2(v, e):
        u = np.linalg.solve(np.linalg.cholesky(e[1]), (v / 1024 - e[0]).T)
        return (u * u).sum(0)

    for g in set(group):
        at = [i for i in range(len(rows)) if group[i] == g and not bad[i]]
        if not at:
            continue
        v = x[at] if len(at) >= min_rows else x[[not f for f in bad]]
        med = np.median(v, 0)
        mad = np.median(np.abs(v - med), 0)
        ends = []
        for k, e in enumerate([(med / 1024, np.diag((1.4826 * mad / 1024) ** 2) + floor), estimate(v, 1.0)]):
            det, h = math.inf, math.ceil(core * len(v))
            while True:
                b = np.floor(np.minimum(np.sqrt(d2(v, e)), 4096) * 64)
                near = estimate(v[b <= np.sort(b)[h - 1]], c_core)
                if not np.linalg.det(near[1]) < det * (1 - 1e-12):
                    break
                e, det = near, np.linalg.det(near[1])
            ends.append((det, k, e))
        e = min(ends, key=lambda t: t[:2])[2]
        e = estimate(v[d2(v, e) <= near_cut], c_near)
        for i, far in zip(at, d2(x[at], e) > tail_cut):
            kept[i] = not far
    return kept


def base_spans(text):
    text = text or ""
    found = []
    rx = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, "assign", m.end()) for m in re.finditer(rx, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def near_duplicates(docs, k, percent=80):
    """(doc_id, n_shingles, component_id, kept) of each (doc_id, text)."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        if docs[i][0] is None:
            continue
        both = Counter(j for x in s for j in where.get(x, ()))
        for x in s:
            where.setdefault(x, []).append(i)
        for j, c in both.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s), None if d is None else least[top(i)], d is None or least[top(i)] == d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def part(u, i, length):
    return u[i:i + length] if isinstance(u, bytes) else tuple(u[i:i + length])


def repeats(docs, length, units):
    """For each (doc_id, text): its units and which of them a window covers that a smaller document has."""
    first = {}
    parts = [(LAST if d is None else d, units(t)) for d, t in docs]
    for d, u in parts:
        for i in range(len(u) - length + 1):
            key = part(u, i, length)
            first[key] = min(first.get(key, d), d)
    out = []
    for d, u in parts:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if first[part(u, i, length)] < d:
                gone[i:i + length] = [True] * length
        out.append((u, gone))
    return out


def sha(raw):
    return hashlib.sha256(raw).hexdigest()
