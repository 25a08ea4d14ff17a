"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import math
from collections import Counter, defaultdict


def remove_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[s : s + length] for r in raw for s in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        reach = 0
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                for k in range(max(reach, s), s + length):
                    gone[k] = True
                reach = s + length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, words=3):
    import re

    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def merkle(rows, altered):
    """(leaf, subroot, root, proof, folded root) of (doc_id, source, lang, n_chars, text) rows; altered: which have their text lowered."""
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = [h("".join(map(field, r))) for r in rows]
    other = [h("".join(map(field, (*r[:4], lower(r[4]))))) if a else x for r, a, x in zip(rows, altered, leaf)]

    def grow(nodes):
        """The root, and for each node what stands before and after it on its way up."""
        paths, places, now = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(now) > 1:
            for k, p in enumerate(places):
                run = p // 16 * 16
                paths[k].append(("".join(now[run:p]), "".join(now[p + 1 : run + 16])))
                places[k] = p // 16
            now = [h("".join(now[k : k + 16])) for k in range(0, len(now), 16)]
        return now[0], paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, roots = {}, []
    for s in sources:
        mine = sorted((k for k, r in enumerate(rows) if r[1] == s), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf[k]))
        root, paths = grow([leaf[k] for k in mine])
        roots.append(root)
        trees |= {k: (root, p) for k, p in zip(mine, paths)}
    top, above = grow(roots)
    out = []
    for k, r in enumerate(rows):
        sub, path = trees[k]
        path, x = path + above[sources.index(r[1])], other[k]
        for before, after in path:
            x = h(before + x + after)
        out.append((r[0], leaf[k], sub, top, h("".join(b + a for b, a in path)), x, x == top))
    return out


def suffix_tree(texts, trained, depth):
    """(score, base score, known words) of each text, states found one context after the other."""
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()) for t in texts]
    after = defaultdict(Counter)
    for t, train in zip(low, trained):
        data = [-1] * depth + list(t) + [-2]
        for k in range(depth, len(data)) if train else ():
            for d in range(depth + 1):
                after[tuple(data[k - d : k])][data[k]] += 1
    total = after[()].total()

    def is_state(s):
        c, up = after[s], after[s[1:]]
        return not s or sum(n * math.log(n / c.total() / (up[x] / up.total())) for x, n in c.items()) > math.log(total) / 2

    states = {s for s in list(after) if after[s] and is_state(s)}

    def p(s, x):
        while s and s not in states:
            s = s[1:]
        below = p(s[1:], x) if s else 1 / 255
        c = after[s]
        return (c[x] + len(c) * below) / (c.total() + len(c)) if c else below

    words = Counter(w for t, train in zip(low, trained) if train for w in [*t.split(), b""])
    out = []
    for t in low:
        data = [-1] * depth + list(t) + [-2]
        score = sum(math.log10(p(tuple(data[k - depth : k]), data[k])) for k in range(depth, len(data)))
        mine = [words.get(w, 0) for w in [*t.split(), b""]]
        base = sum(math.log10((c + 0.5) / (words.total() + 0.5 * (len(words) + 1))) for c in mine)
        out.append((score, base, sum(c > 0 for c in mine)))
    return out
