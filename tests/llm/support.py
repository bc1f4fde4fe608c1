"""Plain versions of operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k=5):
    ws = WORD.findall(lowered(text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute_components(rows, percent, k=5):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, p) in enumerate(sets):
        for b, q in sets[:n]:
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}


def brute_removed(rows, n):
    seen, out = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        ws = WORD.findall(rows[i][1] or "")
        for s in range(len(ws) - n + 1):
            key = (2**63 if rows[i][0] is None else rows[i][0], s)
            seen[tuple(ws[s : s + n])] = min(key, seen.get(tuple(ws[s : s + n]), key))
    for i in order:
        ws, gone = WORD.findall(rows[i][1] or ""), set()
        for s in range(len(ws) - n + 1):
            if seen[tuple(ws[s : s + n])] < (2**63 if rows[i][0] is None else rows[i][0], s):
                gone.update(range(s, s + n))
        out[i] = (len(ws), len(gone), [w for j, w in enumerate(ws) if j not in gone])
    return out
