"""Plain versions of the operators, without Spark or numpy tricks, to hold results against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def gram_set(text: str, n: int) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def jaccard_pairs(docs: dict[int, str], n: int, t: float) -> dict[tuple[int, int], float]:
    sets = {i: s for i, x in docs.items() if (s := gram_set(x, n))}
    ids = sorted(sets)
    out = {}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < t * max(len(x), len(y)):
                continue
            both = len(x & y)
            if both and both / (len(x) + len(y) - both) >= t:
                out[a, b] = both / (len(x) + len(y) - both)
    return out


def similar_documents(docs: dict[int, str], n: int, t: float) -> set[tuple[int, int, int, int]]:
    """(doc_id, class_id, group_id, links) of all documents that have a copy or a similar one."""
    first: dict[frozenset, int] = {}
    sets = {i: s for i in sorted(docs) if (s := gram_set(docs[i], n))}
    of = {i: first.setdefault(s, i) for i, s in sets.items()}
    pairs = jaccard_pairs({i: docs[i] for i in set(of.values())}, n, t)
    root = roots(set(of.values()), pairs)
    links = dict.fromkeys(root, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    copies = {c for i, c in of.items() if i != c}
    return {(i, c, root[c], links[c]) for i, c in of.items() if c in copies or links[c]}


def roots(ids, pairs) -> dict[int, int]:
    to = {i: i for i in ids}

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        to[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def passages(docs: dict[int, str], window: int) -> set[tuple[int, int, int, int]]:
    seen: dict[tuple, set[int]] = {}
    split = {i: words(t) for i, t in docs.items()}
    for i, w in split.items():
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), set()).add(i)
    out = set()
    for i, w in split.items():
        run: list[int] | None = None
        for s in range(len(w) - window + 1):
            who = seen[tuple(w[s : s + window])]
            if len(who) < 2:
                continue
            if run and s <= run[1]:
                run[1], run[2] = s + window, min(run[2], min(who))
            else:
                if run:
                    out.add((i, *run))
                run = [s, s + window, min(who)]
        if run:
            out.add((i, *run))
    return out


def subwords(text: str) -> list[bytes]:
    """Byte n-grams of 2 to 4 of the letters' runs with a space on either side, with a letter each and spaces at the ends only."""
    out = []
    raw = text.lower().encode()
    for run in re.findall(rb"[a-z\x80-\xff]+", raw):
        x = b" " + run + b" "
        for n in (2, 3, 4):
            out += [x[i : i + n] for i in range(len(x) - n + 1)]
    return out


def differencing(sizes: list[int], k: int) -> list[int]:
    """The loads of k shards, the largest first, by Karmarkar-Karp over plain lists."""
    parts = [[s] + [0] * (k - 1) for s in sizes]
    live = list(range(len(parts)))
    while len(live) > 1:
        live.sort(key=lambda i: (parts[i][-1] - parts[i][0], i))
        a, b = live.pop(0), live.pop(0)
        parts.append(sorted((x + y for x, y in zip(parts[a], reversed(parts[b]))), reverse=True))
        live.append(len(parts) - 1)
    return parts[live[0]] if live else [0] * k
