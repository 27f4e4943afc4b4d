"""Plain versions of the operators' results, over lists of rows."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np


class Union:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text, words):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def jaccard_components(docs, words, percent):
    """{doc: (set size, component)} of (doc, text) rows with distinct ids."""
    sets = {d: shingles(t, words) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    union = Union(sets)
    for d, s in sets.items():
        for e, both in Counter(e for g in s for e in holders[g] if e < d).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                union.join(d, e)
    return {d: (len(s), union.find(d)) for d, s in sets.items()}


def cosine_links(rows, threshold):
    """{id: (links, component)} of (id, vector, label) rows with distinct ids."""
    good = {}
    for i, v, label in rows:
        v = None if v is None or label is None or any(x is None for x in v) else np.asarray(v, dtype=np.float64)
        if v is not None and len(v) and np.isfinite(v).all() and v.any():
            good[i] = (label, v / np.linalg.norm(v))
    links, union = Counter(), Union([i for i, _, _ in rows])
    ids = sorted(good)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            (a, v), (b, w) = good[i], good[j]
            if a == b and len(v) == len(w) and float(v @ w) >= threshold:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    return {i: (links[i], union.find(i)) for i, _, _ in rows}


def decontaminated(docs, items, window=10):
    """[(doc, n_words, n_hit, n_items, sha, contaminated)] by looking for every window at every place."""
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, named = split(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    named |= found
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(named), sha, bool(hit)))
    return out


def pieces(docs, tokenizer, capacity=2048):
    """{(doc, piece): (start, length, crc)} of (doc, text) rows with distinct ids."""
    out = {}
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[doc, k] = (a, b - a, zlib.crc32(np.asarray(ids[a:b], dtype="<u4").tobytes()))
    return out


def without_boilerplate(docs, min_sites=4, min_words=4):
    """[(doc, text)] of (doc, source, text) rows."""
    long_enough = lambda line: len(line.strip(" ").split(" ")) >= min_words
    sites, first = defaultdict(set), {}
    for doc, source, text in docs:
        for line in (text or "").split("\n") if text is not None else ():
            if long_enough(line):
                key = line.strip(" ")
                if source is not None:
                    sites[key].add(source)
                if doc is not None:
                    first[key] = min(first.get(key, doc), doc)
    bad = {k for k, s in sites.items() if len(s) >= min_sites and k in first}
    out = []
    for doc, _, text in docs:
        if text is not None and doc is not None:
            lines = text.split("\n")
            text = "\n".join(x for x in lines if not (x.strip(" ") in bad and long_enough(x) and first[x.strip(" ")] != doc))
        out.append((doc, text))
    return out


# Operators 11 to 13


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted_words(doc, text):
    found = words(text)
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(found)
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]
    return found


def runs(found):
    """(start, length, period) of all runs, by start, then period; every period is tried along the whole text."""
    number = {w: i for i, w in enumerate(dict.fromkeys(found))}
    codes, out = np.array([number[w] for w in found]), []
    for q in range(1, len(found) // 4 + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if j - i + q >= max(6, 4 * q):
                stretch = codes[i : j + q]
                if not any(q % d == 0 and np.array_equal(stretch[d:], stretch[:-d]) for d in range(1, q)):
                    out.append((i, j + q - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_report(found):
    listed = runs(found)
    dropped = {i for s, n, q in listed for i in range(s + q, s + n)}
    best = min(listed, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if listed else None
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
    kept = " ".join(w for i, w in enumerate(found) if i not in dropped)
    return (
        len(listed), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def damaged(rows):
    """{conversation: rows after damage, by turn} of (conv, turn, role, text)."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        kept = out.setdefault(conv, [])
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        if kind:
            kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])) for c, r in out.items()}


def cheapest_edits(marks):
    """(cost, audit, outputs) of (initial, fault) rows by the shortest path over (row, state), ties by the audit string."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    done, heap = {}, [(0, "", (), 0, "")]
    while heap:
        cost, audit, put, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = cost, audit, put
        other = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", (*put, (None, other)), i, other))
        if i < len(marks):
            initial, fault = marks[i]
            heapq.heappush(heap, (cost + 4, audit + "D", put, i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = cost + 3 * (fault == "truncated")
                if (state, initial) in follows:
                    heapq.heappush(heap, (more, audit + "K", (*put, (i, None)), i + 1, follows[state, initial]))
                heapq.heappush(heap, (more + 3, audit + "R", (*put, (i, other)), i + 1, other))
    return min((done[k] for k in done if k[0] == len(marks) and k[1] in ("", "a")), key=lambda d: d[:2])


def repair_report(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of a conversation's rows after damage."""
    if not rows:
        return (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    turns = [t for t, _, _ in rows if t is not None]
    seen, marks = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = (
            "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        )
        seen.add((role, text))
        marks.append((role[:1], fault))
    cost, audit, put = cheapest_edits(marks)
    full = {"u": "user", "a": "assistant"}
    lines = [
        (full[new] if new else rows[i][1]) + ":" + (rows[i][2] if i is not None else "") for i, new in put
    ]
    faults = [f for _, f in marks]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def id_report(rows, encode, end):
    """{doc: (start, n, crc)} of (doc, text) rows with distinct ids."""
    out, start = {}, 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode(text or ""), end]
        out[doc] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    return out
