"""Plain versions of the operators, over lists of rows, to hold the Spark forms against."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode()) if text else []


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(ws: list[bytes], n: int) -> list[bytes]:
    if len(ws) < n:
        return [b" ".join(ws)] if ws else []
    return [b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)]


def fingerprint(text: str | None) -> int:
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(words(lower(text)), 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps: list[int], reach: int = 2) -> dict[int, int]:
    """Each distinct fingerprint's class: the position of its first member."""
    distinct = sorted(set(fps))
    points = np.array(distinct, np.uint64)
    parent = list(range(len(points)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, p in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(points ^ p) <= reach).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {fp: find(i) for i, fp in enumerate(distinct)}


def near_duplicates(docs: list[tuple]) -> list[tuple]:
    fps = [fingerprint(t) for _, t in docs]
    of = classes(fps)
    least: dict[int, int] = {}
    for (d, _), fp in zip(docs, fps, strict=True):
        if d is not None:
            least[of[fp]] = min(d, least.get(of[fp], d))
    return [(d, f"{fp:016x}", least.get(of[fp])) for (d, _), fp in zip(docs, fps, strict=True)]


def repeats(docs: list[tuple], n: int = 13) -> list[tuple]:
    """Per document its words, and for each whether a repeated window covers it."""
    first: dict[bytes, int] = {}
    for d, t in docs:
        ws = words(t)
        if d is not None:
            for i in range(len(ws) - n + 1):
                key = b" ".join(ws[i : i + n])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in docs:
        ws = words(t)
        gone = [False] * len(ws)
        for i in range(len(ws) - n + 1):
            if d is not None and first[b" ".join(ws[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        kept = [w for w, g in zip(ws, gone, strict=True) if not g]
        out.append((d, len(ws), sum(gone), b" ".join(kept)))
    return out


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def leaks(docs: list[tuple], items: list[tuple], n: int = 5, threshold: float = 0.8) -> set[tuple]:
    known = [(i, set(shingles(words(lower(t)), n))) for i, t in items]
    by = defaultdict(list)
    for k, (_, s) in enumerate(known):
        for x in s:
            by[x].append(k)
    out = set()
    for d, t in docs:
        shared: dict[int, int] = defaultdict(int)
        for x in set(shingles(words(lower(t)), n)):
            for k in by[x]:
                shared[k] += 1
        for k, m in shared.items():
            if m >= threshold * len(known[k][1]) - 1e-9:
                out.add((d, known[k][0], m, len(known[k][1])))
    return out


def top_k(rows: list[tuple], is_query, k: int = 5) -> list[tuple]:
    fine = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in fine]
    out = []
    for at, (q, v) in enumerate(ints):
        if is_query(q):
            others = [
                (-sum(a * b for a, b in zip(v, w, strict=True)), i)
                for pos, (i, w) in enumerate(ints)
                if pos != at and len(w) == len(v)
            ]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)
