"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import defaultdict

import numpy as np

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def encoded(processor, text: str | None) -> tuple[int, str, str]:
    ids = processor.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), sha(b"".join(struct.pack("<I", i) for i in ids)), sha(processor.decode(ids))


def shingles(text: str | None) -> set[tuple[str, ...]]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near_components(docs: dict[int, str | None], percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id -> number of shingles, component."""
    sets = {d: shingles(t) for d, t in docs.items()}
    up = {d: d for d in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holds = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holds[g].append(d)
    seen = set()
    for ds in holds.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {d: (len(sets[d]), root(d)) for d in docs}


def url_rule(url: str | None) -> tuple[str, str, str | None, str | None]:
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"(?s)[^/?#]*", rest)[0]
        path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for act, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (act, h + p)
    return host, path, best and best[1], best and best[0]


def removed(docs: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    first: dict[bytes, int] = {}
    raws = [(i, (t or "").encode()) for i, t in docs]
    for i, r in raws:
        if i is not None:
            for k in range(len(r) - length + 1):
                g = r[k : k + length]
                if first.get(g, i) >= i:
                    first[g] = i
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        if i is not None:
            for k in range(len(r) - length + 1):
                if first[r[k : k + length]] < i:
                    gone[k : k + length] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(r) else 0
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]]) if len(r) else b""
        out.append((len(r), int(gone.sum()), spans, sha(kept)))
    return out


def nearest(vectors: dict[int, list | None], queries: list[int], k: int = 10) -> dict[int, list[tuple[int, float]]]:
    ok = {i: np.array(v, float) for i, v in vectors.items() if v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(v)}
    out = {}
    for q in queries:
        if q in ok:
            d = sorted((float(np.sqrt(((ok[i] - ok[q]) ** 2).sum())), i) for i in ok if i != q)
            out[q] = [(i, s) for s, i in d[:k]]
    return out


def local_alignment(x: list[str], y: list[str]) -> int:
    h = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def auc(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    s = score[order]
    for a in np.unique(s):
        at = np.flatnonzero(s == a)
        rank[order[at]] = at.mean() + 1
    n1, n0 = label.sum(), (1 - label).sum()
    return float((rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
