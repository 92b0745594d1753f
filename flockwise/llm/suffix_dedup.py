"""Repeated passages by suffix arrays: every byte is removed that a `length`-byte string covers which also starts in a document
of smaller id.

Documents are packed into chunks of about CHUNK bytes. In each `length`-byte window the GRAM-byte string of least hash is its
anchor; equal windows have equal anchors, and neighbouring windows mostly share theirs. A run of windows with one anchor, and the
bytes that they span, is a context; a chunk's equal contexts are one, with their smallest id.

First exchange: contexts meet by anchor, as hashes of 104 bits and more. An anchor with one context only is settled: its smallest id holds for all of
its windows. Second exchange: the contexts of other anchors go, as bytes, to the anchor's bucket. There shards of at most SHARD
bytes get a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's rule, which group equal windows; the
shards' sorted windows are merged by binary search, and each window gets the smallest id that holds it. Chunks then cut their
documents.

A passage of a third of all documents sends one entry from each chunk. What follows such a passage differs from document to
document, and so do the contexts of its last anchors: a chunk that has more than MANY of an anchor says only that, and the windows of anchors
with HOT contexts or more are dealt out each by its own hash, and as hashes (of 96 bits) only.

Chunks are written first, as a bucketed table, so that all passes see the same ones, joins needn't move them, and a lost executor
costs its tasks only.

Defined results: a null text is empty; a document shorter than `length` keeps all; a null id takes no part and keeps all; rows that
share an id never remove bytes of one another; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, map_texts, mix, ragged, span_hash, table, text_chunks

LENGTH, GRAM, CHUNK, SHARD = 50, 20, 1 << 21, 1 << 22
BUCKETS, BUCKET_BYTES = 256, 1 << 25
MANY, HOT = 16, 512
NO_ID = np.iinfo(np.int64).max
_ODD = np.random.default_rng(10).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, text) -> chunk, ids (NO_ID: null), lens, data: the texts' bytes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lens, data, total = [], [], [], 0
        codec = pa.Codec("zstd", compression_level=6)

        def pack():
            i, n, raw = np.concatenate(ids), np.concatenate(lens), b"".join(data)
            one = [pa.array([uuid.uuid4().int >> 65]), pa.array([i.tolist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int32())), pa.array([codec.compress(raw, asbytes=True)])]
            return pa.record_batch(one, names=["chunk", "ids", "lens", "data"])

        for batch in batches:
            known = batch.column(0).fill_null(NO_ID).to_numpy()
            for i, buf, offs in text_chunks(batch.column(1), size):
                if total and total + len(buf) > size:
                    yield pack()
                    ids, lens, data, total = [], [], [], 0
                ids.append(known[i : i + len(offs) - 1])
                lens.append(np.diff(offs))
                data.append(buf.tobytes())
                total += len(buf)
        if ids:
            yield pack()

    return map_texts(docs, run, "chunk bigint, ids array<bigint>, lens array<int>, data binary")


def gram_hashes(raw: bytes, gram: int) -> np.ndarray:
    """Of the `gram` bytes (8 at least) from each place on."""
    n = len(raw) - 7
    w = np.empty(n, np.uint64)
    for o in range(8):
        w[o::8] = np.frombuffer(raw, "<u8", (len(raw) - o) // 8, o)
    w = (w ^ (w >> np.uint64(32))) * _ODD[0]
    w ^= w >> np.uint64(29)
    m = len(raw) - gram + 1
    g = w[:m].copy()
    for k, o in enumerate([*range(8, gram - 8, 8), gram - 8]):
        g += w[o : o + m] * _ODD[1 + k]
    return mix(g)


class Chunk:
    """A chunk's documents; its contexts in the order of their places (s0 and s1: first and last window), and its distinct contexts
    in the order of anchor and context hash (at: one that has it; least: smallest id; kh: anchor hash)."""

    def __init__(self, batch: pa.RecordBatch, r: int, length: int, gram: int):
        self.number, self.length, self.gram = batch.column("chunk")[r].as_py(), length, gram
        self.ids = batch.column("ids")[r].values.to_numpy(zero_copy_only=False)
        self.offs = np.r_[0, np.cumsum(batch.column("lens")[r].values.to_numpy(zero_copy_only=False).astype(np.int64))]
        n = int(self.offs[-1])
        self.raw = pa.Codec("zstd").decompress(batch.column("data")[r].as_py(), n, asbytes=True) if n else b""
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.s0 = self.s1 = self.doc = self.which = self.at = self.least = np.zeros(0, np.int64)
        self.kh = self.cx = np.zeros(0, np.uint64)
        if n < length:
            return
        self.g = gram_hashes(self.raw, gram)
        low = np.uint64((1 << 32) - 1)
        m, have, want = (self.g & ~low) | np.arange(len(self.g), dtype=np.uint64), 1, length - gram + 1
        while have * 2 <= want:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if want > have:
            m = np.minimum(m[: len(m) - (want - have)], m[want - have :])
        valid = np.ones(n - length + 1, bool)  # windows within one document that has an id
        size = np.minimum(np.diff(self.offs), length - 1)
        row, place = ragged(size)
        cross = self.offs[1:][row] - 1 - place
        valid[cross[cross < len(valid)]] = False
        for d in np.flatnonzero(self.ids == NO_ID).tolist():
            valid[self.offs[d] : self.offs[d + 1]] = False
        new = np.ones(len(valid), bool)
        new[1:] = (m[1:] != m[:-1]) | ~valid[:-1]
        last = np.ones(len(valid), bool)
        last[:-1] = new[1:] | ~valid[1:]
        self.s0, self.s1 = np.flatnonzero(new & valid), np.flatnonzero(last & valid)
        if not len(self.s0):
            return
        self.doc = self.ids[np.searchsorted(self.offs, self.s0, "right") - 1]
        kh = mix(self.g[(m[self.s0] & low).astype(np.int64)] ^ _ODD[6])
        g, end = self.g, self.s1 + length
        cx = mix(g[self.s0] * _ODD[0] + g[self.s0 + gram] * _ODD[1] + g[end - 2 * gram] * _ODD[2] + g[end - gram] * _ODD[3] + (end - self.s0).astype(np.uint64) * _ODD[4])
        order = np.lexsort((cx, kh))
        k, c = kh[order], cx[order]
        head = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
        first = np.flatnonzero(head)
        self.at, self.kh, self.cx = order[first], k[first], c[first]
        self.least = np.minimum.reduceat(self.doc[order], first)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(head) - 1

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is said of the contexts: anchor hash, context hash, smallest id, and each context's entry. An anchor of more than MANY
        contexts has one entry, of context 0."""
        if not len(self.kh):
            return self.kh, self.cx, self.least, np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.r_[True, self.kh[1:] != self.kh[:-1]]
        group = np.cumsum(new) - 1
        many = (np.bincount(group) > MANY)[group]
        keep = np.flatnonzero(~many | new)
        entry = np.cumsum(~many | new) - 1
        cx = np.where(many, np.uint64(0), np.maximum(self.cx, np.uint64(1)))
        return self.kh[keep], cx[keep], np.minimum.reduceat(self.least, keep), entry, keep

    def window_hashes(self, a: np.ndarray, k: int = 0) -> np.ndarray:
        g = self.g
        return mix(g[a] * _ODD[k] + g[a + self.gram] * _ODD[k + 1] + g[a + self.length - self.gram] * _ODD[k + 2])

    def unsettled(self, replies) -> tuple:
        """Applies what the first exchange said. What goes on, in a fixed order: contexts (indices), then single windows (their
        smallest ids and hashes, and for each window of a hot context its context, place within it and single window)."""
        entry = self.entries()[3]
        flag = np.zeros(len(entry) + 1, np.uint8)
        value = np.full(len(entry) + 1, NO_ID)
        for r in replies or []:
            i = np.frombuffer(r["idx"], np.uint32)
            flag[i], value[i] = np.frombuffer(r["flag"], np.uint8), np.frombuffer(r["val"], np.int64)
        if len(entry):
            settled = flag[entry] == 0
            self.least = np.where(settled, np.minimum(self.least, value[entry]), self.least)
        part = np.flatnonzero(flag[entry] == 1) if len(entry) else entry
        hot = np.flatnonzero(flag[entry] == 2) if len(entry) else entry
        n = self.s1[self.at[hot]] - self.s0[self.at[hot]] + 1
        row, place = ragged(n)
        a = self.s0[self.at[hot]][row] + place
        if not len(a):
            return part, a, np.zeros(0, np.uint64), hot[row], place, a
        wh = self.window_hashes(a)
        wh, first, back = np.unique(wh, return_index=True, return_inverse=True)
        self.places = a[first]
        least = np.full(len(first), NO_ID)
        np.minimum.at(least, back, self.least[hot][row])
        return part, least, wh, hot[row], place, back


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """text: symbols from 1, each part closed by a 0 (at `ends`), no two of which are equal -> suffixes in order, common prefix
    with the one before. Larsson-Sadakane: groups of equal prefixes are refined by the rank `h` further on, h doubling."""
    n = len(text)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(7):
        symbol = np.zeros(n, np.int64)
        symbol[: n - j] = text[j:]
        key = key << 9 | np.where(j <= to_end, symbol, 0)
    sa = np.argsort(key, kind="stable")
    head = np.r_[True, key[sa[1:]] != key[sa[:-1]]] | (to_end[sa] < 7)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 7
    while True:
        alone = head & np.r_[head[1:], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        s = sa[open_]
        pair = rank[s] * (n + 1) + rank[s + h]
        order = np.argsort(pair, kind="stable")
        sa[open_], pair = s[order], pair[order]
        head[open_] = np.r_[True, pair[1:] != pair[:-1]]
        rank[sa[open_]] = np.maximum.accumulate(np.where(head, np.arange(n), 0))[open_]
        h *= 2
    # Kasai: in the order of the text a common prefix is one shorter than the last at least, and just that where the symbols
    # before are equal; only the others are compared
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    same = np.zeros(n, bool)
    same[1:] = (before[1:] > 0) & (text[:-1] != 0) & (text[:-1] == text[np.maximum(before[1:], 1) - 1])
    at = np.flatnonzero(~same & (before >= 0))
    size, live = np.zeros(n, np.int64), at
    while len(live):
        x, y = live + size[live], before[live] + size[live]
        live = live[(key[x] == key[y]) & (to_end[x] >= 7) & (to_end[y] >= 7)]
        size[live] += 7
    live = at
    while len(live):
        x, y = live + size[live], before[live] + size[live]
        live = live[(text[x] == text[y]) & (text[x] != 0)]
        size[live] += 1
    plcp = np.maximum.accumulate(np.where(same, -1, size + i)) - i
    return sa, plcp[sa]


def sorted_windows(data: np.ndarray, offs: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts data[offs[i]:offs[i+1]] of documents ids[i] -> their different windows, sorted, and the smallest id of each."""
    m = len(offs) - 1
    size = np.diff(offs)
    text = np.zeros(len(data) + m, np.int64)
    row, place = ragged(size)
    text[offs[:-1][row] + row + place] = data.astype(np.int64) + 1
    ends = offs[1:] + np.arange(m)
    sa, lcp = suffix_array(text, ends)
    part = np.searchsorted(ends, sa)
    ok = ends[part] - sa >= length
    first = np.flatnonzero((lcp < length) & ok)
    head = np.full(len(sa), False)
    head[first] = True
    group = np.cumsum(head[ok]) - 1
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, group, ids[part[ok]])
    return _windows(data, (sa - part)[first], length), least


def _windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    rows = np.lib.stride_tricks.sliding_window_view(data, length)[at] if len(at) else np.zeros((0, length), np.uint8)
    return np.ascontiguousarray(rows).view(f"S{length}").ravel()


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted windows of shards, each found in the others by binary search -> all of them, and their smallest ids."""
    w, least = parts[0]
    for v, ids in parts[1:]:
        at = np.searchsorted(w, v)
        hit = np.zeros(len(v), bool)
        inside = at < len(w)
        hit[inside] = w[at[inside]] == v[inside]
        least[at[hit]] = np.minimum(least[at[hit]], ids[hit])
        least = np.insert(least, at[~hit], ids[~hit])
        w = np.insert(w, at[~hit], v[~hit])
    return w, least


def smallest_ids(key: np.ndarray, data: np.ndarray, offs: np.ndarray, ids: np.ndarray, length: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of each context, in turn: the smallest id that holds it; and the n+1 places of the contexts in them."""
    n = np.diff(offs) - length + 1
    places = np.r_[0, np.cumsum(n)]
    what = span_hash(data, offs[:-1], offs[1:]) ^ mix(key)
    _, first, back = np.unique(what, return_index=True, return_inverse=True)
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, back, ids)
    out = np.repeat(least[back], n)
    # anchors with one context have met all of their equals
    _, of, count = np.unique(key[first], return_inverse=True, return_counts=True)
    rest = np.flatnonzero(count[of] > 1)
    if not len(rest):
        return out, places
    rest = rest[np.argsort(first[rest])]
    size = np.diff(offs)[first[rest]]
    row, place = ragged(size)
    text, o = data[offs[first[rest]][row] + place], np.r_[0, np.cumsum(size)]
    cut = np.unique(np.searchsorted(o, np.arange(0, o[-1] + shard, shard)))
    cut = np.unique(np.r_[0, np.minimum(cut, len(size)), len(size)])
    parts = [sorted_windows(text[o[a] : o[b]], o[a : b + 1] - o[a], least[rest[a:b]], length) for a, b in zip(cut, cut[1:], strict=False)]
    w, found = merged(parts)
    value = np.full(len(first), -1)
    value[rest] = np.arange(len(rest))
    again = np.flatnonzero(value[back] >= 0)
    nw = size - length + 1
    r, p = ragged(nw)
    mine = found[np.searchsorted(w, _windows(text, o[r] + p, length))]
    wo = np.r_[0, np.cumsum(nw)]
    r, p = ragged(n[again])
    out[places[again][r] + p] = mine[wo[value[back[again]]][r] + p]
    return out, places


def _narrow(x: np.ndarray) -> tuple[int, bytes, int]:
    """Base, offsets from it in as few bytes as they need, and that number."""
    base = int(x.min()) if len(x) else 0
    most = int(x.max()) - base if len(x) else 0
    width = 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return base, (x - base).astype(f"<u{width}").tobytes(), width


def _wide(base: int, raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}").astype(np.int64) + base


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of equal buckets."""
    if not len(bucket):
        return []
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True))


def _table(rows: list[dict], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, kind)


SAID = pa.schema({"bucket": pa.int64(), "chunk": pa.int64(), "start": pa.int32(), "hash": pa.binary(), "more": pa.binary(), "base": pa.int64(), "width": pa.int32(), "id": pa.binary()})
TOLD = pa.schema({"chunk": pa.int64(), "idx": pa.binary(), "val": pa.binary(), "flag": pa.binary()})
SENT = pa.schema({"bucket": pa.int64(), "chunk": pa.int64(), "item": pa.binary(), "size": pa.binary(), "more": pa.binary(), "key": pa.binary(), "base": pa.int64(), "width": pa.int32(), "id": pa.binary(), "data": pa.binary()})
BACK = pa.schema({"chunk": pa.int64(), "item": pa.binary(), "n": pa.binary(), "id": pa.binary()})


def _sql(kind: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {({pa.int64(): 'bigint', pa.int32(): 'int', pa.binary(): 'binary'})[f.type]}" for f in kind)


def meet(group: pa.Table) -> pa.Table:
    """First exchange, in a bucket: anchors with one context are settled (flag 0), others aren't (1; hot: 2)."""
    rows = group.to_pylist()
    size = np.array([len(r["hash"]) // 8 for r in rows])
    code = np.frombuffer(b"".join(r["hash"] for r in rows), np.uint64)
    more = np.frombuffer(b"".join(r["more"] for r in rows), np.uint32)
    ids = np.concatenate([_wide(r["base"], r["id"], r["width"]) for r in rows])
    row, place = ragged(size)
    order = np.lexsort((more, code))
    c, x = code[order], more[order]
    anchor = c >> np.uint64(32)
    new = np.r_[True, anchor[1:] != anchor[:-1]]
    other = new | np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1])]
    group_of = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    n_ctx = np.add.reduceat(other.astype(np.int64), first)
    marked = np.maximum.reduceat(((c & np.uint64(0xFFFFFFFF)) == 0) & (x == 0), first)
    least = np.minimum.reduceat(ids[order], first)[group_of]
    flag = np.where(marked | (n_ctx >= HOT), 2, np.where(n_ctx > 1, 1, 0))[group_of].astype(np.uint8)
    tell = (flag > 0) | (ids[order] > least)
    order, flag, least = order[tell], flag[tell], least[tell]
    back = np.argsort(row[order], kind="stable")
    order, flag, least = order[back], flag[back], least[back]
    idx = (np.array([r["start"] for r in rows])[row[order]] + place[order]).astype(np.uint32)
    out = [{"chunk": rows[k]["chunk"], "idx": idx[a:b].tobytes(), "val": least[a:b].tobytes(), "flag": flag[a:b].tobytes()} for k, a, b in _cuts(row[order])]
    return pa.Table.from_batches([_table(out, TOLD)])


def settle(group: pa.Table, length: int, shard: int) -> pa.Table:
    """Second exchange, in a bucket: runs of windows with one smallest id, of what it isn't its own."""
    rows = group.to_pylist()
    item = [np.frombuffer(r["item"], np.uint32) for r in rows]
    per = np.array([len(x) for x in item])
    size = np.frombuffer(b"".join(r["size"] for r in rows), np.uint16).astype(np.int64)
    key = np.frombuffer(b"".join(r["key"] for r in rows), np.uint64)
    ids = np.concatenate([_wide(r["base"], r["id"], r["width"]) for r in rows])
    data = np.frombuffer(b"".join(r["data"] for r in rows), np.uint8)
    more = np.frombuffer(b"".join(r["more"] for r in rows), np.uint32)
    single = np.flatnonzero(size == 0)  # windows as hashes; those that are equal need no more
    n = np.where(size > 0, size - length + 1, 1)
    places = np.r_[0, np.cumsum(n)]
    least = np.zeros(places[-1], np.int64)
    order = single[np.lexsort((more[single], key[single]))]
    if len(order):
        k, m = key[order], more[order]
        head = np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])]
        least[places[order]] = np.minimum.reduceat(ids[order], np.flatnonzero(head))[np.cumsum(head) - 1]
    part = np.flatnonzero(size > 0)
    if len(part):
        found, _ = smallest_ids(key[part], data, np.r_[0, np.cumsum(size[part])], ids[part], length, shard)
        row, place = ragged(n[part])
        least[places[part][row] + place] = found
    tell = np.minimum.reduceat(least, places[:-1]) < ids
    head = np.r_[True, least[1:] != least[:-1]]
    head[places[:-1]] = True
    at = np.flatnonzero(head)
    which = np.searchsorted(places, at, "right") - 1
    n = np.diff(np.r_[at, len(least)])
    ok = tell[which]
    at, which, n = at[ok], which[ok], n[ok]
    row = np.repeat(np.arange(len(per)), per)[which]
    item = np.concatenate(item)[which]
    out = [{"chunk": rows[k]["chunk"], "item": item[a:b].tobytes(), "n": n[a:b].astype(np.uint16).tobytes(), "id": least[at[a:b]].tobytes()} for k, a, b in _cuts(row)]
    return pa.Table.from_batches([_table(out, BACK)])


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """-> doc_id, n_bytes, spans: array<struct<start,end>> of the bytes to remove, kept: the bytes that stay."""
    if not (gram >= 16 and 2 * gram <= length <= 3 * gram and 2 * length <= 5 * gram):
        raise ValueError("hashes of `gram` bytes must cover all of a window and a context")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = bucketed(chunks(texts, chunk), "chunk", dealt)
    total = parts.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("bytes")).first()["bytes"] or 0
    bits = max(BUCKETS.bit_length() - 1, int(total // BUCKET_BYTES).bit_length())
    top = np.uint64(64 - bits)

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                c = Chunk(batch, r, length, gram)
                kh, cx, least, _, _ = c.entries()
                code = ((kh << np.uint64(bits)) & ~np.uint64(0xFFFFFFFF)) | (cx >> np.uint64(32))
                more = cx.astype(np.uint32)  # the lower half
                out = []
                for bucket, a, b in _cuts((kh >> top).astype(np.int64)):
                    base, raw, width = _narrow(least[a:b])
                    out.append({"bucket": bucket, "chunk": c.number, "start": a, "hash": code[a:b].tobytes(), "more": more[a:b].tobytes(), "base": base, "width": width, "id": raw})
                yield _table(out, SAID)

    told = parts.mapInArrow(say, _sql(SAID)).groupBy("bucket").applyInArrow(meet, _sql(TOLD))
    told = bucketed(told.groupBy("chunk").agg(F.collect_list(F.struct("idx", "val", "flag")).alias("told")), "chunk", dealt)  # a chunk's entries at most
    known = parts.join(told, "chunk", "left").select("chunk", "ids", "lens", "data", "told")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                c = Chunk(batch, r, length, gram)
                part, least, wh, _, _, _ = c.unsettled(batch.column("told")[r].as_py())
                a = np.r_[c.s0[c.at[part]], np.zeros(len(wh), np.int64)]
                b = np.r_[c.s1[c.at[part]] + length, np.zeros(len(wh), np.int64)]
                ids, key = np.r_[c.least[part], least], np.r_[c.kh[part], wh]
                more = np.r_[np.zeros(len(part), np.uint32), (c.window_hashes(c.places, 3) if len(wh) else wh).astype(np.uint32)]
                bucket = (key >> top).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                a, b, ids, key, more = a[order], b[order], ids[order], key[order], more[order]
                size = (b - a).astype(np.uint16)
                row, place = ragged(b - a)
                raw, ends = c.buf[a[row] + place].tobytes(), np.r_[0, np.cumsum(b - a)]
                out = []
                for bucket_, x, y in _cuts(bucket[order]):
                    base, narrow, width = _narrow(ids[x:y])
                    out.append({"bucket": bucket_, "chunk": c.number, "item": order[x:y].astype(np.uint32).tobytes(), "size": size[x:y].tobytes(), "more": more[x:y].tobytes(), "key": key[x:y].tobytes(), "base": base, "width": width, "id": narrow, "data": raw[ends[x] : ends[y]]})
                yield _table(out, SENT)

    sent = known.mapInArrow(send, _sql(SENT))
    back = sent.groupBy("bucket").applyInArrow(lambda t: settle(t, length, shard), _sql(BACK))
    back = back.groupBy("chunk").agg(F.collect_list(F.struct("item", "n", "id")).alias("back"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                c = Chunk(batch, r, length, gram)
                part, least, _, hot, hot_place, single = c.unsettled(batch.column("told")[r].as_py())
                # values of the windows of the distinct contexts, and of those that went on
                n = (c.s1 - c.s0 + 1)[c.at]
                start = np.r_[0, np.cumsum(n)]
                value = np.repeat(c.least, n)
                item_n = np.r_[n[part], np.ones(len(least), np.int64)].astype(np.int64)
                item_start = np.r_[0, np.cumsum(item_n)]
                item_value = np.repeat(np.r_[c.least[part], least], item_n)
                for x in batch.column("back")[r].as_py() or []:
                    item, m, ids = np.frombuffer(x["item"], np.uint32).astype(np.int64), np.frombuffer(x["n"], np.uint16).astype(np.int64), np.frombuffer(x["id"], np.int64)
                    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
                    before = np.cumsum(m) - m
                    begin = item_start[item] + before - np.repeat(before[first], np.diff(np.r_[first, len(item)]))
                    row, place = ragged(m)
                    item_value[begin[row] + place] = ids[row]
                row, place = ragged(n[part])
                value[start[part][row] + place] = item_value[: item_start[len(part)]]
                value[start[hot] + hot_place] = item_value[item_start[len(part)] :][single]
                # windows that stand in a document of smaller id; a context of one id throughout in one step
                gone = np.zeros(len(c.buf) + 1, np.int32)
                row, place = ragged(c.s1 - c.s0 + 1)
                hit = value[start[c.which[row]] + place] < c.doc[row]
                s = (c.s0[row] + place)[hit]
                gone[: len(c.buf)] += np.bincount(s, minlength=len(c.buf)).astype(np.int32)
                gone -= np.bincount(s + length, minlength=len(gone)).astype(np.int32)
                cover = np.cumsum(gone[:-1]) > 0
                edge = np.zeros(len(cover) + 1, bool)
                edge[c.offs] = True
                lo = np.flatnonzero(cover & ~(np.r_[False, cover[:-1]] & ~edge[:-1]))
                hi = np.flatnonzero(cover & ~(np.r_[cover[1:], False] & ~edge[1:])) + 1
                cut, base = np.searchsorted(lo, c.offs), c.offs[np.searchsorted(c.offs, lo, "right") - 1]
                spans = pa.StructArray.from_arrays([pa.array(lo - base), pa.array(hi - base)], names=["start", "end"])
                kept, ends = c.buf[~cover].tobytes(), np.r_[0, np.cumsum(~cover)][c.offs].tolist()
                ids = pa.array(c.ids, mask=c.ids == NO_ID)
                yield pa.record_batch([ids, pa.array(np.diff(c.offs)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), spans), pa.array([kept[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return known.join(back, "chunk", "left").select("chunk", "ids", "lens", "data", "told", "back").mapInArrow(remove, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
