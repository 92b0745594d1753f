"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece can reach across: before a run of spaces, and between two characters that stand together in no piece.
The different cuts of a batch are merged together: flat arrays of symbols, the least pair rank of each cut by a segmented minimum,
all leftmost merges of it at once, and compaction, until no pair remains. Merging every occurrence at once equals one at a time
where no pair with the new piece ranks before the piece itself; for other pieces only the leftmost is merged.

The model (identity normaliser, dummy prefix, byte fallback) is read on the driver and travels with the task; it is a file of
some hundred kB. Tasks keep the cuts that they have seen, up to CACHE_CUTS of them and CACHE_IDS ids, and nothing else.

Defined results: a null text is empty, an empty text is the begin and end ids alone; repeated rows each have their result; empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, ragged, span_hash, table, text_chunks

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
CACHE_CUTS, CACHE_IDS = 200_000, 1 << 22
FAR = np.int64(1 << 40)


def _fields(raw: bytes):
    """(number, value) of a protobuf message's fields; values of 4 or 8 bytes and strings as bytes."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[i : i + n]
            i += n


class Pieces:
    """A BPE model file's tables."""

    def __init__(self, raw: bytes):
        pieces, scores, kinds = [], [], []
        for n, v in _fields(raw):
            if n == 1:
                f = dict(_fields(v))
                pieces.append(f[1].decode())
                scores.append(float(np.frombuffer(f.get(2, bytes(4)), "<f4")[0]))
                kinds.append(f.get(3, NORMAL))
        self.n, self.kinds = len(pieces), np.array(kinds)
        self.bos, self.eos = pieces.index("<s>"), pieces.index("</s>")
        ids = {p: i for i, p in enumerate(pieces) if kinds[i] in (NORMAL, USER, UNUSED)}
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(pieces):
            if kinds[i] == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        # ranks: equal scores rank alike, the best is 0
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        self.rank = np.full(self.n, FAR)
        for i in ids.values():
            self.rank[i] = order[scores[i]]
        pairs, near = {}, set()
        for p, i in ids.items():
            near.update(zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None:
                    pairs[a << 20 | b] = i
        chars = {c for p in ids if len(p) > 1 for c in p}
        if not all(c in ids for c in chars):
            raise ValueError("a piece holds a character that is no piece")
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)
        least = np.full(self.n, FAR)  # of the pairs that a piece is part of
        for part in (self.pair_key >> 20, self.pair_key & 0xFFFFF):
            np.minimum.at(least, part, self.rank[self.pair_to])
        self.proper = least > self.rank
        singles = sorted((ord(" " if p == SPACE else p), i) for p, i in ids.items() if len(p) == 1)
        self.char = np.array([c for c, _ in singles], np.int64)
        self.char_id = np.array([i for _, i in singles], np.int64)
        code = lambda c: 32 if c == SPACE else ord(c)
        self.near = np.array(sorted(code(a) << 21 | code(b) for a, b in near), np.int64)
        # bytes of each id
        raws = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raws), np.uint8)
        self.raw_len = np.array([len(r) for r in raws], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.led = np.array([p.startswith(SPACE) for p in pieces])

    def _find(self, sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        at, hit = self._find(self.pair_key, left << 20 | right)
        return np.where(hit, self.pair_to[at], -1)

    def merge(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts of these sizes, as flat symbols -> the symbols that remain, and the cuts' sizes."""
        out_sym, out_cut = [], []
        cut = np.repeat(np.arange(len(size)), size)
        to = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            to[:-1] = np.where(cut[1:] == cut[:-1], self.pairs(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(to >= 0, self.rank[to], FAR)
            first = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
            least = np.minimum.reduceat(rank, first)
            n = np.diff(np.r_[first, len(sym)])
            live = np.repeat(least < FAR, n)
            if not live.all():
                out_sym.append(sym[~live])
                out_cut.append(cut[~live])
                if not live.any():
                    break
                sym, cut, to, rank = sym[live], cut[live], to[live], rank[live]
                least, n = least[least < FAR], n[least < FAR]
            at = np.flatnonzero(rank == np.repeat(least, n))
            head = np.r_[True, cut[at[1:]] != cut[at[:-1]]]
            run = np.r_[True, at[1:] != at[:-1] + 1] | head
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[head | ((place % 2 == 0) & self.proper[to[at]])]
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, cut, to = sym[keep], cut[keep], to[keep]
            at = moved[at]
            for x in (at, at[at > 0] - 1):  # pairs that are new
                y = np.minimum(x + 1, len(sym) - 1)
                to[x] = np.where((y > x) & (cut[y] == cut[x]), self.pairs(sym[x], sym[y]), -1)
        if not out_sym:
            return sym, np.zeros(len(size), np.int64)
        sym, cut = np.concatenate(out_sym), np.concatenate(out_cut)
        order = np.argsort(cut, kind="stable")
        return sym[order], np.bincount(cut, minlength=len(size))


class Encoder:
    def __init__(self, raw: bytes):
        self.p = Pieces(raw)
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Encode the cuts buf[a:b] and keep them by key."""
        p = self.p
        group, place = ragged(b - a)
        text = buf[a[group] + place]
        lead = (text & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        n = np.diff(np.r_[at, len(text)])
        b0 = text[at].astype(np.int64)
        cp = np.where(n == 1, b0, b0 & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[np.minimum(n, 4)])
        for k in (1, 2, 3):
            more = n > k
            cp[more] = cp[more] << 6 | (text[at[more] + k] & 0x3F)
        cut = group[at]
        i, hit = p._find(p.char, cp)
        # characters without a piece: their own symbols, which merge with nothing
        sym = np.where(hit, p.char_id[i], p.n + np.arange(len(cp)))
        # cuts of cuts: between characters that no piece has together
        apart = np.r_[True, (cut[1:] != cut[:-1]) | ~p._find(p.near, cp[:-1] << 21 | cp[1:])[1]]
        part = np.cumsum(apart) - 1
        alone = ~hit
        pair_safe = np.where(alone, p.n, sym)
        merged, size = p.merge(pair_safe.copy(), np.bincount(part))
        part_cut = cut[apart]
        # bytes of the characters without a piece
        tok_part = np.repeat(np.arange(len(size)), size)
        bare = merged >= p.n
        reps = np.ones(len(merged), np.int64)
        reps[bare] = n[alone]
        ids = np.repeat(merged, reps)
        if bare.any():
            g, q = ragged(n[alone])
            ids[np.repeat(bare, reps)] = p.byte_id[text[at[alone][g] + q]]
        size_cut = np.bincount(part_cut[np.repeat(tok_part, reps)], minlength=len(a))
        start = np.cumsum(size_cut) - size_cut + len(self.store)
        self.store = np.concatenate([self.store, ids.astype(np.int32)])
        order = np.argsort(known := np.concatenate([self.known, keys]))
        self.known = known[order]
        self.at, self.len = np.concatenate([self.at, start])[order], np.concatenate([self.len, size_cut])[order]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents buf[offs[i]:offs[i+1]] -> all ids, without begin and end, and n+1 places of the documents in them."""
        if b"\xe2\x96\x81" in (whole := buf.tobytes()):  # the space mark itself stands for a space
            docs = [whole[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(offs, offs[1:], strict=False)]
            buf, offs = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
        size = np.diff(offs)
        # a space before each text that isn't empty
        full = size > 0
        wide = np.empty(len(buf) + int(full.sum()), np.uint8)
        new_offs = np.r_[0, np.cumsum(size + full)]
        front = np.zeros(len(wide), bool)
        front[new_offs[:-1][full]] = True
        wide[front], wide[~front] = 32, buf
        if not len(wide):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        gap = wide == 32
        line = (wide == 10) | (wide == 9) | (wide == 13)
        start = front.copy()
        start[1:] |= (gap[1:] & ~gap[:-1]) | line[1:] | line[:-1]
        a = np.flatnonzero(start)
        b = np.r_[a[1:], len(wide)]
        key = span_hash(wide, a, b)
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        i = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = self.known[i] != unique if len(self.known) else np.ones(len(unique), bool)
        if new.any():
            had = len(self.known)
            if had + int(new.sum()) > CACHE_CUTS or len(self.store) > CACHE_IDS:
                self._reset()
                new[:] = True
            self._learn(unique[new], wide, a[first[new]], b[first[new]])
        i = np.searchsorted(self.known, unique)
        at, n = self.at[i][back], self.len[i][back]
        group, place = ragged(n)
        ids = self.store[at[group] + place]
        ends = np.r_[0, np.cumsum(n)]
        return ids, ends[np.searchsorted(a, new_offs)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Texts of ids[offs[i]:offs[i+1]], in UTF-8."""
        p = self.p
        n = p.raw_len[ids]
        group, place = ragged(n)
        raw = p.raw[p.raw_at[ids][group] + place]
        ends = np.r_[0, np.cumsum(n)]
        whole = raw.tobytes()
        out = []
        shown = p.kinds[ids] != CONTROL
        for i, (a, b) in enumerate(zip(ends[offs[:-1]].tolist(), ends[offs[1:]].tolist(), strict=True)):
            text = whole[a:b]
            lo = int(offs[i])
            while lo < offs[i + 1] and not shown[lo]:
                lo += 1
            if lo < offs[i + 1] and p.led[ids[lo]]:  # the dummy prefix
                text = text[1:]
            try:
                text.decode()
            except UnicodeDecodeError:  # byte pieces that are no UTF-8: each bad byte is U+FFFD
                text = b"".join(_mend(text))
            out.append(text)
        return out


def _mend(raw: bytes) -> Iterator[bytes]:
    while raw:
        try:
            raw.decode()
            yield raw
            return
        except UnicodeDecodeError as e:
            yield raw[: e.start]
            yield "�".encode()
            raw = raw[e.start + 1 :]


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """-> doc_id, ids: array<int>, with begin and end ids (`packed`: their little-endian bytes instead), decoded: what the ids decode to."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(model)
        for batch in batches:
            for i, buf, offs in text_chunks(batch.column(1)):
                ids, places = e.encode(buf, offs)
                m = len(offs) - 1
                at = np.r_[0, np.cumsum(np.diff(places) + 2)]
                full = np.empty(at[-1], np.int32)
                edge = np.zeros(at[-1], bool)
                edge[at[:-1]] = edge[at[1:] - 1] = True
                full[~edge] = ids
                full[at[:-1]], full[at[1:] - 1] = e.p.bos, e.p.eos
                text = e.decode(full, at)
                if packed:
                    raw = full.astype("<u4").tobytes()
                    out = pa.array([raw[4 * x : 4 * y] for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.binary())
                else:
                    out = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(full))
                yield pa.record_batch([batch.column(0).slice(i, m), out, pa.array([t.decode() for t in text])], names=["doc_id", "ids", "decoded"])

    return map_texts(docs.select(id_col, text_col), run, f"doc_id {kind}, ids {'binary' if packed else 'array<int>'}, decoded string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    out = encode_texts(table(spark, sf_dir, "documents"), model_bytes(), packed=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
