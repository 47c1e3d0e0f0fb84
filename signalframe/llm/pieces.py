"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

White space is written as the marker U+2581 and a text begins with one, as usual.  Inside, the marker is the byte 0x20,
which makes it one step of the trie; a marker that a text itself holds goes through byte fallback, so that decoding gives
back every text exactly.  A character without a piece costs the lowest score less ``UNKNOWN`` and becomes byte pieces.

A text is cut where no piece can reach across (before white space, around ASCII bytes that no piece holds); equal segments
of a chunk are segmented once.  All segments walk the trie together, one numpy step for each depth, and Viterbi runs over all
of them position by position.  Ties go to the path whose last piece begins first.

Defined cases: null and empty texts have no pieces; rows are independent, so ties and repeated rows need no care;
very long segments are handled one by one in time linear in their length; extra columns are kept by ``encode``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .kernels import SpanHash, chunks, distinct, flat, lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = 10.0
MARK = "▁"
CHUNK = 1 << 20  # bytes of text that walk the trie together
LONG = 192  # bytes; longer segments go one by one


class DoubleArray:
    """``base[s] + byte`` is the next state if ``check`` there says ``s``; ``value`` is the piece that ends in a state, or -1."""

    def __init__(self, words: list[bytes], values: list[int]):
        root: dict = {}
        for w, v in zip(words, values):
            node = root
            for b in w:
                node = node.setdefault(b, {})
            node[-1] = v
        size = 1 << 12
        base, check, value, free = [0] * size, [-1] * size, [-1] * size, 1
        check[0] = 0
        queue = [(0, root)]
        for state, node in queue:
            value[state] = node.get(-1, -1)
            steps = sorted(b for b in node if b >= 0)
            if not steps:
                continue
            while check[free] >= 0:
                free += 1
                if free + 600 > len(check):
                    base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
            at = max(1, free - steps[0])
            while True:
                if at + 600 > len(check):
                    base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
                if all(check[at + b] < 0 for b in steps):
                    break
                at += 1
            base[state] = at
            free = max(free, at + steps[0] - 256)  # leave gaps behind rather than search them again and again
            for b in steps:
                check[at + b] = state
                queue.append((at + b, node[b]))
        pad = [0] * 512
        self.base, self.check, self.value = (np.array(x + y, np.int32) for x, y in ((base, pad), (check, [-1] * 512), (value, [-1] * 512)))


class Pieces:
    """Piece strings, log scores and byte pieces of a model file, as arrays."""

    def __init__(self, names: list[str], scores: list[float], byte_ids: list[int], skip: set[int]):
        normal = [i for i in range(len(names)) if i not in skip and names[i]]
        raw = [n.encode().replace(MARK.encode(), b" ") for n in names]
        self.trie = DoubleArray([raw[i] for i in normal], normal)
        self.score = np.array(scores, np.float64)
        self.unknown = float(min(scores[i] for i in normal)) - UNKNOWN
        self.byte_ids = np.array(byte_ids, np.int32)
        self.ids_byte = {i: b for b, i in enumerate(byte_ids)}
        out = [bytes([self.ids_byte[i]]) if i in self.ids_byte else b"" if i in skip else raw[i] for i in range(len(names))]
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.edges = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self.longest = max(len(raw[i]) for i in normal)
        self.is_byte = np.zeros(len(names), bool)
        self.is_byte[self.byte_ids] = True
        used = np.zeros(256, bool)
        used[list(set(b"".join(raw[i] for i in normal)))] = True
        self.alone = ~used
        self.alone[128:] = False
        #: whether a marker may follow another byte inside a piece; then texts aren't cut before white space
        self.crosses = any(b" " in raw[i].lstrip(b" ") for i in normal)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        byte_ids = [0] * 256
        for i in ids:
            if m.is_byte(i):
                byte_ids[int(m.id_to_piece(i)[3:5], 16)] = i
        skip = {i for i in ids if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        return cls([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], byte_ids, skip)

    def _matches(self, buf, stop):
        """All pieces at all positions: (start, length, id) by rising length; ``stop``: each position's segment end."""
        t = self.trie
        at, state = np.arange(len(buf)), np.zeros(len(buf), np.int32)
        starts, lengths, ids = [], [], []
        for depth in range(self.longest):
            go = at + depth < stop[at]
            at, state = at[go], state[go]
            nxt = t.base[state] + buf[at + depth]
            ok = t.check[nxt] == state
            at, state = at[ok], nxt[ok]
            if not len(at):
                break
            v = t.value[state]
            end = v >= 0
            starts.append(at[end])
            ids.append(v[end])
            lengths.append(np.full(int(end.sum()), depth + 1, np.int32))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int32) for x in (starts, lengths, ids))

    def viterbi(self, buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The best segmentation of each segment: a piece id at each byte where a piece starts, -1 elsewhere."""
        n = len(buf)
        out = np.full(n, -1, np.int32)
        if not n:
            return out
        size = np.diff(edges)
        seg = np.repeat(np.arange(len(size)), size)
        pos = np.arange(n) - edges[seg]
        start, length, piece = self._matches(buf, edges[1:][seg])
        width = np.where(buf < 0x80, 1, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4)))
        first = np.flatnonzero((buf & 0xC0) != 0x80)
        width[first] = np.minimum(width[first], edges[1:][seg[first]] - first)
        single = np.zeros(n, bool)
        single[start[length == width[start]]] = True
        lone = first[~single[first]]
        start, length, piece = np.concatenate([start, lone]), np.concatenate([length, width[lone]]).astype(np.int64), np.concatenate([piece, np.full(len(lone), -1, np.int32)])
        score = np.where(piece >= 0, self.score[piece], self.unknown)
        best, back, by = np.full(n + len(size), -np.inf), np.zeros(n + len(size), np.int32), np.full(n + len(size), -1, np.int32)
        node = start + seg[start]  # each segment has a place more than bytes
        best[edges[:-1] + np.arange(len(size))] = 0
        long = size[seg[start]] > LONG
        short = np.flatnonzero(~long)
        key = pos[start[short]] * (self.longest + 8) + length[short]
        order = short[np.argsort(key.astype(np.uint32 if key.max(initial=0) > 65535 else np.uint16), kind="stable")]
        key = pos[start[order]] * (self.longest + 8) + length[order]
        cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        node_o, len_o, score_o, piece_o = node[order], length[order], score[order], piece[order]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            to = node_o[a:b] + len_o[a]
            s = best[node_o[a:b]] + score_o[a:b]
            up = s > best[to]
            to = to[up]
            best[to], back[to], by[to] = s[up], len_o[a], piece_o[a:b][up]
        if long.any():
            o = np.flatnonzero(long)
            o = o[np.lexsort((length[o], node[o]))]
            score_of, from_, by_ = dict(), dict(), dict()
            for s, l, v, p in zip(node[o].tolist(), length[o].tolist(), score[o].tolist(), piece[o].tolist()):
                base = score_of.get(s, best[s])
                if base + v > score_of.get(s + l, -np.inf):
                    score_of[s + l], from_[s + l], by_[s + l] = base + v, l, p
            at = np.fromiter(from_, np.int64, len(from_))
            back[at], by[at] = np.fromiter(from_.values(), np.int32, len(at)), np.fromiter(by_.values(), np.int32, len(at))
        # backwards from every segment's end
        lane = np.arange(len(size))
        here = edges[1:] + lane
        floor = edges[:-1] + lane
        while True:
            go = here > floor
            lane, here, floor = lane[go], here[go], floor[go]
            if not len(lane):
                return out
            step, p = back[here], by[here]
            here = here - step
            byte = here - lane
            known = p >= 0
            out[byte[known]] = p[known]
            for i in range(4):
                more = ~known & (step > i)
                out[byte[more] + i] = self.byte_ids[buf[byte[more] + i]]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, concatenated, and their offsets."""
        filled = np.diff(offs) > 0
        new_offs = offs + np.concatenate([[0], np.cumsum(filled)])
        text = np.full(int(new_offs[-1]), 0x20, np.uint8)
        doc = np.repeat(np.arange(len(filled)), np.diff(offs))
        text[np.arange(len(buf)) + np.cumsum(filled)[doc]] = buf
        begin = np.zeros(len(text) + 1, bool)
        begin[new_offs] = True
        alone = self.alone[text]
        begin[:-1] |= alone
        begin[1:] |= alone
        if not self.crosses:
            space = text == 0x20
            begin[1:-1] |= space[1:] & ~space[:-1]
        edges = np.flatnonzero(begin) if len(text) else np.zeros(1, np.int64)
        a, b = edges[:-1], edges[1:]
        first, cls, _ = distinct(SpanHash(text)(a, b))
        size = (b - a)[first]
        inner = np.concatenate([[0], np.cumsum(size)])
        piece = self.viterbi(text[np.repeat(a[first] - inner[:-1], size) + np.arange(inner[-1])], inner)
        real = piece >= 0
        counts = np.add.reduceat(real.astype(np.int64), inner[:-1]) if len(size) else np.zeros(0, np.int64)
        ids, at = piece[real], np.concatenate([[0], np.cumsum(counts)])
        n = counts[cls]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(at[cls] - ends[:-1], n) + np.arange(ends[-1])] if len(n) else np.zeros(0, np.int32)
        return out, ends[np.searchsorted(edges, new_offs)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, concatenated, and their offsets; the marker that begins a text goes."""
        size = (self.edges[1:] - self.edges[:-1])[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        text = self.bytes[np.repeat(self.edges[ids] - ends[:-1], size) + np.arange(ends[-1])] if len(ids) else np.zeros(0, np.uint8)
        at = ends[offs]
        first = at[:-1][np.diff(at) > 0]
        first = first[text[first] == 0x20]
        gone = np.zeros(len(text) + 1, np.int64)
        gone[first + 1] = 1
        keep = np.ones(len(text), bool)
        keep[first] = False
        return text[keep], at - np.cumsum(gone)[at]


def _strings(text: np.ndarray, offs: np.ndarray) -> pa.Array:
    raw = text.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.string())


def _list(ids: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _with(df: DataFrame, columns: list, fn, setup):
    fields = [f for f in df.schema.fields if f.name not in {c.name for c in columns}]
    schema = T.StructType([*fields, *columns])
    return df.mapInArrow(lean(lambda batches: fn(batches, [f.name for f in fields], setup())), schema)


def encode(df: DataFrame, pieces: Pieces, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the piece ids of ``text``; columns named ``ids`` or ``n_byte_pieces`` are replaced."""
    held = df.sparkSession.sparkContext.broadcast(pieces)  # bounded by the vocabulary file

    def run(batches, names, own):
        for batch in batches:
            for part, buf, offs in chunks(batch, text, CHUNK):
                got, at = own.encode(buf, offs)
                by = np.concatenate([[0], np.cumsum(own.is_byte[got])])[at]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), _list(got, at), pa.array(np.diff(by).astype(np.int64))], [*names, ids, "n_byte_pieces"])

    return _with(df, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField("n_byte_pieces", T.LongType())], run, lambda: held.value)


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the piece ids; a null list gives null."""
    held = df.sparkSession.sparkContext.broadcast(pieces)

    def run(batches, names, own):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                col = part.column(ids)
                flat_ids = col.flatten().to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64))])
                out = _strings(*own.decode(flat_ids, at))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.compute.if_else(col.is_valid(), out, None)], [*names, text])

    import pyarrow.compute  # noqa: F401

    return _with(df, [T.StructField(text, T.StringType())], run, lambda: held.value)


def round_trip(docs: DataFrame, pieces: Pieces, most: int = CHUNK) -> DataFrame:
    """Encode, decode and compare in one pass, at most ``most`` bytes of text at once: ``doc_id, n_bytes, n_pieces, n_byte_pieces, ids, decoded_sha256, exact``."""
    held = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        own = held.value
        for batch in batches:
            for part, buf, offs in chunks(batch, "text", most):
                ids, at = own.encode(buf, offs)
                by = np.concatenate([[0], np.cumsum(own.is_byte[ids])])[at]
                out, ends = own.decode(ids, at)
                raw, given = out.tobytes(), buf.tobytes()
                texts = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                same = [x == given[a:b] for x, a, b in zip(texts, offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(offs)), "n_pieces": pa.array(np.diff(at)), "n_byte_pieces": pa.array(np.diff(by).astype(np.int64)), "ids": _list(ids, at),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), "exact": pa.array(same, pa.bool_()),
                })

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, ids array<int>, decoded_sha256 string, exact boolean")
