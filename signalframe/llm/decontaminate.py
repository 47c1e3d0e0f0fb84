"""Benchmark decontamination with suffix arrays of the training texts.

Each task builds, for one shard of documents after another, a suffix array over words by prefix doubling, and
binary-searches the suffixes of the benchmark items in it: the interval is narrowed word by word, so that each
benchmark suffix gets its longest verbatim match with all places.  Reaching ``window`` words (or the whole of a shorter
item) makes the words of every such place hits.

A suffix can only match where its first ``window`` words (or its whole short item) stand.  So each shard first looks its own
windows up in the benchmark's sorted window hashes: work in proportion to the documents, whatever the benchmark's size.
The texts that hold some go into the suffix array, and the suffixes that begin there are searched.

The benchmark goes to the executors in blocks of ``block_bytes`` of text at most (a proven bound).  A task holds one block at
a time; with more blocks it reads them one after another for each shard.

Defined cases: a match of fewer than ``window`` words that isn't a whole item is none, so ``longest`` is 0 there; null or wordless texts have no words and no hits; null or wordless items match nothing; items with the same
text are all reported; rows that share a ``doc_id`` are judged each by itself; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, CHUNK_BYTES, LOWER, U64, SpanHash, _powers, flat, grouped_order, map_chunks, mix, spans

WINDOW = 13
BLOCK_BYTES = 16 << 20
MATCHES = "doc_id long, n_words long, n_hit long, items array<string>, longest long, item_id string, item_word long, doc_word long"


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """A stable order by ``key`` < 2**bits; where key and place fit into 64 bits a plain sort does it."""
    own = int(len(key) - 1).bit_length()
    if bits + own > 64:
        return np.argsort(key, kind="stable")
    packed = (key << U64(own)) | np.arange(len(key), dtype=U64)
    packed.sort()
    return (packed & U64((1 << own) - 1)).astype(np.int64)


def suffix_array(codes: np.ndarray, deepest: int) -> np.ndarray:
    """Suffixes of ``codes`` in lexicographic order (0 sorts first and ends a suffix), exact up to ``deepest`` items.

    Prefix doubling: ranks by 1, 2, 4, ... items; only suffixes whose rank is not yet unique are sorted again."""
    n = len(codes)
    order = grouped_order(codes)
    sorted_codes = codes[order]
    new = np.ones(n, bool)
    new[1:] = sorted_codes[1:] != sorted_codes[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    reach = 1
    while reach < deepest:
        single = np.append(new[1:], True) & new
        at = np.flatnonzero(~single)  # places of the order that are still shared
        at = at[sorted_codes[at] != 0]
        if not len(at):
            break
        left = rank[order[at]]
        right = rank[np.minimum(order[at] + reach, n)]
        wide = int(n + 1).bit_length()
        by = _order((left.astype(U64) << U64(wide)) | (right + 1).astype(U64), 2 * wide)
        order[at] = order[at][by]
        left, right = left[by], right[by]
        new[at[1:]] |= (left[1:] == left[:-1]) & (right[1:] != right[:-1])
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        reach *= 2
    return order


def search(codes: np.ndarray, order: np.ndarray, query: np.ndarray, deepest: int, suffixes: np.ndarray):
    """For each of the ``suffixes`` of ``query``: the interval at every depth, narrowed by binary search.  Yields (depth, suffixes, lo, hi) of those that reach it."""
    alive = suffixes
    lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), len(order), np.int64)
    padded = np.append(codes, np.zeros(deepest + 1, codes.dtype))
    ended = np.append(query, np.zeros(deepest + 1, query.dtype))

    def bound(lo, hi, want, depth, right):
        a, b = lo.copy(), hi.copy()
        for _ in range(int(len(order)).bit_length() + 1):
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) >> 1
            got = padded[order[np.minimum(mid, len(order) - 1)] + depth]
            up = open_ & ((got <= want) if right else (got < want))
            b = np.where(open_ & ~up, mid, b)
            a = np.where(up, mid + 1, a)
        return a

    for depth in range(deepest):
        want = ended[alive + depth]
        go = want != 0
        alive, lo, hi, want = alive[go], lo[go], hi[go], want[go]
        if not len(alive):
            return
        low = bound(lo, hi, want, depth, False)
        high = bound(low, hi, want, depth, True)
        go = high > low
        alive, lo, hi = alive[go], low[go], high[go]
        if not len(alive):
            return
        yield depth + 1, alive, lo, hi


def word_codes(buf: np.ndarray, offs: np.ndarray):
    """Hash codes of the words with a 0 after each text, the word count of each text."""
    low = LOWER[buf]
    starts, ends = spans(ALNUM[low], offs)
    h = SpanHash(low)(starts, ends) | U64(1)
    word_offs = np.searchsorted(starts, offs)
    counts = np.diff(word_offs)
    codes = np.zeros(len(h) + len(counts), U64)
    text = np.repeat(np.arange(len(counts)), counts)
    codes[np.arange(len(h)) + text] = h
    return codes, counts


class Benchmark:
    """The words of the items of a block, concatenated, where each item lies, and the window hashes by their number of words."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        buf, offs = flat(pa.array(texts, pa.large_string()))
        self.codes, self.counts = word_codes(buf, offs)
        self.ids = np.array(ids, dtype=object)
        self.begins = np.cumsum(self.counts + 1) - (self.counts + 1)
        self.item = np.repeat(np.arange(len(self.counts)), self.counts + 1)
        self.deepest = int(self.counts.max(initial=0))
        # the depth that makes a hit: the window, or the whole of a shorter item from its first word
        place = np.arange(len(self.codes)) - self.begins[self.item]
        left = self.counts[self.item] - place
        self.need = np.where((self.counts[self.item] >= window) & (left >= window), window, np.where((place == 0) & (left > 0) & (left < window), left, -1))
        self.starts, self.keys = {}, {}
        for n in np.unique(self.need[self.need > 0]).tolist():
            at = np.flatnonzero(self.need == n)
            h = window_hashes(self.codes, n)[at]
            by = np.argsort(h, kind="stable")
            self.starts[n], self.keys[n] = at[by], h[by]


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` codes from each place on (what reaches past the end counts as zeros)."""
    power, inverse = _powers(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(codes) * power[: len(codes)], dtype=U64)])
    end = np.minimum(np.arange(len(codes)) + n, len(codes))
    return mix((sums[end] - sums[:-1]) * inverse[: len(codes)])


def _candidates(codes: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the benchmark whose window stands in the shard, and the places where some window stands."""
    suffixes, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, keys in bench.keys.items():
        h = window_hashes(codes, n)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == h)
        if len(hit):
            places.append(hit)
            found = np.unique(h[hit])
            at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
            suffixes.append(bench.starts[n][found[at] == keys])
    return np.unique(np.concatenate(suffixes)), np.concatenate(places)


def _match(buf, offs, blocks, window):
    """What every text of a chunk shares with the benchmark: counts, hit counts, item rows, longest match and its place."""
    all_codes, counts = word_codes(buf, offs)
    n = len(counts)
    all_begins = np.cumsum(counts + 1) - (counts + 1)
    all_doc = np.repeat(np.arange(n), counts + 1)
    n_hit, items = np.zeros(n, np.int64), [[] for _ in range(n)]
    longest, best_item, item_word, doc_word = np.zeros(n, np.int64), np.full(n, None, object), np.zeros(n, np.int64), np.zeros(n, np.int64)
    hits = np.zeros(len(all_codes) + 1, np.int64)
    for load in blocks:
        bench = load()
        suffixes, places = _candidates(all_codes, bench)
        if not len(suffixes):
            continue
        held = np.zeros(n, bool)
        held[all_doc[places]] = True
        own = np.flatnonzero(held[all_doc])  # places of the texts that hold a window
        codes, doc = all_codes[own], all_doc[own]
        order = suffix_array(codes, bench.deepest)
        found = []

        def settle(suffix, at, depth):
            """The places match this suffix for ``depth`` words and no further."""
            at = own[at]
            at = at[depth > longest[all_doc[at]]]
            if len(at):
                d, first = np.unique(all_doc[at], return_index=True)
                i = bench.item[suffix]
                longest[d], best_item[d], item_word[d], doc_word[d] = depth, bench.ids[i], suffix - bench.begins[i], at[first] - all_begins[d]

        before = (np.zeros(0, np.int64),) * 3
        last = 0
        for depth, suffix, lo, hi in search(codes, order, bench.codes, bench.deepest, suffixes):
            hit = bench.need[suffix] == depth
            for s, a, b in zip(suffix[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                at = order[a:b]
                hits[own[at]] += 1
                hits[own[at] + depth] -= 1
                found.append(np.stack([doc[at], np.full(b - a, bench.item[s])], 1))
                if depth < window:
                    settle(s, at, depth)
            if depth > window and len(before[0]):
                at = np.searchsorted(suffix, before[0])
                gone = (at == len(suffix)) | (suffix[np.minimum(at, len(suffix) - 1)] != before[0])
                for s, a, b, x, y in zip(*(v.tolist() for v in before), np.where(gone, before[2], lo[np.minimum(at, len(lo) - 1)]).tolist(), np.where(gone, before[2], hi[np.minimum(at, len(hi) - 1)]).tolist()):
                    if a < x:
                        settle(s, order[a:x], depth - 1)
                    if y < b:
                        settle(s, order[y:b], depth - 1)
            if depth >= window:
                before = (suffix, lo, hi)
                last = depth
        for s, a, b in zip(*(v.tolist() for v in before)):
            settle(s, order[a:b], last)
        if found:
            for d, i in np.unique(np.concatenate(found), axis=0).tolist():
                items[d].append(bench.ids[i])
    inside = (np.cumsum(hits[:-1]) > 0).astype(np.int64)
    n_hit = np.add.reduceat(inside, all_begins) if n else n_hit
    return counts.astype(np.int64), n_hit, items, longest, best_item, item_word, doc_word


def _rows(batch, buf, offs, blocks, window):
    counts, n_hit, items, longest, item_id, item_word, doc_word = _match(buf, offs, blocks, window)
    none = longest == 0
    return {
        "doc_id": batch.column("doc_id"), "n_words": pa.array(counts), "n_hit": pa.array(n_hit), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "longest": pa.array(longest),
        "item_id": pa.array(item_id, pa.string()), "item_word": pa.array(item_word, mask=none), "doc_word": pa.array(doc_word, mask=none),
    }


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> list:
    """Broadcast blocks of the items, each with at most so many bytes of text (or one item)."""
    sc, out, ids, texts, size = benchmark.sparkSession.sparkContext, [], [], [], 0
    for i, text in benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).toLocalIterator():
        if ids and size + len(text) > block_bytes:
            out.append(sc.broadcast(Benchmark(ids, texts, window)))
            ids, texts, size = [], [], 0
        ids.append(i if i is not None else "")
        texts.append(text)
        size += len(text.encode())
    out.append(sc.broadcast(Benchmark(ids, texts, window)))
    return out


def _loaders(held):
    def setup():
        if len(held) == 1:
            one = held[0].value
            return [lambda: one]

        def load(b):
            value = b.value
            b.__dict__.pop("_value", None)  # the worker keeps one block at a time
            return value

        return [lambda b=b: load(b) for b in held]

    return setup


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, hit words, the items found, and the longest verbatim match with its place in item and document."""
    held = blocks_of(benchmark, block_bytes, window)
    return map_chunks(docs.select("doc_id", "text"), lambda batch, buf, offs, own: _rows(batch, buf, offs, own, window), MATCHES, setup=_loaders(held))


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most: int = CHUNK_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with all their columns, in one pass without a shuffle; a task works on ``most`` bytes of text at once."""
    held = blocks_of(benchmark, block_bytes, window)

    def keep(batch, buf, offs, own):
        counts, n_hit, *_ = _match(buf, offs, own, window)
        return batch.filter(pa.array(~contaminated(n_hit, counts)))

    return map_chunks(docs, keep, docs.schema, setup=_loaders(held), most=most)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "longest", "item_id", "item_word", "doc_word",
    )
