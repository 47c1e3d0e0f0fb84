"""Quality rules: repetition and length rules, then bands of character n-gram perplexity for each language.

The model is an interpolated modified Kneser-Ney model of the byte n-grams (``order``) of whole texts, from START to END and
across words, one for each value of ``lang``.  Spark counts every byte of every text; each task sends the counts of its
distinct n-grams.  Discounts and probabilities come from all counts by joins; no n-gram is left out.  As the texts that are
scored are those that were counted, every n-gram is known and no back-off is needed.  The log probabilities are broadcast
in blocks of about ``block`` n-grams by hash; a task holds some text and reads the blocks one after another.

A document is rejected where its mean log perplexity lies more than ``width`` robust standard deviations (from the
quartiles of all scored documents of its language, read off an exact histogram) off the median.

Defined cases: a null or blank text has no words and no perplexity and fails the base rules; a null ``lang`` is a
language of its own; bytes 0 to 2 count as byte 3; repeated rows and equal texts are counted and judged as often as they occur; an empty table gives
an empty result; extra columns are ignored by ``quality_rules`` and kept by ``keep_quality``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import (
    LOWER, NON_SPACE, U64, Scratch, SpanHash, chunks, distinct, give_back, lean, mix, per_doc, small, small_batches, spans, table, windows, without_rows,
)

ORDER = 6
BLOCK = 1_000_000  # n-grams of a broadcast block
CHUNK = 1 << 19  # bytes of text that are worked on together
HOLD = 3 << 20  # bytes of text that are scored at once where there are several blocks
FLUSH = 1_500_000
OUT = 1 << 16  # rows of counts that are handed back at once
WIDTH = 3.5
BIN = 0.001
SYMBOLS = table(b"#*$%&|<>")
START, END = 1, 2
METRICS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"


def _langs(column) -> np.ndarray:
    return np.array([x if x is not None else "" for x in column.to_pylist()], dtype=object)


def _salts(batch) -> np.ndarray:
    langs = _langs(batch.column("lang"))
    known = {x: _hash(x) for x in set(langs)}
    return np.array([known[x] for x in langs], U64)


def _grams(buf, offs, order):
    """For each byte of the texts and their END: the packed n-gram that ends there (``order`` bytes, fewer near START); offsets and documents of the places."""
    n = len(offs) - 1
    size = np.diff(offs) + 2
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    at = np.arange(len(doc), dtype=np.int32)
    at -= begin.astype(np.int32)[doc]
    text = np.ones(len(doc), bool)
    text[begin] = text[begin + size - 1] = False
    byte = np.full(len(doc), START, np.uint8)
    byte[begin + size - 1] = END
    byte[text] = np.maximum(LOWER[buf], END + 1)
    packed = byte.astype(U64)
    for back in range(1, order):
        before = byte[:-back].astype(U64)
        before <<= U64(8 * back)
        before[at[back:] < back] = 0
        packed[back:] |= before
    ok = at > 0
    return packed[ok], np.append(begin - np.arange(n), len(doc) - n), doc[ok]


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """How often each n-gram that ends at a byte of a text or its END occurs in each language, over all texts; a task adds up what it sees."""

    bits = U64(8 * order)
    room = 1 << (64 - 8 * order)  # languages whose numbers fit beside an n-gram

    def counted(keys, n=None):
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        return keys[at], np.diff(np.append(at, len(keys))) if n is None else np.add.reduceat(n, at)

    def run(batches):
        held, size, names, index = [], 0, [], {}

        def merge():
            keys, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            by = np.argsort(keys, kind="stable")  # runs that are sorted
            keys, n = keys[by], n[by]
            del by
            held.append(counted(keys, n))
            return len(held[0][0])

        def out():
            langs = pa.array(names, pa.string())
            for a in range(0, len(held[0][0]), OUT):
                keys, n = (x[a : a + OUT] for x in held[0])
                yield pa.RecordBatch.from_pydict({"lang": langs.take(pa.array((keys >> bits).astype(np.int64))), "gram": pa.array((keys & ((U64(1) << bits) - U64(1))).astype(np.int64)), "n": pa.array(n)})
            held.clear()

        for batch in batches:
            for a in range(0, batch.num_rows, room):
                for part, buf, offs in chunks(batch.slice(a, room), "text", CHUNK):
                    langs = _langs(part.column("lang"))
                    if len(set(langs) - set(index)) + len(names) > room:  # begin to number languages anew
                        if held:
                            merge()
                            yield from out()
                        size, names, index = 0, [], {}
                    for x in langs:
                        if x not in index:
                            index[x] = len(names)
                            names.append(x)
                    keys, _, doc = _grams(buf, offs, order)
                    keys |= (np.array([index[x] for x in langs], U64) << bits)[doc]
                    del doc
                    keys.sort()
                    held.append(counted(keys))
                    size += len(held[-1][0])
                    del keys  # merging takes as much again
                    if size > FLUSH:
                        size = merge()
                        if size > FLUSH // 2:
                            yield from out()
                            size = 0
        if held:
            merge()
            yield from out()

    part = docs.select("text", "lang").mapInArrow(lean(run), "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated modified Kneser-Ney in sorted hash arrays: ``keys`` and ``logp``, ``contexts`` and ``logb``."""

    def __init__(self, langs, grams, counts, order=ORDER):
        self.order = order
        names, code = np.unique(np.asarray(langs, dtype=str), return_inverse=True) if len(langs) else (np.zeros(0, str), np.zeros(0, int))
        self.names, self.flat = list(names), 256.0
        keys, logs, ctxs, backs = [], [], [], []
        for k in range(len(names)):
            own = code == k
            a, b, c, d = self._fit(np.asarray(grams)[own].astype(U64), np.asarray(counts)[own].astype(np.int64), k)
            keys, logs, ctxs, backs = keys + a, logs + b, ctxs + c, backs + d
        self.keys, self.logp = self._sorted(keys, logs)
        self.contexts, self.logb = self._sorted(ctxs, backs)

    @staticmethod
    def _sorted(keys, values):
        k = np.concatenate(keys) if keys else np.zeros(0, U64)
        v = np.concatenate(values) if values else np.zeros(0)
        by = np.argsort(k)
        return k[by], v[by].astype(np.float32)

    @staticmethod
    def key(gram, n, lang):
        return mix(mix(gram + U64(0x632BE59BD9B4E019)) ^ (np.asarray(n).astype(U64) << U64(50)) ^ (np.asarray(lang).astype(U64) << U64(54)))

    def _fit(self, grams, counts, lang):
        """Levels from the highest order down; an n-gram that begins with START counts as it occurs, others by their distinct left neighbours."""
        size = np.zeros(len(grams), np.int64)
        for n in range(1, self.order + 1):
            size[(grams >> U64(8 * (n - 1))) & U64(255) != 0] = n
        levels = {}
        g, c = grams[size == self.order], counts[size == self.order]
        for n in range(self.order, 0, -1):
            levels[n] = (g, c)
            if n > 1:
                lower, continued = np.unique(g & ((U64(1) << U64(8 * (n - 1))) - U64(1)), return_counts=True)
                begun = size == n - 1
                both = np.concatenate([lower, grams[begun]])
                g, at = np.unique(both, return_inverse=True)
                c = np.bincount(at, np.concatenate([continued, counts[begun]]), len(g)).astype(np.int64)
        keys, logs, ctxs, backs = [], [], [], []
        below_g, below_p = None, None
        for n in range(1, self.order + 1):
            g, c = levels[n]
            if not len(g):
                continue
            n1, n2, n3, n4 = (max(1, int((c == i).sum())) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            off = np.array([0, *(min(i * 0.95, max(0.05, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])
            cut = off[np.minimum(c, 3)]
            ctx, at = np.unique(g >> U64(8), return_inverse=True)
            total = np.bincount(at, c, len(ctx))
            back = np.bincount(at, cut, len(ctx)) / total
            if n == 1:
                low = np.full(len(g), 1 / self.flat)
            else:
                low = below_p[np.minimum(np.searchsorted(below_g, g & ((U64(1) << U64(8 * (n - 1))) - U64(1))), len(below_g) - 1)]
            p = (c - cut) / total[at] + back[at] * low
            keys.append(self.key(g, n, lang)), logs.append(np.log(p))
            ctxs.append(self.key(ctx, n, lang)), backs.append(np.log(back))
            below_g, below_p = g, p
        return keys, logs, ctxs, backs

    def score(self, grams, have, lang):
        """Log probability of each n-gram's last byte, backing off where the n-gram is unknown."""
        out, open_, n, g = np.zeros(len(grams)), np.arange(len(grams)), have.copy(), grams.copy()
        while len(open_) and len(self.keys):
            k = self.key(g[open_], n[open_], lang[open_])
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            hit = self.keys[at] == k
            out[open_[hit]] += self.logp[at[hit]]
            open_ = open_[~hit]
            k = self.key(g[open_] >> U64(8), n[open_], lang[open_])
            at = np.minimum(np.searchsorted(self.contexts, k), len(self.contexts) - 1)
            hit = self.contexts[at] == k
            out[open_[hit]] += self.logb[at[hit]]
            n[open_] -= 1
            out[open_[n[open_] == 0]] -= np.log(self.flat)
            open_ = open_[n[open_] > 0]
            g[open_] &= (U64(1) << (n[open_].astype(U64) * U64(8))) - U64(1)
        return out


def _hash(lang: str) -> U64:
    from hashlib import blake2b

    return U64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _key(grams: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mix(mix(grams + U64(0x632BE59BD9B4E019)) ^ salt)


def probabilities(counts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """``lang, gram, logp``: the log probability of the last byte of every n-gram of ``counts``, by joins; the same model as ``KneserNey``.

    Levels go from the highest order down, probabilities from the lowest up; discounts come from all counts of a level.
    """
    low = lambda n: (1 << (8 * n)) - 1
    size = F.lit(1)
    for n in range(1, order):
        size = F.when(F.col("gram") > low(n), n + 1).otherwise(size)
    sized = counts.withColumn("size", size)
    levels = {order: sized.filter(F.col("size") == order).select("lang", "gram", F.col("n").alias("c"))}
    for n in range(order - 1, 0, -1):
        both = levels[n + 1].select("lang", F.col("gram").bitwiseAND(F.lit(low(n))).alias("gram"), F.lit(1).cast("long").alias("c")).union(sized.filter(F.col("size") == n).select("lang", "gram", "n"))
        levels[n] = scratch.keep(both.groupBy("lang", "gram").agg(F.sum("c").alias("c")), f"level-{n}")
    below, parts = None, []
    for n in range(1, order + 1):
        seen = levels[n].groupBy("lang").agg(*(F.greatest(F.lit(1), F.sum((F.col("c") == i).cast("long"))).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        off = [F.least(F.lit(i * 0.95), F.greatest(F.lit(0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).alias(f"d{i}") for i in (1, 2, 3)]
        own = levels[n].join(small(scratch.keep(seen.select("lang", *off), f"off-{n}")), "lang")
        own = own.select("lang", "gram", "c", F.shiftright("gram", 8).alias("ctx"), F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("cut"))
        own = own.join(own.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("back")), ["lang", "ctx"])
        if below is None:
            own = own.withColumn("low", F.lit(1 / 256.0))
        else:
            own = own.withColumn("rest", F.col("gram").bitwiseAND(F.lit(low(n - 1)))).join(below.select("lang", F.col("gram").alias("rest"), F.col("p").alias("low")), ["lang", "rest"])
        own = own.select("lang", "gram", ((F.col("c") - F.col("cut") + F.col("back") * F.col("low")) / F.col("total")).alias("p"))
        below = scratch.keep(own, f"p-{n}")
        parts.append(below if n == order else below.filter(F.shiftright("gram", 8 * (n - 1)) == START))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.select("lang", "gram", F.log("p").cast("float").alias("logp"))


def fit(docs: DataFrame, order: int = ORDER, block: int = BLOCK, scratch: Scratch | None = None) -> list:
    """Broadcast blocks of the model of all texts: sorted keys and log probabilities, about ``block`` n-grams each, none left out."""
    if order > 7:
        raise ValueError("an n-gram has 7 bytes at most")
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    counts = scratch.keep(gram_counts(docs, order), "counts")
    n = max(1, -(-counts.count() // block))
    found = probabilities(counts, order, scratch)
    if n > 1:
        found = found.withColumn("block", F.expr(f"pmod(xxhash64(lang, gram), {n})")).repartitionByRange("block").sortWithinPartitions("block")
        found = scratch.keep(found, "model")
    out = []
    for i in range(n):
        rows = (found.filter(F.col("block") == i) if n > 1 else found).select("lang", "gram", "logp").toArrow()
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        langs = langs.combine_chunks() if hasattr(langs, "combine_chunks") else langs
        salt = np.array([_hash(x) for x in langs.dictionary.to_pylist()], U64)
        keys = _key(rows.column("gram").to_numpy().astype(U64), salt[langs.indices.to_numpy()] if len(salt) else np.zeros(0, U64))
        by = np.argsort(keys)
        out.append(docs.sparkSession.sparkContext.broadcast((keys[by], rows.column("logp").to_numpy()[by])))
        del rows, langs, salt, keys, by
        give_back()
    for name in ("counts", "model", *(f"{k}-{i}" for k in ("level", "off", "p") for i in range(1, order + 1))):
        scratch.drop(name)
    return out


def _measure(batch, buf, offs):
    """The base measures of a chunk and what its perplexities need: (columns, keys of distinct n-grams, their classes, offsets, valid)."""
    starts, ends = spans(NON_SPACE[buf], offs)
    word_offs = np.searchsorted(starts, offs)
    docs = np.repeat(np.arange(len(offs) - 1), np.diff(word_offs))
    hashes = SpanHash(buf)
    inside = np.zeros(len(buf), bool)
    letters = ((buf & 0xC0) != 0x80) & NON_SPACE[buf]
    # lines that hold a word and equal an earlier one
    breaks = np.flatnonzero(buf == 10)
    bounds = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    line_doc = np.searchsorted(offs, bounds, "right") - 1
    line_ends = np.sort(np.concatenate([breaks, offs[1:]]))  # the k-th line starts and ends at the k-th of each
    ok = np.searchsorted(starts, line_ends) > np.searchsorted(starts, bounds)
    bounds, line_ends, line_doc = bounds[ok], line_ends[ok], line_doc[ok]
    n = len(offs) - 1
    key = mix(hashes(bounds, line_ends) + line_doc.astype(U64) * U64(0xD1B54A32D192ED03))
    first, _, _ = distinct(key)
    dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[first], minlength=n)
    # words in windows of three that the text holds twice
    triples = windows(hashes(starts, ends), 3)
    own = docs[: len(triples)]
    whole = own == docs[2:] if len(triples) else np.zeros(0, bool)
    where = np.flatnonzero(whole)
    key = mix(triples[where] + own[where].astype(U64) * U64(0xD1B54A32D192ED03))
    _, cls, sizes = distinct(key)
    twice = where[sizes[cls] > 1] if len(where) else where
    inside = np.zeros(len(starts) + 2, bool)
    for i in range(3):
        inside[twice + i] = True
    out = {
        "doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "n_words": pa.array(np.diff(word_offs)), "word_chars": pa.array(per_doc(letters, offs)),
        "n_symbols": pa.array(per_doc(SYMBOLS[buf], offs)), "n_dup_lines": pa.array(dup_lines.astype(np.int64)), "n_repeat_words": pa.array(per_doc(inside[: len(starts)], word_offs)),
    }
    return out, np.diff(word_offs) > 0


def _perplexity(at: np.ndarray, logp: np.ndarray, cls: np.ndarray, valid: np.ndarray) -> pa.Array:
    sums = np.concatenate([[0.0], np.cumsum(logp[cls], dtype=np.float64)])
    ppl = -(sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
    return pa.array(np.round(ppl, 4), mask=~valid)


def measure(docs: DataFrame, model: list, order: int = ORDER, hold: int = HOLD) -> DataFrame:
    """Base measures and the mean log perplexity of every document of the texts that the model was counted over."""

    def load(block):  # a block of many isn't kept: the next one takes its place
        return block.value if len(model) == 1 else block.load_from_path(block._path)

    def score(held):
        for block in model:
            keys = logs = None  # before the next block comes in
            keys, logs = load(block)
            for _, own, logp, *_ in held:
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    hit = keys[at] == own
                    logp[hit] = logs[at[hit]]
        for out, _, logp, cls, at, valid in held:
            yield pa.RecordBatch.from_pydict(out | {"log_ppl": _perplexity(at, logp, cls, valid)})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part, buf, offs in chunks(batch, "text", CHUNK):
                out, valid = _measure(part, buf, offs)
                grams, at, doc = _grams(buf, offs, order)
                keys = _key(grams, _salts(part)[doc])
                del grams, doc
                first, cls, _ = distinct(keys)
                held.append((out, keys[first], np.full(len(first), -np.log(256), np.float32), cls.astype(np.int32), at, valid))
                del keys, first, cls
                size += len(buf)
                if len(model) == 1 or size > hold:
                    yield from score(held)
                    held, size = [], 0
        if held:
            yield from score(held)

    return docs.select("doc_id", "text", "lang").mapInArrow(lean(run), METRICS)


def bands(metrics: DataFrame, width: float = WIDTH) -> DataFrame:
    """Lower and upper log perplexity of each language, from the quartiles of an exact histogram."""
    bins = metrics.filter(F.col("log_ppl").isNotNull()).groupBy("lang", F.floor(F.col("log_ppl") / BIN).alias("bin")).count()
    w = Window.partitionBy("lang")
    cum = bins.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) + 0.5) * BIN
    q = cum.groupBy("lang").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    spread = F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(BIN)) * width
    return q.select("lang", (F.col("q2") - spread).alias("low"), (F.col("q2") + spread).alias("high"))


def quality_rules(docs: DataFrame, width: float = WIDTH, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """One row per document: its measures, ``log_ppl`` with its language's band, ``base_failed`` and ``kept``."""
    scratch = Scratch(docs.sparkSession, "quality")
    with small_batches(docs.sparkSession):
        model = fit(docs, order, block, scratch)
        metrics = scratch.keep(measure(docs, model, order), "metrics")
    for x in model:
        x.destroy()
    return _judged(metrics, small(scratch.keep(bands(metrics, width), "bands")))


def _judged(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    edges = edges.withColumnRenamed("lang", "band_lang")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return (
        metrics.join(edges, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
        .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)
    )


def keep_quality(docs: DataFrame, **settings) -> DataFrame:
    """The documents that pass, with all their columns.  Rows are judged one by one, also where they share a ``doc_id`` or have none."""
    return without_rows(docs, lambda rows: quality_rules(rows, **settings).filter("NOT kept").select("doc_id"), Scratch(docs.sparkSession, "quality"))
