"""Language identification by word-first back-off.

A known word adds its log frequency in each language.  An unseen word falls back to its character n-grams, from the
longest order downwards: the first order at which any of its n-grams is known scores it by their mean log frequency.

Spark counts words and n-grams over all training texts; a task adds up what it sees before it sends anything.  The model
keeps them all.  It is broadcast in blocks by hash of about ``block`` values (keys by languages); where a sort has several, a
task takes more text at once and reads the blocks one after another.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the language that sorts first;
rows with a null ``lang`` aren't learned from; rows with a null ``doc_id`` are held out; without any training text all
predictions are ``und``; repeated rows count as often as they occur; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import CHUNK_BYTES, U64, Scratch, SpanHash, chunks, distinct, flat, give_back, lean, mix, spans, table

ORDER = 4
BLOCK = 2_000_000  # values (keys by languages) of a broadcast block
HOLD = 6 << 20  # bytes of text that are looked up at once where there are several blocks
ALPHA = 0.5
FLUSH = 1_500_000
#: ASCII letters and all that lies beyond ASCII may be part of a word.
WORD = table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_SIZES = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.int64)


def _lower(column) -> tuple[np.ndarray, np.ndarray]:
    return flat(pc.utf8_lower(column))


def _codepoints(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The characters of each word between two marks: (characters, word of each)."""
    size = ends - starts
    word = np.repeat(np.arange(len(size)), size)
    raw = np.append(buf[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())], np.zeros(3, np.uint8)).astype(np.uint32)
    n = _SIZES[raw[:-3]]
    at = np.flatnonzero(n)
    n, a, b, c, d = n[at], raw[at], raw[at + 1] & 63, raw[at + 2] & 63, raw[at + 3] & 63
    cp = np.where(n == 1, a, np.where(n == 2, (a & 31) << 6 | b, np.where(n == 3, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d)))
    word = word[at]
    count = np.bincount(word, minlength=len(size)) + 2
    edges = np.cumsum(count) - count
    out = np.ones(int(count.sum()), np.uint32)
    out[np.arange(len(cp)) + 2 * word + 1] = cp
    return out, np.repeat(np.arange(len(size)), count), edges


def _grams(chars: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word (marks included) and the words they come from."""
    if len(chars) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = mix(chars.astype(U64) + U64(n * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * U64(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i])
    ok = word[: len(out)] == word[n - 1 :]
    if n == 1:
        ok &= chars != 1
    return out[ok], word[: len(out)][ok]


class _Counts:
    """Adds up counts of (sort, key, language) and gives them out when they grow large."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, sort, key, lang, n):
        self.parts.append((np.full(len(key), sort, np.int8), key, lang, n))
        self.size += len(key)

    def total(self):
        sort, key, lang, n = (np.concatenate(x) for x in zip(*self.parts))
        first, cls, _ = distinct(mix(key ^ mix(lang.astype(U64) * U64(64) + sort.astype(U64))))
        self.parts = [(sort[first], key[first], lang[first], np.bincount(cls, n, len(first)).astype(np.int64))]
        self.size = len(first)
        return self.parts[0]


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``sort`` (0: word, else the order of the n-gram), ``key``, ``lang`` and how often they occur."""

    def run(batches):
        names, index, held, grown = [], {}, _Counts(), 0

        def out():
            sort, key, lang, n = held.total()
            return pa.RecordBatch.from_pydict({"sort": pa.array(sort.astype(np.int32)), "key": pa.array(key.astype(np.int64)), "lang": pa.array(np.array(names, object)[lang], pa.string()), "n": pa.array(n)})

        for batch in batches:
            for part, _, _ in chunks(batch, "text"):
                buf, offs = _lower(part.column("text"))
                langs = part.column("lang").to_pylist()
                for x in langs:
                    if x not in index:
                        index[x] = len(names)
                        names.append(x)
                code = np.array([index[x] for x in langs])
                starts, ends = spans(WORD[buf], offs)
                if not len(starts):
                    continue
                doc = np.searchsorted(offs, starts, "right") - 1
                lang, h = code[doc], SpanHash(buf)(starts, ends)
                first, _, n = distinct(mix(h ^ mix(lang.astype(U64))))
                lang = lang[first]
                held.add(0, h[first], lang, n)
                chars, word, _ = _codepoints(buf, starts[first], ends[first])
                for k in range(1, order + 1):
                    g, of = _grams(chars, word, k)
                    one, cls, _ = distinct(mix(g ^ mix(lang[of].astype(U64))))
                    held.add(k, g[one], lang[of[one]], np.bincount(cls, n[of], len(one)).astype(np.int64))
                if held.size > FLUSH:
                    held.total()
                    if held.size > FLUSH // 2:
                        yield out()
                        held = _Counts()
        if held.parts:
            yield out()

    part = docs.select("text", "lang").mapInArrow(lean(run), "sort int, key long, lang string, n long")
    return part.groupBy("sort", "key", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Blocks of sorted keys of words and n-grams with a row of log frequencies for each: for each sort a list of broadcasts."""

    def __init__(self, names, blocks, order=ORDER):
        self.names, self.blocks, self.order = names, blocks, order

    def words(self, buf, starts, ends) -> np.ndarray:
        """Each word's scores in all languages."""
        out = np.zeros((len(starts), len(self.names)), np.float32)
        found, logs = self._look(0, SpanHash(buf)(starts, ends))
        out[found] = logs[found]
        left = np.flatnonzero(~found)
        for k in range(self.order, 0, -1):
            if not len(left):
                break
            chars, word, _ = _codepoints(buf, starts[left], ends[left])
            g, of = _grams(chars, word, k)
            found, logs = self._look(k, g)
            of, logs = of[found], logs[found]
            known = np.bincount(of, minlength=len(left))
            for j in range(len(self.names)):
                out[left, j] = np.bincount(of, logs[:, j], len(left)) / np.maximum(known, 1)
            left = left[known == 0]
        return out

    def _look(self, sort, h):
        """Which keys are known, and each one's row."""
        found, out = np.zeros(len(h), bool), np.zeros((len(h), len(self.names)), np.float32)
        for block in self.blocks[sort]:
            # a block of many isn't kept: the next one takes its place
            keys, logs = block.value if len(self.blocks[sort]) == 1 else block.load_from_path(block._path)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1) if len(keys) else np.zeros(len(h), np.int64)
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            out[hit] = logs[at[hit]]
            found |= hit
        return found, out


def fit(docs: DataFrame, order: int = ORDER, block: int = BLOCK, alpha: float = ALPHA) -> Model:
    """A model of ``docs(text, lang)``; rows with a null language are left out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "langid")
    kept = scratch.keep(counts(docs.filter("lang IS NOT NULL AND text IS NOT NULL"), order), "counts")
    sums = kept.groupBy("sort", "lang").agg(F.sum("n").alias("n")).collect()  # a row for each sort and language
    n_keys = {x["sort"]: x["n"] for x in kept.groupBy("sort", "key").agg(F.lit(1)).groupBy("sort").agg(F.count("*").alias("n")).collect()}
    names = sorted({x["lang"] for x in sums})
    total = np.zeros((order + 1, len(names)))
    for x in sums:
        total[x["sort"], names.index(x["lang"])] = x["n"]
    parts = {s: max(1, -(-n_keys.get(s, 0) * len(names) // block)) for s in range(order + 1)}
    if max(parts.values()) > 1:
        n = F.element_at(F.array(*(F.lit(parts[s]) for s in range(order + 1))), F.col("sort") + 1)
        kept = scratch.keep(kept.withColumn("block", F.pmod(F.xxhash64("key"), n)).repartitionByRange("sort", "block").sortWithinPartitions("sort", "block"), "model")
    blocks = []
    for s in range(order + 1):
        blocks.append([])
        for i in range(parts[s]):
            rows = kept.filter(F.col("sort") == s)
            rows = (rows.filter(F.col("block") == i) if "block" in kept.columns else rows).select("key", "lang", "n").toArrow()
            keys, at = np.unique(rows.column("key").to_numpy().astype(U64), return_inverse=True)
            n = np.zeros((len(keys), len(names)))
            n[at, pc.index_in(rows.column("lang"), pa.array(names, pa.string())).to_numpy()] = rows.column("n").to_numpy()
            logs = np.log((n + alpha) / (total[s] + alpha * max(n_keys.get(s, 0), 1))).astype(np.float32)
            blocks[s].append(spark.sparkContext.broadcast((keys, logs)))
            del rows, keys, at, n, logs
            give_back()
    scratch.drop("counts")
    scratch.drop("model")
    return Model(names, blocks, order)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` columns ``doc_id`` with ``lang_pred`` and ``score`` from the whole text alone."""
    most = CHUNK_BYTES if all(len(x) == 1 for x in model.blocks) else HOLD

    def run(batches):
        for batch in batches:
            for part, _, _ in chunks(batch, "text", most):
                yield _predict(part, model)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def _predict(part, model):
    buf, offs = _lower(part.column("text"))
    starts, ends = spans(WORD[buf], offs)
    word_offs = np.searchsorted(starts, offs)
    n, names = len(offs) - 1, model.names
    pred, score = np.full(n, "und", object), np.zeros(n)
    letters = pc.match_substring_regex(part.column("text"), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    if names and len(starts):
        first, cls, _ = distinct(SpanHash(buf)(starts, ends))
        each = model.words(buf, starts[first], ends[first]).astype(np.float64)
        total = np.zeros((n, len(names)))
        for j in range(len(names)):
            sums = np.concatenate([[0.0], np.cumsum(each[cls, j])])
            total[:, j] = sums[word_offs[1:]] - sums[word_offs[:-1]]
        total = np.round(total, 6)
        best = total.argmax(1)
        # long texts count as 30 words at most, so that the score stays telling
        scale = np.minimum(1, 30 / np.maximum(np.diff(word_offs), 1))
        shifted = np.exp((total - total.max(1, keepdims=True)) * scale[:, None])
        ok = letters & (np.diff(word_offs) > 0)
        pred[ok] = np.array(names, object)[best[ok]]
        score[ok] = (1 / shifted.sum(1))[ok]
    return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.round(score, 6))})
