"""The pipeline's stages and the registered queries against plain Python and SQL on small tables."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalframe.llm import kernels, langid, pieces, quality, queries
from tests.llm.test_vectors import ROWS
from tests.llm.test_vectors import SCHEMA as VECTOR_COLUMNS
from tests.llm.test_llm import LOWER, brute_windows, rows, shingles, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id string, spans string, _rejected int, Text2 string"


def table():
    rng = random.Random(11)
    out = [(r[0], r[1], r[2]) for r in rows() if r[0] is not None]
    base = words(rng, 260)
    for i in range(200, 230):
        w = base.split(" ")
        for k in range(i % 3):
            w[rng.randrange(len(w))] = f"new{i}x{k}"
        out.append((i, " ".join(w) if i < 206 else words(rng, rng.randint(60, 200), "fr" if i % 2 else "en"), "fr" if i % 2 and i >= 206 else "en"))
    bench = [(1, words(rng, 40)), (2, " ".join(base.split(" ")[100:160])), (3, None), (4, "!?"), (5, "Short item of five")]
    out += [(300, words(rng, 80) + " " + bench[0][1] + " " + words(rng, 60), "en"), (301, words(rng, 90) + " mail me at a.b@example.org or +49 (30) 1234567, card 4111 1111 1111 1111 now " + words(rng, 20), "en")]
    out += [(302, words(rng, 70) + ' token = "0123456789abcdef0123456789abcdef" ' + words(rng, 30), "en"), (303, words(rng, 5000), "en")]
    pages = [(1, "http://a/x", "y" * 200), (2, None, "y" * 200), (3, "u", None), (4, "u v", "short"), (5, "u", "short"), (6, "q", "é" * 40_000), (7, "q", "é" * 40_000), (8, "q", "")]
    return [(a, b, c, "s", len(b or ""), "extra", "x", 7, "t") for a, b, c in out], bench, pages


DOCS, BENCH, PAGES = table()


@pytest.fixture(autouse=True)
def settings(spark):
    """Stages leave small batches set in the session; other tests start from Spark's own."""
    yield
    for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        spark.conf.unset(k)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name, data, schema in (("documents", DOCS, COLUMNS), ("benchmark", BENCH, "item_id long, text string"), ("pages", PAGES, "page_id long, url string, html string"), ("embeddings", [r for r in ROWS if r[0] not in (2005, 2006)], VECTOR_COLUMNS)):
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", COLUMNS), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string"), ("embeddings", VECTOR_COLUMNS)):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_of_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def lower_words(text):
    """Words as the language model takes them: ASCII letters and all beyond ASCII."""
    return re.findall(r"[A-Za-z\x80-\U0010ffff]+", (text or "").lower())


def test_op1_learns_from_other_documents_only(spark, sf_dir):
    """Hold-out rule, predictions and scores in plain Python."""
    held = {d[0]: crc32(str(d[0]).encode()) % 5 == 0 for d in DOCS}
    counts = defaultdict(Counter)  # (sort, language) -> counts
    for i, text, lang, *_ in DOCS:
        if not held[i] and lang is not None and text is not None:
            for w in lower_words(text):
                counts[0, lang][w] += 1
                marked = "\1" + w + "\1"
                for n in range(1, langid.ORDER + 1):
                    for k in range(len(marked) - n + 1):
                        if marked[k : k + n] != "\1":
                            counts[n, lang][marked[k : k + n]] += 1
    names = sorted({lang for _, lang in counts})
    keys = {n: set().union(*(counts[n, lang] for lang in names)) for n in range(langid.ORDER + 1)}
    total = {k: sum(c.values()) for k, c in counts.items()}
    log = lambda n, g, lang: math.log((counts[n, lang][g] + langid.ALPHA) / (total.get((n, lang), 0) + langid.ALPHA * max(len(keys[n]), 1)))

    def score(w):
        if w in keys[0]:
            return [log(0, w, lang) for lang in names]
        marked = "\1" + w + "\1"
        for n in range(langid.ORDER, 0, -1):
            g = [x for x in (marked[k : k + n] for k in range(len(marked) - n + 1)) if x != "\1" and x in keys[n]]
            if g:
                return [sum(log(n, x, lang) for x in g) / len(g) for lang in names]
        return [0.0] * len(names)

    for r in queries.op1_language_id(spark, sf_dir).collect():
        text = next(d[1] for d in DOCS if d[0] == r["doc_id"])
        assert r["held_out"] == held[r["doc_id"]]
        w = lower_words(text)
        if not w or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums = [sum(v) for v in zip(*(score(x) for x in w))]
        scale = min(1, 30 / len(w))
        best = max(sums)
        if sorted(sums)[-1] - sorted(sums)[-2] > 1e-3:
            assert r["lang_pred"] == names[sums.index(best)], r
        assert r["score"] == pytest.approx(1 / sum(math.exp((v - best) * scale) for v in sums), abs=2e-3)


def plain_perplexity(docs, order=quality.ORDER):
    """Mean log perplexity of every text by an interpolated modified Kneser-Ney model of bytes, in plain Python."""
    strings = {}
    for k, (_, text, lang, *_) in enumerate(docs):
        raw = bytes(max(3, b + 32 if 65 <= b <= 90 else b) for b in (text or "").encode())
        strings[k] = (lang, b"\1" + raw + b"\2")
    out = {}
    for lang in {v[0] for v in strings.values()}:
        seen = Counter()
        for own, s in strings.values():
            if own == lang:
                for i in range(1, len(s)):
                    seen[s[max(0, i - order + 1) : i + 1]] += 1
        levels = {order: Counter({g: c for g, c in seen.items() if len(g) == order})}
        for n in range(order - 1, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])
            levels[n].update({g: c for g, c in seen.items() if len(g) == n})
        below = {}
        for n in range(1, order + 1):
            n1, n2, n3, n4 = (max(1, sum(c == i for c in levels[n].values())) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            off = [0, *(min(i * 0.95, max(0.05, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
            total, back = Counter(), Counter()
            for g, c in levels[n].items():
                total[g[:-1]] += c
                back[g[:-1]] += off[min(c, 3)]
            now = {}
            for g, c in levels[n].items():
                now[g] = (c - off[min(c, 3)] + back[g[:-1]] * (below[g[1:]] if n > 1 else 1 / 256)) / total[g[:-1]]
            below = now
            out.update({(lang, g): p for g, p in now.items() if n == order or g[:1] == b"\1"})
    return [-sum(math.log(out[lang, s[max(0, i - order + 1) : i + 1]]) for i in range(1, len(s))) / (len(s) - 1) for lang, s in strings.values()]


def test_op7_verdicts_against_plain_python(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op7_quality_rules(spark, sf_dir).collect() if r["doc_id"] != 48}
    ppl = plain_perplexity(DOCS)
    edges = {}
    for lang in {d[2] for d in DOCS}:
        bins = sorted(math.floor(round(p, 4) / quality.BIN) for d, p in zip(DOCS, ppl) if d[2] == lang and (d[1] or "").split())
        if bins:
            at = lambda q, bins=bins: (bins[math.ceil(q * len(bins)) - 1] + 0.5) * quality.BIN
            wide = max((at(0.75) - at(0.25)) / 1.349, quality.BIN) * quality.WIDTH
            edges[lang] = (at(0.5) - wide, at(0.5) + wide)
    kept = 0
    for d, p in zip(DOCS, ppl):
        if d[0] == 48:
            continue
        r = got[d[0]]
        if not (d[1] or "").split():
            assert r["log_ppl"] is None and not r["kept"]
            continue
        assert r["log_ppl"] == pytest.approx(p, abs=2e-4)
        low, high = edges[d[2]]
        if min(abs(p - low), abs(p - high)) > 0.003:
            assert r["kept"] == (not r["base_failed"] and low <= p <= high), (r, low, high)
        kept += r["kept"]
    assert kept > 10


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "sentencepiece"]


def test_quality_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdict = defaultdict(lambda: True)
    for r in quality.quality_rules(docs).collect():
        verdict[r["doc_id"]] &= r["kept"]
    out = stage("quality")(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(d[0] for d in DOCS if verdict[d[0]])


def test_near_dedup_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = [shingles(d[1]) for d in DOCS]
    root = list(range(len(DOCS)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(DOCS)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(DOCS):
        least[find(i)] = min(least.get(find(i), d[0]), d[0])
    want = {d[0] for i, d in enumerate(DOCS) if not sets[i] or least[find(i)] == d[0]}
    out = stage("near_dedup")(spark, docs, sf_dir)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want
    assert 200 in want and not {201, 203} & want


def awkward_ids(spark, path):
    """The documents with many null and shared ids, and columns that are named like row numbers."""
    ids = [None if k % 5 == 0 else 42 if k % 7 == 0 else d[0] for k, d in enumerate(DOCS)]
    own = [(i, *d[1:5], k, "y", "z") for k, (i, d) in enumerate(zip(ids, DOCS))]
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, _row long, _FILE string, _index string").coalesce(2).write.parquet(path)
    return own, spark.read.parquet(path)


def test_near_dedup_stage_judges_rows(spark, tmp_path):
    own, docs = awkward_ids(spark, f"{tmp_path}/documents.parquet")
    sets = [shingles(d[1]) for d in own]
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    parts = defaultdict(list)
    for i in range(len(own)):
        parts[find(i)].append(own[i])
    out = [tuple(r) for r in stage("near_dedup")(spark, docs, str(tmp_path)).collect()]
    left = Counter(r[5] for r in out)
    assert set(out) <= set(own) and max(left.values()) == 1
    for part in parts.values():  # one row of each group, with the smallest id that there is
        kept = [r for r in part if left[r[5]]]
        if shingles(part[0][1]):
            assert len(kept) == 1 and kept[0][0] == min((r[0] for r in part if r[0] is not None), default=None)
        else:
            assert kept == part
    assert sum(r[0] is None for r in out) > 5 and sum(r[0] == 42 for r in out) > 3


def test_one_duplicate_takes_no_other_row_along(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(20)) for k in "ABCDE"}
    rows = [(1, "A"), (None, "A"), (None, "B"), (None, "C"), (5, "D"), (5, "A"), (7, "E")]
    docs = spark.createDataFrame([(i, texts[k]) for i, k in rows], "doc_id long, text string")
    out = stage("near_dedup")(spark, docs, "")
    assert Counter((r["doc_id"], r["text"][0]) for r in out.collect()) == Counter([(1, "A"), (None, "B"), (None, "C"), (5, "D"), (7, "E")])


def test_quality_stage_judges_rows(spark, tmp_path):
    own, docs = awkward_ids(spark, f"{tmp_path}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs.drop("doc_id").withColumnRenamed("_row", "doc_id")).collect()}
    out = stage("quality")(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == Counter(r for r in own if verdict[r[5]])
    assert {r[0] for r in own if verdict[r[5]]} & {r[0] for r in own if not verdict[r[5]]} >= {None, 42}


def test_decontamination_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = stage("decontamination")(spark, docs, sf_dir)
    want = Counter()
    for d in DOCS:
        n, hit, _ = brute_windows(d[1], BENCH)
        want[d[0]] += not (hit > 0 and 20 * hit >= n)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == +want
    assert not want[300] and want[301]


def test_pii_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = stage("pii")(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.count() == len(DOCS)
    text = {r["doc_id"]: r for r in out.filter("doc_id >= 300").collect()}
    assert all(mark in text[301]["text"] for mark in ("<EMAIL>", "<PHONE>", "<CARD>")) and "example.org" not in text[301]["text"] and "4111" not in text[301]["text"]
    assert "<SECRET>" in text[302]["text"] and "0123456789abcdef" not in text[302]["text"] and text[301]["n_chars"] == len(text[301]["text"])
    assert text[300]["text"] == next(d[1] for d in DOCS if d[0] == 300) and text[301]["spans"] == "x"


def test_sentencepiece_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = stage("sentencepiece")(spark, docs, sf_dir)
    assert out.filter("NOT exact").count() == 0
    back = pieces.decode(out.select("doc_id", "ids"), pieces.Pieces.load())
    assert Counter((r["doc_id"], r["decoded"] or "") for r in back.collect()) == Counter((d[0], d[1] or "") for d in DOCS)


def test_whole_pipeline(spark, sf_dir, empty_dir):
    """Each stage works on what the one before kept; the result is that of the stages one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf_dir)
    got = corpus_pipeline.run(spark, sf_dir)
    pick = lambda df: Counter((r["doc_id"], r["decoded_sha256"]) for r in df.select("doc_id", "decoded_sha256").collect())
    assert pick(got) == pick(docs) and got.count() > 5
    assert not {i for i, _ in pick(got)} & {0, 1, 300}
    assert pick(got)[301, hashlib.sha256(next(d[1] for d in DOCS if d[0] == 301).encode()).hexdigest()] == 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_repeats_number_rows_alike_in_every_scan(spark, sf_dir):
    from signalframe.llm.kernels import Scratch, with_rows

    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "t")
    got = []
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got.append({r["row"]: (r["doc_id"], r["text"]) for r in with_rows(docs, ["doc_id", "text"], scratch).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1] and len(got[0]) == len(DOCS)
    other = with_rows(docs.groupBy("doc_id").agg(F.max("text").alias("text")), ["doc_id", "text"], scratch)
    assert other.select("row").distinct().count() == other.count()


assert LOWER  # shared with the table of awkward rows


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """The quality stage's tasks hold a few MB of texts, not 64; what was set before is set again."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    largest = lambda batches: (b.select([0]) for b in batches if b.nbytes > 2 * kernels.BATCH_BYTES)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some text "), 1000).alias("text"), F.lit("en").alias("lang"))
    keep = quality.Scratch.keep

    def watched(self, df, name):
        if name in ("counts", "metrics"):
            seen.append(docs.mapInArrow(largest, "doc_id long").count())
        return keep(self, df, name)

    monkeypatch.setattr(quality.Scratch, "keep", watched)
    assert quality.quality_rules(docs).count() == 3000
    assert seen == [0, 0] and docs.mapInArrow(largest, "doc_id long").count() > 0
    assert spark.conf.get(key) == before


class Caught:
    """Takes the place of a table: keeps the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, fn, schema):
        self.fn = fn
        raise StopIteration


def task(make):
    caught = Caught()
    with pytest.raises(StopIteration):
        make(caught)
    return caught.fn


class Block:
    def __init__(self, n, seed):
        self._path, self.arrays = None, (np.sort(np.random.default_rng(seed).integers(0, 1 << 63, n).astype(np.uint64)), np.zeros(n, np.float32))

    def load_from_path(self, path):
        return tuple(x.copy() for x in self.arrays)


@pytest.mark.parametrize("step, most", [("count", 120), ("measure", 120)])
def test_quality_tasks_hold_little(step, most):
    """A task's arrays over 8 MB of text, in MB (before: 244 in counting and 252 in measuring)."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 4000, np.uint8).tobytes().decode().replace("q", " ") for _ in range(2000)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "text": texts[a : a + 500], "lang": ["en", "fr"] * 250}) for a in range(0, 2000, 500)]
    blocks = [Block(quality.BLOCK // 2, i) for i in range(4)]
    fn = task(quality.gram_counts if step == "count" else lambda docs: quality.measure(docs, blocks))
    tracemalloc.start()
    before, n, rows = tracemalloc.get_traced_memory()[0], 0, 0
    for batch in fn(iter(batches)):
        n += sum(batch.column("n").to_pylist()) if step == "count" else batch.num_rows
        rows = max(rows, batch.num_rows)
        del batch
    peak = (tracemalloc.get_traced_memory()[1] - before) / 1e6
    tracemalloc.stop()
    assert n == (2000 * 4001 if step == "count" else 2000)
    assert peak < most and rows <= 1 << 16, (peak, rows)


def test_counts_of_many_languages():
    """More languages than numbers fit beside an n-gram of 7 bytes."""
    rows = [(f"text {i % 7}", f"l{i % 600}") for i in range(2000)]
    batches = [pa.RecordBatch.from_pydict({"text": [r[0] for r in rows[a : a + 700]], "lang": [r[1] for r in rows[a : a + 700]]}) for a in range(0, 2000, 700)]
    want, got = Counter(), Counter()
    for text, lang in rows:
        s = b"\1" + text.encode() + b"\2"
        want.update((lang, int.from_bytes(s[max(0, i - 6) : i + 1], "big")) for i in range(1, len(s)))
    for batch in task(lambda docs: quality.gram_counts(docs, 7))(iter(batches)):
        for lang, gram, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "gram", "n"))):
            got[lang, gram] += n
    assert got == want


def test_stages_leave_small_batches(spark, sf_dir, monkeypatch):
    """A stage's table is planned when it is written, after the stage's function has ended."""
    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    try:
        for _, run in corpus_pipeline.STAGES[2:]:
            for k, v in zip(keys, before):
                spark.conf.set(k, v)
            run(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
            assert [spark.conf.get(k) for k in keys] == [str(kernels.BATCH_BYTES), str(kernels.BATCH_ROWS)]
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:4])
    corpus_pipeline.run(spark, sf_dir)
    assert [spark.conf.get(k) for k in keys] == before
