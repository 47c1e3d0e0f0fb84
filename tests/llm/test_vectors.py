"""Vector codes, centroid clusters and token files against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from signalframe.llm import codes, kernels, lloyd, queries, tokenbin, yinyang
from tests.llm.test_llm import rows as text_rows

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "vec_id long, embedding array<double>, label int, code string, v int, part int, n long"


def vectors(seed=3, n=420, width=64):
    """Near-duplicate and tied vectors, all awkward ones, repeated and null ids, and columns whose names clash."""
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(12)]
    out = [(i * 7 % n, [x + rng.gauss(0, 0.1) for x in rng.choice(middle)], rng.choice([None, 1, 2, 3])) for i in range(n)]
    hot = [0.25] * width
    out += [(1000 + i, hot, 9) for i in range(150)]  # one vector a quarter of all times
    out += [(5, [-x for x in hot], 4), (5, [x / 2 for x in hot], 4), (None, hot, 4), (None, middle[0], None)]
    out += [(2000, None, 1), (2001, [0.1] * (width - 1) + [math.nan], 1), (2002, [math.inf] + [0.1] * (width - 1), 1), (2003, [0.1] * (width - 1) + [None], 1)]
    out += [(2004, [-1 / 1024, 1 / 1024] * (width // 2), 1), (2005, [1e5] * width, 7), (2006, [-1e5 + 0.3] * width, 7)]
    rng.shuffle(out)
    return [(a, b, c, "x", 1, 2, 3) for a, b, c in out]


ROWS = vectors()
ODD = [(3000, [0.5] * 63, 1, "x", 1, 2, 3), (3001, [], 1, "x", 1, 2, 3), (3002, [1e9] + [0.1] * 63, 1, "x", 1, 2, 3), (3003, [3e38] * 64, None, "x", 1, 2, 3)]


def usable(rows, scale, width=64):
    whole = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [(r[0], [math.floor(x * scale) for x in r[1]], r[2]) for r in whole]
    most = lloyd.reach(width)
    fits = [r for r in ints if len(r[1]) == width and max(map(abs, r[1])) <= most]
    return fits, [r for r in ints if r not in fits]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain_lloyd(points, centroids, rounds):
    for k in range(rounds + 1):
        at = [min(range(len(centroids)), key=lambda j: (far(p, centroids[j]), j)) for p in points]
        if k == rounds:
            return centroids, at, [far(p, centroids[j]) for p, j in zip(points, at)]
        own = defaultdict(list)
        for p, j in zip(points, at):
            own[j].append(p)
        centroids = [[sum(c) // len(own[j]) for c in zip(*own[j])] if own[j] else centroids[j] for j in range(len(centroids))]


def plain_codes(rows, entries, rounds):
    fits, rest = usable(rows, 1024)
    order = sorted(fits, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books, at, errors = [], [], [0] * len(fits)
    for p in range(4):
        cut = slice(16 * p, 16 * p + 16)
        c, a, d = plain_lloyd([r[1][cut] for r in fits], [r[1][cut] for r in order], rounds)
        books.append(c), at.append(a)
        errors = [x + y for x, y in zip(errors, d)]
    digest = hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
    by = defaultdict(int)
    for r, e in zip(fits, errors):
        by[r[2]] += e
    labels = {r[2] for r in fits}
    sums = lambda label: by[label] if label in labels else None
    out = [(r[0], "".join(f"{a[i]:02x}" for a in at), errors[i], sums(r[2]), digest) for i, r in enumerate(fits)]
    return Counter(out + [(r[0], None, None, sums(r[2]), digest) for r in rest]), books


@pytest.mark.parametrize("odd", [False, True])
def test_codes_against_plain_python(spark, odd):
    rows = ROWS + ODD * odd
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, books = plain_codes(rows, 24, 2)
    got = codes.compress(df, entries=24, rounds=2)
    assert got.codebooks.tolist() == books
    assert Counter(tuple(r) for r in codes.digest(got).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == want
    # later rounds move only what changes
    assert got.moves[0] == 4 * len(usable(rows, 1024)[0]) and got.moves[1] < got.moves[0] / 2
    again = {tuple(r["embedding"]) for r in got.decode().collect()}
    assert all(len(v) == 64 for v in again)


def test_codes_stand_for_their_vectors(spark):
    few = [r for r in ROWS if r[0] is not None and r[0] < 60 and r[1] is not None]
    got = codes.compress(spark.createDataFrame(few, SCHEMA), entries=256)
    back = {r["vec_id"]: r["embedding"] for r in got.decode().collect()}
    kept = [r for r in usable(few, 1024)[0] if [x[0] for x in few].count(r[0]) == 1]
    assert all(far(back[r[0]], [(x + 0.5) / 1024 for x in r[1]]) < 0.3 for r in kept)  # nearly every vector is an entry


@pytest.mark.parametrize("odd", [False, True])
def test_clusters_against_plain_python(spark, odd):
    rows = ROWS + ODD * odd
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    fits, rest = usable(rows, 64)
    rest = [r for r in rest if len(r[1]) == 64]
    draw = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    start = [r[1] for r in sorted(fits, key=draw)[:16]]
    middle, at, d = plain_lloyd([r[1] for r in fits], start, 3)
    sums = defaultdict(int)
    for j, x in zip(at, d):
        sums[j] += x
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    want = Counter((r[0], j, x, sums[j], sum(d), sha[j]) for r, j, x in zip(fits, at, d)) + Counter((r[0], None, None, None, sum(d), None) for r in rest)
    found = yinyang.cluster(df)
    got = yinyang.digest(found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert Counter(tuple(r) for r in got.collect()) == want
    used = [r["n_distances"] for r in found.rows.collect() if r["n_distances"] is not None]
    assert all(16 <= u for u in used) and sum(used) < 0.8 * 4 * 16 * len(used)  # bounds have spared distances


@pytest.mark.parametrize("seed", range(6))
def test_bounds_never_hide_a_nearer_centroid(seed):
    """Many rounds with small integers, so that ties are frequent, against full scans."""
    rng = np.random.default_rng(seed)
    v, k = rng.integers(-3, 4, (400, 3)), int(rng.integers(1, 30))
    c = v[:k].copy()
    of, own, upper, lower, drift, spared = yinyang.group(c, 4), np.full(400, -1), np.zeros(400), None, None, 0
    for _ in range(9):
        own, upper, lower, used = yinyang.assign(v, c, of, own, upper, lower, drift)
        full = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (own == full.argmin(1)).all()
        spared += k * len(v) - int(used.sum())
        dist = np.sqrt(full)
        assert (dist[np.arange(400), own] <= upper + 1e-9).all()
        for g in range(of.max() + 1):
            others = np.where((of == g)[None] & (np.arange(k)[None] != own[:, None]), dist, np.inf).min(1)
            assert (lower[:, g] <= others + 1e-9).all()
        moved = np.array([np.floor_divide(v[own == j].sum(0), (own == j).sum()) if (own == j).any() else c[j] for j in range(k)])
        drift, c = np.sqrt(((moved - c) ** 2).sum(1)) * (1 + 1e-9), moved
    assert k < 8 or spared > 0


def test_squares_are_exact_beyond_doubles():
    most = lloyd.reach(64)
    v = np.array([[most] * 64, [-most] * 64, [1] * 64])
    assert lloyd.squared(v, v).tolist() == [[far(a, b) for b in v.tolist()] for a in v.tolist()]


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert codes.digest(codes.compress(none)).count() == yinyang.digest(yinyang.cluster(none)).count() == 0
    only = spark.createDataFrame([(1, None, 2, "x", 1, 2, 3)], SCHEMA)
    assert codes.digest(codes.compress(only)).count() == yinyang.digest(yinyang.cluster(only)).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 2, "x", 1, 2, 3)], SCHEMA)
    assert [tuple(r)[:4] for r in codes.digest(codes.compress(odd)).collect()] == [(1, None, None, None)]


# --- token files

PIECES = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "Hello", "don't", "'s", " 's", "'re'", "''", "é", "È", "×", "÷", "Łódź", "日本", "　", " ", " ", "😀", "12", "½", ".", ",", "!?", "\x1c", "\x85", "<|endoftext|>", "é", "Ω", "\x00", "x" * 40]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return tokenbin.Encoder(TOKENIZER)


def plain_ids(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_whole_texts(encoder):
    some = texts(1, 6000)
    assert encoder.by_pieces
    got = encoder.encode(*kernels.flat(pa.array(some)))
    assert [x.tolist() for x in got] == [plain_ids(encoder, t) for t in some]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_any_text_encodes_as_whole(encoder, some):
    got = encoder.encode(*kernels.flat(pa.array(some, pa.string())))
    assert [x.tolist() for x in got] == [plain_ids(encoder, t) for t in some]


def test_a_wrong_memory_is_found_out(encoder):
    """Two pieces with one hash would give one of them wrong ids; then the text is encoded whole."""
    own = tokenbin.Encoder(TOKENIZER)
    some = ["alpha beta gamma", "delta epsilon"]
    own.encode(*kernels.flat(pa.array(some)))
    own.ids = np.roll(own.ids, 1)
    assert [x.tolist() for x in own.encode(*kernels.flat(pa.array(some)))] == [plain_ids(own, t) for t in some]


def test_another_kind_of_tokenizer_takes_whole_texts():
    other = tokenbin.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    some = ["Hello  World", "", "it's Tokens"]
    assert not other.by_pieces and [x.tolist() for x in other.encode(*kernels.flat(pa.array(some)))] == [plain_ids(other, t) for t in some]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    own = [(r[0], r[1], "a", 1) for r in text_rows()] + [(100 + i, t, "b", 2) for i, t in enumerate(texts(2, 300))] + [(-3, "before all", "c", 3), (700, "日本" * 90_000, "d", 4), (701, "\n".join(texts(3, 4000)), "e", 5)]
    own += [(702, "the same text again", "f", 6)] * 40
    rng.shuffle(own)
    return own


@pytest.fixture(scope="module")
def root(spark, docs, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('tokens')}/out"
    spark.createDataFrame(docs, "doc_id long, text string, row string, frame int").repartition(4).write.parquet(f"{root}-docs")
    tokenbin.write(spark.read.parquet(f"{root}-docs"), root, TOKENIZER, file_bytes=20_000)
    return root


def test_files_give_the_ids_back(spark, encoder, docs, root):
    want = Counter((d[0], tuple(plain_ids(encoder, d[1]) + [0])) for d in docs)
    got = tokenbin.read_files(spark, root, keep_ids=True).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert len({r["path"] for r in got}) > 4
    # documents ascend through the files, nulls last
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["path"].rpartition("/")[2], r["place"]))]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))


def test_digest_of_files(spark, encoder, docs, root):
    got = sorted(map(tuple, tokenbin.digest(spark, root).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert Counter((d, n, c) for _, d, n, c in got) == Counter((d[0], len(i) + 1, crc32(np.array(i + [0], "<u4").tobytes())) for d in docs for i in [plain_ids(encoder, d[1])])
    upto = 0
    for start, _, n, _ in got:
        assert start == upto
        upto += n
    ids = [d for _, d, *_ in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))


def test_short_documents_by_offset(spark, encoder, docs, root):
    got = tokenbin.fetch(spark, root, [-3, 702, 8, 12345])
    assert got[-3] == [plain_ids(encoder, "before all") + [0]] and len(got[702]) == 40 and set(got) == {-3, 702, 8}
    with pytest.raises(ValueError):
        tokenbin.fetch(spark, root, [1, 2, 3], most=2)


def test_files_are_plain_zstandard(spark, root):
    """Headers and gaps are skippable frames, so any decoder with the dictionary gives the ids of a file one after another."""
    dictionary = tokenbin.dictionary_of(spark, root)
    assert dictionary.content and zstandard.ZstdCompressionDict(dictionary.content).dict_id()
    path = min(r["path"] for r in tokenbin.read_files(spark, root).select("path").distinct().collect())
    content = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary.content)).stream_reader(content, read_across_frames=True).read()
    want = [i for r in sorted(tokenbin.read_files(spark, root, True).filter(f"path = '{path}'").collect(), key=lambda r: r["place"]) for i in r["ids"]]
    assert np.frombuffer(own, "<u2").tolist() == want


def test_another_dictionary_is_refused(spark, root):
    path = min(r["path"] for r in tokenbin.read_files(spark, root).select("path").distinct().collect())
    content = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    other = tokenbin.Dictionary(b"")
    with pytest.raises(ValueError):
        list(tokenbin.documents_in(memoryview(content), other, other.decompressor()))
    with pytest.raises(ValueError):
        list(tokenbin.documents_in(memoryview(b"no frames here"), other, other.decompressor()))


def test_token_files_of_little(spark, encoder, tmp_path):
    schema = "doc_id long, text string"
    for k, rows in enumerate(([], [(1, None)], [(1, "one"), (None, "")])):
        tokenbin.write(spark.createDataFrame(rows, schema), f"file://{tmp_path}/{k}", TOKENIZER)
        got = {r["doc_id"]: r["n_tokens"] for r in tokenbin.digest(spark, f"file://{tmp_path}/{k}").collect()}
        assert got == {r[0]: len(plain_ids(encoder, r[1])) + 1 for r in rows}


def test_op12_against_plain_python(spark, encoder, docs, root, tmp_path):
    import os

    os.symlink(f"{root}-docs".removeprefix("file://"), f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op12_token_files(spark, str(tmp_path)).select("doc_id", "n_tokens").collect())
    assert got == Counter((d[0], len(plain_ids(encoder, d[1])) + 1) for d in docs)
