"""The text operators against plain Python on a small, awkward table."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalframe.llm import components, decontaminate, kernels, langid, licenses, neardup, pieces, pii, quality, repeats, shards, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, lang="en"):
    stems = {"en": "the of and thing water over light", "fr": "le la étoile où être eau nuit"}[lang].split()
    return " ".join(rng.choice(stems) + rng.choice(["", "ing", "s", "ly", "é"]) + str(rng.randint(0, 60)) * (rng.random() < 0.5) for _ in range(n))


def rows():
    rng = random.Random(5)
    base = words(rng, 200)
    passage = words(rng, 90)
    out = [(0, None, "en"), (1, "", "fr"), (2, " \n\t ", None), (3, "😀 ?!", "en"), (4, "One Two", "en"), (5, "one  two", "fr"), (6, "x" * 3000, "en"), (7, "a b " * 900, None)]
    for i in range(8, 30):
        out.append((i, words(rng, rng.randint(30, 300), "fr" if i % 3 == 0 else "en"), "fr" if i % 3 == 0 else "en"))
    for i in range(30, 42):  # near copies with a few edits
        w = base.split(" ")
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
        out.append((i, " ".join(w), "en"))
    for i in range(42, 48):
        out.append((i, words(rng, 40) + " " + passage + "\n" + words(rng, 60), "en"))
    out += [(48, base, "en"), (48, base, "en"), (None, base, "en"), (None, "alone and unlike all others here", None), (49, passage + passage, "fr")]
    return [(a, b, c, "s", len(b or ""), "extra", 7) for a, b, c in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def multi(df, *cols):
    return Counter(tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in cols) for r in df.collect())


def test_kernels():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first, cls, sizes = kernels.distinct(h)
    assert (h[first][cls] == h).all() and sizes.sum() == 500
    buf, offs = kernels.flat(pa.array(["ab c", None, "", " c ab"]))
    s, e = kernels.spans(kernels.NON_SPACE[buf], offs)
    got = [bytes(buf[a:b]) for a, b in zip(s, e)]
    assert got == [b"ab", b"c", b"c", b"ab"]
    x = kernels.SpanHash(buf)(s, e)
    assert x[0] == x[3] and x[1] == x[2] and x[0] != x[1]


def test_language(docs, none):
    model = langid.fit(docs)
    got = {(r["doc_id"]): r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got[0] == got[1] == got[3] == "und"
    assert all(got[r[0]] == r[2] for r in ROWS if r[0] is not None and 8 <= r[0] < 42)
    assert langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


def brute_windows(text, items, window=13):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    mine, hit, found = w(text), set(), set()
    for k, t in items:
        own = w(t)
        n = min(len(own), window)
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(mine) - n + 1) if n else ():
            if tuple(mine[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(k))
    return len(mine), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, block_bytes):
    items = [(1, ROWS[10][1][:150]), (2, "One two"), (3, None), (4, "..."), (5, ROWS[45][1][20:260]), (6, "not in there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs, bench, block_bytes=block_bytes)
    want = Counter((r[0], *brute_windows(r[1], items)) for r in ROWS)
    assert multi(got, "doc_id", "n_words", "n_hit", "items") == want
    longest = {r["doc_id"]: r["longest"] for r in got.collect()}
    assert longest[10] >= 13
    left = multi(decontaminate.remove(docs, bench, block_bytes=block_bytes), "doc_id", "kept")
    assert sum(left.values()) == sum(n for (_, w, h, _), n in want.items() if not (h > 0 and 20 * h >= w))
    assert decontaminate.matches(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_suffix_array():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, 400).astype(np.uint64)
    order = decontaminate.suffix_array(codes, 500)
    key = lambda i: tuple(codes[i:][: (list(codes[i:]).index(0) if 0 in codes[i:] else len(codes))].tolist())
    keys = [key(i) for i in order]
    assert keys == sorted(keys)


PII_CASES = [
    ("mail a.b@c.example.org, ok", ["email:5:22"]), ("x@y", []), ("at 256.1.1.1 and 10.0.0.255", ["ip:17:27"]), ("card 4111 1111 1111 1111.", ["card:5:24"]), ("card 4111 1111 1111 1112", []),
    ("+1 (988) 555-2485 é", ["phone:0:17"]), ("é 😀 a@b.co", ["email:4:10"]), ("a@b.c_x@d.org", ["email:0:5", "email:5:13"]), ("pay GB82 WEST 1234 5698 7654 32 now", ["iban:4:31"]), ("pay GB82 WEST 1234 5698 7654 33 now", []),
    ("ssn 123-45-6789", ["ssn:4:15"]), ("no 123-45-6789", []), (None, []), ("", []), ("1" * 5000, []),
]


def test_pii(spark):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, (t, _) in enumerate(PII_CASES)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    assert [got[i] for i in range(len(PII_CASES))] == [",".join(x) for _, x in PII_CASES]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] == "mail <EMAIL>, ok" and clean[6] == "é 😀 <EMAIL>" and clean[12] is None and clean[7] == "<EMAIL><EMAIL>"


def test_pii_many_matches(spark):
    text = " ".join(f"u{i}@h.org" for i in range(300))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.find(df).first()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [m.span() for m in re.finditer(r"\S+", text)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block_bytes", [1 << 20, 4000])
def test_near_duplicates(docs, none, block_bytes):
    sets = [shingles(r[1]) for r in ROWS]
    root = list(range(len(ROWS)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(ROWS):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(ROWS))
    assert multi(neardup.near_duplicates(docs, block_bytes=block_bytes), "doc_id", "n_shingles", "component_id") == want
    assert neardup.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(30)]
    root = {x: x for e in links for x in e}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(links, "a long, b long"), kernels.Scratch(spark, "t"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: find(x) for e in links for x in e if e[0] != e[1]}


def test_repeats(docs, none):
    texts = [(r[1] or "").encode() for r in ROWS]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = Counter()
    for r, t in zip(ROWS, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        want[(r[0], len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())] += 1
    assert multi(repeats.dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert repeats.dedup(none).count() == 0


def test_warc(spark, tmp_path):
    big = "é" * 80 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://a/x", "y" * 200), (2, None, "y" * 200), (3, "u", None), (4, "u v", "short"), (5, "u", "short"), (None, "n", "y" * 200), (6, "q", big), (7, "q", big), (1, "http://a/x", "y" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/a")
    captures = warc.assemble(warc.read_records(spark, f"file://{tmp_path}/a"))
    assert captures.filter("request IS NULL OR metadata IS NULL").count() == 0
    want = Counter()
    for p, _, h in pages:
        raw = (h or "").encode()
        first = {200: 1, len(big.encode()): 6}.get(len(raw)) if len(raw) >= 100 else None
        again = first is not None and p != first
        want[(p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert multi(warc.digest(captures), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    warc.write(df.limit(0), f"file://{tmp_path}/b")
    assert warc.assemble(warc.read_records(spark, f"file://{tmp_path}/b")).count() == 0


def test_kneser_ney_sums_to_one():
    rng = random.Random(2)
    text = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    counts = Counter()
    for w in text:
        s = "\x01" + w + "\x02"
        for i in range(1, len(s)):
            counts[s[max(0, i - 2) : i + 1]] += 1
    pack = lambda g: sum(ord(c) << (8 * k) for k, c in enumerate(reversed(g)))
    m = quality.KneserNey(["x"] * len(counts), np.array([pack(g) for g in counts], np.uint64), np.array(list(counts.values())), order=3)
    for context in ("\x01", "\x01a", "ab", "bc"):
        grams = np.array([pack(context + chr(c)) for c in range(1, 256)] + [pack(context) << 8], np.uint64)
        p = np.exp(m.score(grams, np.full(256, len(context) + 1), np.zeros(256, int)))
        assert p.sum() == pytest.approx(1, abs=1e-3)


def test_quality(docs, none):
    got = quality.quality_rules(docs)
    want = Counter()
    for r in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        c = Counter(zip(w, w[1:], w[2:]))
        rep = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines, dup = set(), 0
        for line in (r[1] or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in lines
                lines.add(line)
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), dup, len(rep), len(w) < 50 or 2 * len(rep) > len(w))] += 1
    assert multi(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.filter("base_failed AND kept").count() == 0 and got.filter("kept").count() > 10
    assert quality.quality_rules(none).count() == 0


@pytest.mark.parametrize("n", [5, len(ROWS)])
def test_shards(docs, n):
    part = docs.limit(n)
    got = shards.shard(part).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == n and max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert {r["law"] for r in got} == {"rows"}
    if n == len(ROWS):
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, crc32((r[1] or "").encode())) for r in ROWS)


def test_shards_gather_large_groups(spark):
    df = spark.createDataFrame([(i, "same" if i < 200 else f"t{i}") for i in range(480)], "doc_id long, text string")
    got = shards.shard(df)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {30}
    spread = got.filter(F.col("doc_id") < 200).groupBy("shard").count().filter("count >= 15").count()
    assert spread >= 5  # of the 6.7 shards that the group needs


def test_shards_leave_no_small_group_cut(spark):
    """Where single documents leave room, every group ends whole on one shard, through rounds alone."""
    df = spark.createDataFrame([(i, f"g{i % 90}" if i < 270 else f"t{i}") for i in range(640)], "doc_id long, text string").repartition(4)
    got = shards.shard(df)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {40}
    assert shards.cut_links(got).first() == (270, 0)


def test_shards_against_plain_python(spark):
    """The rounds in plain Python, from the same start and with the same order of who is let in."""
    text = lambda i: "hot" if i % 3 == 0 else f"g{i % 17}" if i % 3 == 1 and i < 150 else f"t{i}"
    docs = spark.createDataFrame([(i, text(i)) for i in range(203)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.shard(docs).collect()}
    h = F.xxhash64("row")
    base = docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.sha2(F.col("text").cast("binary"), 256).alias("group"), F.pmod(h, F.lit(16)).alias("start"), F.pmod(h, F.lit(256)).alias("cell")).collect()
    ties = {(r["group"], r["shard"]): r["h"] for r in spark.createDataFrame([(g, s) for g in {r["group"] for r in base} for s in range(16)], "group string, shard int").select("group", "shard", F.xxhash64("group", "shard").alias("h")).collect()}
    order = {r["row"]: (r["cell"], r["row"]) for r in base}
    group, members = {r["row"]: r["group"] for r in base}, Counter(r["group"] for r in base)
    place = {r["row"]: r["start"] for r in base if members[r["group"]] > 1}
    capacity = [203 // 16 + (s < 203 % 16) for s in range(16)]

    def poured(rows, free):
        slots = [s for s in range(16) for _ in range(free[s])]
        return dict(zip(sorted(rows, key=order.get), slots))

    over = [r for s in range(16) for r in sorted((r for r in place if place[r] == s), key=order.get)[capacity[s] :]]
    if over:
        stay = Counter(place[r] for r in place if r not in set(over))
        place |= poured(over, [c - stay[s] for s, c in enumerate(capacity)])
    still = i = 0
    while still < 2:
        i += 1
        used, held = Counter(place.values()), Counter((group[r], s) for r, s in place.items())
        room = [c - used[s] for s, c in enumerate(capacity)]
        movers = {}
        for g in {g for g, _ in held}:
            parts = [(n, ties[g, s], s) for (x, s), n in held.items() if x == g]
            able = [p for p in parts if i % 2 or room[p[2]] > 0]
            if len(parts) > 1 and able:
                best = max(able)
                for p in parts:
                    if p[:2] < best[:2]:
                        movers.setdefault((p[2], best[2]), []).extend(r for r in place if group[r] == g and place[r] == p[2])
        allowed = shards.quotas({k: len(v) for k, v in movers.items()}, room)
        for (a, b), n in allowed.items():
            for r in sorted(movers[a, b], key=order.get)[:n]:
                place[r] = b
        still = 0 if allowed else still + 1
    used = Counter(place.values())
    place |= poured([r["row"] for r in base if r["row"] not in place], [c - used[s] for s, c in enumerate(capacity)])
    want = {}
    for s in range(16):
        for k, r in enumerate(sorted((r for r in place if place[r] == s), key=order.get)):
            want[r] = (s, k)
    assert {r["doc_id"]: want[r["row"]] for r in base} == got


def test_quotas():
    assert shards.quotas({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert shards.quotas({(0, 1): 5, (2, 1): 5}, [9, 7, 9]) == {(0, 1): 5, (2, 1): 2}
    assert shards.quotas({(0, 1): 5}, [0, 0]) == {}


def vocabulary():
    names = ["<unk>", "<s>"] + [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "a", "b", "ab", "▁ab", "c", "abc", "é", "▁▁"]
    return pieces.Pieces(names, [0.0] * 258 + [-3.0, -2.5, -4.0, -4.0, -5.0, -5.5, -4.0, -6.0, -7.0, -9.0], list(range(2, 258)), set(range(258)))


def test_pieces(spark):
    p = vocabulary()
    rng = random.Random(4)
    texts = ["", "a", "  ab", "▁", "x\ny", "é" * 3, "a" * 500] + ["".join(rng.choice("aabbc é😀\n") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    table = {k: (i, p.score[i]) for i, k in enumerate(["<unk>"] * 258 + ["▁", "▁a", "a", "b", "ab", "▁ab", "c", "abc", "é", "▁▁"]) if i >= 258}

    def brute(x):
        if not x:
            return 0.0
        y = "▁" + x.replace("▁", "\0").replace(" ", "▁")
        best = [0.0] + [-1e300] * len(y)
        for i in range(len(y)):
            for n in range(1, 4):
                s = table.get(y[i : i + n], (0, p.unknown if n == 1 else None))[1]
                if s is not None and i + n <= len(y):
                    best[i + n] = max(best[i + n], best[i] + s)
        return best[-1]

    buf, offs = kernels.flat(pa.array(texts))
    ids, at = p.encode(buf, offs)
    out, ends = p.decode(ids, at)
    assert pieces._strings(out, ends).to_pylist() == texts
    for k, x in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        known = sum(p.score[i] for i in own if i >= 258)
        lone = len(re.findall(r"(?s).", bytes([i - 2 for i in own if i < 258]).decode()))
        assert known + lone * p.unknown == pytest.approx(brute(x))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    assert pieces.round_trip(df, p).filter("NOT exact").count() == 0
    back = pieces.decode(pieces.encode(df, p), p)
    assert back.filter("coalesce(text, '') <> decoded").count() == 0


def test_licenses(docs, none, spark):
    mit = licenses.TEMPLATES["MIT"][1]
    extra = [(100, "Intro\nReleased under the MIT License!\nmore"), (101, mit), (102, mit.replace("copies", "copy")), (103, "This work is licensed under the GNU General Public License, version 2."), (104, None)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = Counter()
    for k, t in [(r[0], r[1]) for r in ROWS] + extra:
        name, score, names = licenses.brute(t)
        want[(k, name, score, tuple(names))] += 1
    assert multi(licenses.scan(df), "doc_id", "license", "score", "licenses") == want
    assert licenses.scan(none).count() == 0


def test_quality_keeps_every_gram(spark, docs):
    scratch = kernels.Scratch(spark, "t")
    counts = scratch.keep(quality.gram_counts(docs, 4), "counts")
    rows = counts.collect()
    texts = Counter()
    for r in ROWS:
        s = b"\1" + (r[1] or "").lower().encode() + b"\2" if (r[1] or "").isascii() else None
        for i in range(1, len(s) if s else 0):
            texts[(r[2] or "", s[max(0, i - 3) : i + 1])] += 1
    got = {(r["lang"], r["gram"].to_bytes(8, "big").lstrip(b"\0")): r["n"] for r in rows}
    assert all(got[k[0], k[1].replace(b"\0", b"\3")] >= n for k, n in texts.items())
    model = quality.KneserNey([r["lang"] for r in rows], np.array([r["gram"] for r in rows], np.uint64), np.array([r["n"] for r in rows]), order=4)
    found = quality.probabilities(counts, 4, scratch).collect()
    assert {(r["lang"], r["gram"]) for r in found} == {(r["lang"], r["gram"]) for r in rows} and len(found) == len(rows)
    grams = np.array([r["gram"] for r in found], np.uint64)
    have = np.array([len(r["gram"].to_bytes(8, "big").lstrip(b"\0")) for r in found])
    assert [r["logp"] for r in found] == pytest.approx(model.score(grams, have, np.array([model.names.index(r["lang"]) for r in found])).tolist(), abs=1e-5)


def test_quality_blocks(docs):
    one, many = (multi(quality.quality_rules(docs, block=n), "doc_id", "log_ppl", "kept") for n in (1 << 20, 2000))
    assert one == many


def test_quality_sees_word_order(spark):
    rng = random.Random(6)
    text = "the quick brown fox jumps over a lazy dog while seven wise owls watch from old trees by our river bank " * 5
    mixed = text.split()
    rng.shuffle(mixed)
    df = spark.createDataFrame([(i, text if i else " ".join(mixed), "en") for i in range(30)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert got[0]["log_ppl"] > got[1]["log_ppl"] + 0.1
    assert not got[0]["log_ppl"] <= got[0]["high"] and got[1]["log_ppl"] <= got[1]["high"]


def test_repeats_without_blocks(spark):
    """Copies with one anchor or none: no block is there to repeat."""
    rng = random.Random(8)
    low = [("-" * 200 + f"a line of its own {i}" + "-" * 200) for i in range(12)] + ["a" * 300 + "b" + "a" * 300, " " * 400 + "short line here\n"]
    low += ["".join(rng.choice("ab") * rng.randint(60, 200) for _ in range(5)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(low * 2)] + [(99, "x" + low[0] + "y"), (100, words(rng, 200))]
    texts = [t.encode() for _, t in rows]
    count = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = Counter()
    for (k, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[(k, len(t), sum(gone))] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert multi(repeats.dedup(df), "doc_id", "n_bytes", "n_removed") == want


def test_licenses_wrapped_and_embedded(spark):
    import textwrap

    rng = random.Random(9)
    before, after = words(rng, 80), words(rng, 120)
    texts, want = [], []
    for name, own in licenses.TEMPLATES.items():
        for t in own:
            texts += ["\n".join(textwrap.wrap(t, 30)), f"{before} {t} {after}", f"{before}\n" + "\n".join(textwrap.wrap(t, 70)) + f"\n{after}"]
            want += [name] * 3
    twice = licenses.TEMPLATES["MIT"][0]
    texts += [f"{before} {twice} {after} {twice}", before + after, "in source and binary forms " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["license"], got[i]["score"], got[i]["licenses"]) == licenses.brute(t)
        assert i >= len(want) or want[i] in got[i]["licenses"]
    n = len(want)
    assert got[n]["n_matches"] == 2 and got[n]["start"] == len(before.encode()) + 1 and got[n + 1]["license"] is None


def test_language_keeps_every_row(docs):
    one, many = (multi(langid.predict(docs, langid.fit(docs, block=n)), "doc_id", "lang_pred", "score") for n in (1 << 20, 60))
    assert one == many
    model = langid.fit(docs, block=60)
    counted = langid.counts(docs.filter("lang IS NOT NULL AND text IS NOT NULL")).select("sort", "key").distinct().count()
    assert sum(len(b.value[0]) for x in model.blocks for b in x) == counted and len(model.blocks[0]) > 1
