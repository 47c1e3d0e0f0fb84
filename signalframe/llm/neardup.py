"""Near-duplicate documents by bottom-k sketches.

1. Every whole text becomes its set of distinct word shingles (64-bit hashes).  Documents with the same set form a class;
   a class is named by a fingerprint of its set, so copies never meet each other again.
2. A class keeps a bottom-k sketch: the k smallest hashes.  Inverted lists of retained values find overlaps.  Values that no
   other class retains say that a class has something of its own, so each class is entered only under the first
   ``prefix`` retained values in order of rarity.  Two sets that reach the threshold must meet in such a list: for
   sets within the sketch that is the prefix filter theorem; for larger sets the overlap of the sketches is at least
   ``k - prefix(k) + 1`` but for a chance below 1e-5 at the very threshold, and far below that above it.
3. Classes that share lists form a coarse cluster.  Within clusters, pairs are tried by the estimate from the k smallest
   values of their sketches' union and then verified on the full sets; pairs that are connected already are skipped.
   A large cluster is dealt out as pairs of blocks of bounded bytes and numbers of sets, so that no task holds more than two blocks.
4. Connected components of the verified links give each document the smallest ``doc_id`` that it reaches.

Defined cases: texts that are null or without words have an empty set, link with nothing and are their own component;
a text with fewer words than a shingle has one shingle, the whole sequence; rows that share a ``doc_id`` each get the
component of their own text; rows with a null ``doc_id`` follow their text's class, and are kept if nothing else in
the component has an id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import LOWER, NON_SPACE, U64, Scratch, SpanHash, flat, give_back, grouped_order, groups, lean, map_chunks, mix, spans, windows, without_rows

SHINGLE = 5
PERCENT = 85
K = 64
BLOCK_BYTES = 1 << 20
BLOCK_SETS = 1000
STRIP = 128  # rows of a matrix of pairs that are worked on at once
BITS = 1 << 25


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = SHINGLE):
    """Distinct shingle hashes of each text, in rising order, concatenated; and their offsets."""
    low = LOWER[buf]
    starts, ends = spans(NON_SPACE[buf], offs)
    h = SpanHash(low)(starts, ends)
    word_offs = np.searchsorted(starts, offs)
    counts = np.diff(word_offs)
    doc = np.repeat(np.arange(len(counts)), counts)
    full = windows(h, width)
    whole = doc[: len(full)] == doc[width - 1 :] if len(full) else np.zeros(0, bool)
    hashes, owner = [full[whole]], [doc[: len(full)][whole]]
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            at = word_offs[short]
            out = h[at]
            for i in range(1, n):
                out = mix(out * U64(0x9FB21C651E98DF25) + h[at + i])
            hashes.append(mix(out + U64(n)))
            owner.append(short)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    hashes = hashes >> U64(1)  # positive as signed integers
    by = np.lexsort((hashes, owner)) if len(hashes) < 2 else _by_doc(hashes, owner, len(counts))
    hashes, owner = hashes[by], owner[by]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))])


def _by_doc(hashes, owner, n):
    """Order by document, then hash: one sort of the hashes' leading bits with the document in front settles all but ties."""
    bits = int(max(n - 1, 1)).bit_length()
    own = int(len(hashes) - 1).bit_length()
    keep = 64 - bits - own
    packed = (owner.astype(U64) << U64(64 - bits)) | ((hashes >> U64(63 - keep)) << U64(own)) | np.arange(len(hashes), dtype=U64)
    packed.sort()
    by = (packed & U64((1 << own) - 1)).astype(np.int64)
    packed >>= U64(own)
    tie = packed[1:] == packed[:-1]
    h = hashes[by]
    if np.any(tie & (h[1:] != h[:-1])):
        return np.lexsort((hashes, owner))
    return by


def fingerprints(hashes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    a = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes + U64(0x1234567)), dtype=U64)])
    b = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes ^ U64(0xABCDEF0123456789)), dtype=U64)])
    size = np.diff(offs).astype(U64)
    return mix(a[offs[1:]] - a[offs[:-1]] + size), mix(b[offs[1:]] - b[offs[:-1]] ^ size)


def _node(a, b):
    return pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))


def _sketch(batch, buf, offs, width, k):
    hashes, at = shingle_sets(buf, offs, width)
    size = np.diff(at)
    kept = np.minimum(size, k)
    take = np.repeat(at[:-1], kept) + np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
    a, b = _node(*fingerprints(hashes, at))
    values = hashes[take].astype("<i8").tobytes()
    edges = np.concatenate([[0], np.cumsum(kept)]) * 8
    return {"doc_id": batch.column("doc_id"), "ha": a, "hb": b, "n_shingles": pa.array(size.astype(np.int64)), "sketch": pa.array([values[x:y] for x, y in zip(edges.tolist(), edges[1:].tolist())], pa.binary())}


def _explode(batches):
    for batch in batches:
        buf, offs = flat(batch.column("sketch"))
        n = np.diff(offs) // 8
        of = np.repeat(np.arange(len(n)), n)
        node = batch.column("node").to_numpy()
        for a in range(0, len(of), 1 << 18):
            own = of[a : a + (1 << 18)]
            yield pa.RecordBatch.from_pydict({"node": node[own], "value": np.frombuffer(buf.tobytes(), "<i8")[a : a + (1 << 18)]})


def _block(table: pa.Table, percent: int, k: int):
    """Links that connect a block's sets: each set's root within the block, after estimate and exact check.  Two blocks: only pairs across."""
    node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
    by = np.argsort(node, kind="stable")
    node, side = node[by], side[by]
    sets = [np.frombuffer(x, "<i8") for x in table.column("set").take(pa.array(by)).to_pylist()]
    n = len(sets)
    size = np.array([len(x) for x in sets])
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i, j):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)

    split = len(np.unique(side)) > 1
    if n <= 24:
        for i in range(n):
            for j in range(i + 1, n):
                if (split and side[i] == side[j]) or 100 * min(size[i], size[j]) < percent * max(size[i], size[j]) or find(i) == find(j):
                    continue
                a, b = sets[i][:k], sets[j][:k]
                union = np.union1d(a, b)[:k]
                both = np.intersect1d(a, b, assume_unique=True)
                if len(union) == k and 100 * (np.searchsorted(both, union[-1], "right")) < (percent - 30) * k:
                    continue  # more than six standard deviations below the threshold
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= percent * (size[i] + size[j] - shared):
                    join(i, j)
    else:
        shared = _overlaps(sets, n)
        good = np.empty((n, n), bool)
        for a in range(0, n, STRIP):  # in strips, so that no further matrix of all pairs is held
            own = shared[a : a + STRIP].astype(np.int64)
            good[a : a + STRIP] = 100 * own >= percent * (size[a : a + STRIP, None] + size[None, :] - own)
            if split:
                good[a : a + STRIP] &= side[a : a + STRIP, None] != side[None, :]
        del shared
        np.fill_diagonal(good, True)
        while True:  # the smallest place that a set's links reach, until nothing changes
            least = np.concatenate([np.where(good[a : a + STRIP], root[None, :], n).min(1) for a in range(0, n, STRIP)])
            least = least[least]
            if np.array_equal(least, root):
                break
            root = least
    return node, np.array([find(i) for i in range(n)])


def _overlaps(sets, n, wide: int = 1024):
    """Exact sizes of all intersections (whole numbers below 2**24): values that two sets share become columns of a 0/1 matrix, taken some at a time."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    by = grouped_order(values.astype(U64))
    values, owner = values[by], owner[by]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    cls = np.cumsum(new) - 1
    count = np.bincount(cls)
    shared = count[cls] > 1
    cls, owner = cls[shared], owner[shared]
    column = np.cumsum(np.append(True, cls[1:] != cls[:-1])) - 1 if len(cls) else cls
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, [a, a + wide])
        m = np.zeros((n, wide), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        for b in range(0, n, STRIP):
            out[b : b + STRIP] += m[b : b + STRIP] @ m.T
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document, at ``percent`` hundredths of similarity or more."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = docs.select("doc_id", "text")
    rows = scratch.keep(map_chunks(docs, lambda *a: _sketch(*a, width, k), "doc_id long, ha long, hb long, n_shingles long, sketch binary"), "rows")
    full = rows.filter("n_shingles > 0")
    classes = scratch.keep(
        full.groupBy(F.col("ha").alias("node"), "hb").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes"
    )
    values = classes.select("node", "sketch").mapInArrow(lean(_explode), "node long, value long")
    spread = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    common = values.join(spread, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    common = common.join(classes.select("node", F.col("n_shingles").alias("size")), "node")
    # a class has at most k retained values, so the list is bounded; its values that nobody shares come first in order of rarity
    own = F.least("size", F.lit(k)) - F.size("held")
    reach = F.when(F.col("size") <= percent * k // 100, F.floor(F.col("size") * (100 - percent) / 100) + 1).otherwise(prefix(k, percent))
    entered = common.select("node", F.explode(F.slice("held", F.lit(1), F.greatest(F.lit(0), reach - own).cast("int"))).alias("v")).select("node", "v.value")
    entered = scratch.keep(entered, "entered")
    hubs = entered.groupBy("value").agg(F.min("node").alias("hub"))
    pairs = entered.join(hubs, "value").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = scratch.keep(components(pairs, scratch, "coarse"), "clusters")
    links = _verified(docs, classes, clusters, scratch, percent, width, k, block_bytes)
    merged = components(links, scratch, "fine")
    known = classes.select("node", "hb", "first").join(merged, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("first").alias("least"))
    named = scratch.keep(known.join(least, "root").select(F.col("node").alias("ha"), "hb", "least"), "named")
    out = rows.drop("sketch").join(named, ["ha", "hb"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def prefix(k: int, percent: int) -> int:
    """How many of k retained values a class is entered under: k - c + 1, where c is the overlap of two sketches at the threshold, less 4.9 standard deviations.

    Sets of up to ``percent`` hundredths of k have all partners within the sketch as well; there the theorem's prefix holds."""
    share = percent / 100
    return min(k, int(np.ceil(k - (k * share - 4.9 * np.sqrt(k * share * (1 - share))))) + 1)


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits, whatever the input, with a bit for the hash of each id: what it lacks needn't be shuffled."""
    place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(BITS))
    words = ids.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, U64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(U64)
    del words
    give_back()
    return out


def seen(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = np.mod(hashes, BITS)
    return (bitmap[place >> 6] >> (place & 63).astype(U64)) & U64(1) == 1


def _verified(docs, classes, clusters, scratch, percent, width, k, block_bytes):
    """Links between classes of a cluster that hold on the full sets, at most one for each class and block pair."""
    member = clusters.join(classes.select("node", "hb", "first", "n_shingles"), "node")
    totals = member.groupBy("root").agg(F.sum(8 * F.col("n_shingles")).alias("bytes"), F.count("*").alias("sets"))
    totals = totals.select("root", F.greatest(F.ceil(F.col("bytes") / block_bytes), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int").alias("blocks"))
    member = scratch.keep(member.join(totals, "root").select("node", "hb", "first", "root", "blocks"), "members")
    bitmap = id_bitmap(member.select("first"))
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def full(batch, buf, offs, bits):
        maybe = pa.array(seen(bits, batch.column("_id_hash").to_numpy()))
        part = batch.filter(maybe)
        if not part.num_rows:
            return None
        hashes, at = shingle_sets(*flat(part.column("text")), width)
        a, b = _node(*fingerprints(hashes, at))
        raw, edges = hashes.astype("<i8").tobytes(), at * 8
        return {"node": a, "hb": b, "doc_id": part.column("doc_id"), "set": pa.array([raw[x:y] for x, y in zip(edges.tolist(), edges[1:].tolist())], pa.binary())}

    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("_id_hash"))
    sets = map_chunks(hashed, full, "node long, hb long, doc_id long, set binary", setup=lambda: held.value)
    sets = sets.withColumnRenamed("doc_id", "first_id").join(member, ["node", "hb"]).filter(F.col("first_id").eqNullSafe(F.col("first"))).select("node", "root", "blocks", "set")
    sets = sets.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    low, high = F.least("side", F.col("other")), F.greatest("side", F.col("other"))
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", low.alias("p"), high.alias("q"), "side", "node", "set")
    n = max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(n, "root", "p", "q").sortWithinPartitions("root", "p", "q", "node")

    def verify(batches):
        for own in groups(batches, ["root", "p", "q"]):
            own = own.combine_chunks()
            nodes = own.column("node").to_numpy()
            once = np.append(True, nodes[1:] != nodes[:-1])
            own = own.filter(pa.array(once))
            if own.num_rows < 2:
                continue
            node, root = _block(own, percent, k)
            linked = root != np.arange(len(root))
            if linked.any():
                yield pa.RecordBatch.from_pydict({"a": node[linked], "b": node[root[linked]]})

    return dealt.mapInArrow(lean(verify), "a long, b long")


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest ``doc_id``, by file and row where several have it; null ids come last.

    Documents without words stay.  Rows are judged one by one, also where they share a ``doc_id`` or have none."""
    scratch = Scratch(docs.sparkSession, "neardup")

    def judge(rows: DataFrame) -> DataFrame:
        linked = scratch.keep(near_duplicates(rows, **settings).filter(~F.col("kept")).select("doc_id", "component_id"), "linked")
        every = linked.unionByName(linked.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
        named = scratch.keep(every.join(rows.select("doc_id", "id"), "doc_id"), "named")
        stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("m")).select(F.col("m.doc_id").alias("doc_id"))
        return named.select("doc_id").join(stays, "doc_id", "left_anti")

    return without_rows(docs, judge, scratch)
