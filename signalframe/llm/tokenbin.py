"""Token ids as binary files: documents compressed one by one with a shared zstandard dictionary.

A file is a run of zstandard frames.  Each document is a skippable frame with its header (format, width of an id, ``doc_id``, number of ids,
first bytes of the dictionary's SHA-256) and a frame with its ids as little-endian integers; an empty skippable frame ends it, which is what
Spark's text writer puts between records, so the commit protocol survives lost executors.  ``zstd -d -D dictionary`` gives a
file's ids.  Below a folder lie ``ids/`` (the files, in ascending order of documents), ``dictionary/`` and ``index/``: path, offset and length of each
document's frames, so that ``fetch`` reads the bytes of a short document only.

Encoding gives what the tokenizer gives for the whole text.  The pattern of byte-level tokenizers begins anew at certain places (``piece_cuts``), whatever stands
before them; so equal pieces between them are encoded once and looked up afterwards, and every text is decoded again and compared: one that
differs (two pieces with one hash) is encoded whole.  A tokenizer of another kind encodes whole texts.

Defined cases: a null text is empty and has the end id alone.  Documents follow each other by ``doc_id``, then by file and row; null ids come last.  Repeated
rows are documents of their own.  Strings of special tokens in a text are ordinary text.  A table without rows gives no file and no rows.  The dictionary is trained on at most
``SAMPLES`` documents of at most ``SAMPLE_BYTES`` of text (the others could not be short documents), drawn by hash; where training has too little to learn from, frames go without.
"""

from __future__ import annotations

import hashlib
import json
import struct
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import Scratch, SpanHash, chunks, distinct, flat, lean, with_rows

END = 0
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1024, 8192, 1 << 16, 3
FILE_BYTES = 16 << 20  # of a file of frames, about
CHUNK = 3 << 20  # of text that a task encodes at once
MOST_PIECES = 1 << 21  # that a worker remembers, also from task to task

SKIPPABLE = 0x184D2A50
HEADER = struct.Struct("<IIBBBxqQ8s")  # magic, size, version, bytes of an id, whether there is a doc_id, doc_id, ids, dictionary
GAP = struct.pack("<II", SKIPPABLE, 0).decode("ascii")

#: Kinds of bytes whose kind of character is certain from at most two bytes; all others are of kind 0.
LETTER, DIGIT, SIGN, SPACE, BREAK = 1, 2, 3, 4, 5
KIND = np.zeros(256, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = SIGN
KIND[0x20], KIND[0x09:0x0E] = SPACE, BREAK
QUOTE = 0x27


def kinds(buf: np.ndarray) -> np.ndarray:
    """The kind of each byte; letters of U+00C0 to U+017F are two bytes of one kind."""
    out = KIND[buf]
    lead = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5))
    lead = lead[(buf[lead] != 0xC3) | ((buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7))]  # the signs for times and division
    out[lead] = out[lead + 1] = LETTER
    return out


def piece_cuts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin (and the end), and the kinds of the bytes.

    The pattern of byte-level tokenizers ends a token at each of these places and goes on as if nothing stood before: where a visible character begins another run
    (an apostrophe may open a contraction, so nothing is cut behind it), at white space behind a visible character, at a space before one, and
    behind a single line break between two."""
    kind = kinds(buf)
    seen = (kind >= LETTER) & (kind <= SIGN)
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = seen[:-1] & (kind[1:] != kind[:-1]) & (kind[1:] > 0) & ((buf[:-1] != QUOTE) | (kind[1:] > SIGN))
    cut[:-2] |= (kind[:-1] == SPACE) & seen[1:]
    cut[2:-1] |= seen[:-2] & (kind[1:-1] == BREAK) & seen[2:]
    # what lies across the edge of two texts doesn't count
    cut[offs[1:] - 1] = cut[np.minimum(offs + 1, len(buf))] = False
    inner = offs[(offs > 0) & (offs < len(buf))]
    before, after = inner - 1, inner + 1
    ok = before > 0
    at = before[ok]
    cut[at] = seen[at - 1] & (kind[at] != kind[at - 1]) & (kind[at] > 0) & ((buf[at - 1] != QUOTE) | (kind[at] > SIGN))
    at = after[after < len(buf)]
    cut[at] = (seen[at - 1] & (kind[at] != kind[at - 1]) & (kind[at] > 0) & ((buf[at - 1] != QUOTE) | (kind[at] > SIGN))) | ((kind[at] == SPACE) & np.append(seen[1:], False)[at])
    cut[offs] = True
    return np.flatnonzero(cut), kind


def _bytes_of() -> dict[str, int]:
    """The bytes that the letters of byte-level vocabularies stand for: visible Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """A tokenizer file; in a task, ids of whole texts by way of their distinct pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        self.by_pieces = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer") and not said.get("post_processor")
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if n <= 1 << 16 else 4
        if self.by_pieces:
            back = _bytes_of()
            words = [b""] * n
            for word, i in said["model"]["vocab"].items():
                words[i] = bytes(back[c] for c in word)
            self.sizes = np.array([len(w) for w in words], np.int64)
            self.places = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
            self.signs = {b: c for c, b in back.items()}
            self.letters = np.frombuffer(b"".join(words), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = {"hash": np.zeros(0, np.uint64), "at": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
        self.ids = np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, buf: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes pieces and remembers them.  One run of letters, digits or signs, with or without a space before it, is one token of the pattern, so that the model takes it at once."""
        sizes = ends - starts
        edges = np.cumsum(sizes)
        every = np.repeat(starts - (edges - sizes), sizes) + np.arange(edges[-1])
        own, marks, heads = kind[every], buf[every] == QUOTE, edges - sizes
        bare = own[heads] == SPACE
        odd = np.add.reduceat((own == 0) | (own > SIGN) | marks, heads) - bare
        plain = (odd == 0) & (sizes > bare)
        text = buf[every].tobytes()
        model, ids = self.tokenizer.model.tokenize, [None] * len(starts)
        letters = text.decode("latin-1").translate(self.signs)
        for i, a, b in zip(np.flatnonzero(plain).tolist(), heads[plain].tolist(), edges[plain].tolist()):
            ids[i] = [t.id for t in model(letters[a:b])]
        rest = np.flatnonzero(~plain).tolist()
        for i, got in zip(rest, self.whole([text[a:b].decode() for a, b in zip(heads[rest].tolist(), edges[rest].tolist())]) if rest else []):
            ids[i] = got.tolist()
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat_ids = np.fromiter((i for part in ids for i in part), np.int32, int(counts.sum()))
        at = len(self.ids) + np.cumsum(counts) - counts
        place = np.searchsorted(self.known["hash"], hashes)  # hashes come in order
        self.known = {"hash": np.insert(self.known["hash"], place, hashes), "at": np.insert(self.known["at"], place, at), "n": np.insert(self.known["n"], place, counts)}
        self.ids = np.concatenate([self.ids, flat_ids])

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a flat buffer of UTF-8."""
        texts = lambda rows: [buf[offs[i] : offs[i + 1]].tobytes().decode() for i in rows]
        if not self.by_pieces:
            return self.whole(texts(range(len(offs) - 1)))
        if not len(buf):
            return [np.zeros(0, np.int32)] * (len(offs) - 1)
        edges, kind = piece_cuts(buf, offs)
        starts, ends = edges[:-1], edges[1:]
        h = SpanHash(buf)(starts, ends)
        first, cls, _ = distinct(h)
        order = np.argsort(h[first], kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        first, own = first[order], h[first][order]
        if len(self.known["hash"]) + len(own) > MOST_PIECES:
            self.forget()
        place = np.searchsorted(self.known["hash"], own)
        new = np.ones(len(own), bool)
        inside = place < len(self.known["hash"])
        new[inside] = self.known["hash"][place[inside]] != own[inside]
        if new.any():
            self._learn(buf, kind, starts[first[new]], ends[first[new]], own[new])
            place = np.searchsorted(self.known["hash"], own)
        place = place[back]
        at, n = self.known["at"][place][cls], self.known["n"][place][cls]
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(at - (upto - n), n) + np.arange(upto[-1])]
        cuts = np.concatenate([[0], upto])[np.searchsorted(edges, offs)]
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in self._differ(buf, offs, ids, cuts):
            out[i] = self.whole(texts([i]))[0]
        return out

    def _differ(self, buf: np.ndarray, offs: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> list[int]:
        """The texts that their ids don't decode to."""
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        again = self.letters[np.repeat(self.places[ids] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]
        bytes_at = np.concatenate([[0], upto])[cuts]
        if np.array_equal(bytes_at, offs) and np.array_equal(again, buf):
            return []
        return [i for i, (a, b, c, d) in enumerate(zip(offs, offs[1:], bytes_at, bytes_at[1:])) if not np.array_equal(buf[a:b], again[c:d])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Dictionary:
    """Bytes of a zstandard dictionary (none: frames go without) and their SHA-256."""

    def __init__(self, content: bytes):
        self.content, self.sha256 = content, hashlib.sha256(content).digest()

    def _dict(self):
        return zstandard.ZstdCompressionDict(self.content) if self.content else None

    def compressor(self, level: int = LEVEL) -> zstandard.ZstdCompressor:
        d = self._dict()
        if d is not None:
            d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d) if d is not None else zstandard.ZstdCompressor(level=level)

    def decompressor(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(dict_data=self._dict())


def train(docs: DataFrame, path: str, end: int = END) -> Dictionary:
    """The dictionary of a bounded sample of short documents: those whose text has the smallest hashes."""
    short = docs.filter(F.octet_length("text").between(1, SAMPLE_BYTES)).select("text", F.xxhash64("text").alias("h"))
    drawn = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(SAMPLES).collect()]  # 8 bytes each, so that a task sends the driver little
    if not drawn:
        return Dictionary(b"")
    texts = [r["t"] for r in short.filter(F.col("h") <= drawn[-1]).groupBy("h").agg(F.min("text").alias("t")).orderBy("h").collect()]
    buf, offs = flat(pa.array(texts))
    own = encoder(path)
    samples = [serialize(ids, own.width, end) for ids in own.encode(buf, offs)]
    own.forget()
    try:
        return Dictionary(zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes())
    except zstandard.ZstdError:
        return Dictionary(b"")


def serialize(ids: np.ndarray, width: int, end: int = END) -> bytes:
    return np.append(ids, end).astype(f"<u{width}").tobytes()


def header(width: int, doc_id: int | None, n: int, dictionary: Dictionary) -> bytes:
    return HEADER.pack(SKIPPABLE, HEADER.size - 8, 1, width, doc_id is not None, doc_id or 0, n, dictionary.sha256[:8])


def _frames(docs: DataFrame, path: str, dictionary: Dictionary, end: int) -> DataFrame:
    """``doc_id, row, frame``: each document's header and ids."""

    def run(batches):
        own, pack = encoder(path), dictionary.compressor()
        for batch in batches:
            for part, buf, offs in chunks(batch, "text", CHUNK):
                out = []
                for ids, doc_id in zip(own.encode(buf, offs), part.column("doc_id").to_pylist()):
                    out.append(header(own.width, doc_id, len(ids) + 1, dictionary) + pack.compress(serialize(ids, own.width, end)))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "row": part.column("row"), "frame": pa.array(out, pa.binary())})

    return docs.mapInArrow(lean(run), "doc_id long, row long, frame binary")


def write(docs: DataFrame, root: str, tokenizer: str, end: int = END, file_bytes: int = FILE_BYTES) -> None:
    """``doc_id, text`` as files of ids with their dictionary and index below ``root``; ``tokenizer`` is the path of its file, on every executor."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    rows = with_rows(docs, ["doc_id", "text"], scratch).withColumn("doc_id", F.col("doc_id").cast("long"))
    dictionary = train(docs, tokenizer, end)
    spark.createDataFrame([(dictionary.sha256.hex(), bytearray(dictionary.content))], "sha256 string, content binary").coalesce(1).write.mode("overwrite").parquet(f"{root}/dictionary")
    frames = scratch.keep(_frames(rows, tokenizer, dictionary, end), "frames")
    size = frames.agg(F.sum(F.octet_length("frame").cast("long"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = frames.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    # a task's rows become a file's records in their order
    placed.select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").option("lineSep", GAP).option("compression", "none").text(f"{root}/ids")
    scratch.drop("frames")
    index = read_files(spark, root).drop("ids", "ids_crc32")
    index.write.mode("overwrite").parquet(f"{root}/index")


def documents_in(content: memoryview, dictionary: Dictionary, pack: zstandard.ZstdDecompressor):
    """Offset, length, doc_id and ids of each document of a file (or of one document's bytes); checks the dictionary and the number of ids."""
    at = 0
    while at < len(content):
        magic, size = struct.unpack_from("<II", content, at)
        if magic != SKIPPABLE:
            raise ValueError("not a file of token ids")
        if not size:
            at += 8
            continue
        _, _, version, width, has_id, doc_id, n, short = HEADER.unpack_from(content, at)
        if version != 1 or short != dictionary.sha256[:8]:
            raise ValueError("written with another format or dictionary")
        body = at + HEADER.size
        most = min(len(content), body + n * width + (n * width >> 6) + 1024)  # a frame is no longer than that
        unpack = pack.decompressobj()
        ids = unpack.decompress(content[body:most])
        end = most - len(unpack.unused_data)
        if len(ids) != n * width:
            raise ValueError("a document has lost ids")
        yield at, end - at, doc_id if has_id else None, np.frombuffer(ids, f"<u{width}")
        at = end


def dictionary_of(spark: SparkSession, root: str) -> Dictionary:
    return Dictionary(bytes(spark.read.parquet(f"{root}/dictionary").first()["content"]))


def read_files(spark: SparkSession, root: str, keep_ids: bool = False) -> DataFrame:
    """``path, place, doc_id, offset, length, n_tokens, ids_crc32, ids`` of all documents, decompressed; ids only where asked for."""
    dictionary = dictionary_of(spark, root)

    def run(batches):
        pack = dictionary.decompressor()
        form = pa.schema([("path", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                for place, (offset, length, doc_id, ids) in enumerate(documents_in(memoryview(content.as_buffer()), dictionary, pack)):
                    rows.append((path, place, doc_id, offset, length, len(ids), crc32(ids.astype("<u4").tobytes()), ids.tolist() if keep_ids else None))
                    held += 200 + keep_ids * 40 * len(ids)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pydict(dict(zip(form.names, zip(*rows))), form)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(form.names, zip(*rows))), form)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{root}/ids").select("path", "content")
    return files.mapInArrow(lean(run), "path string, place long, doc_id long, offset long, length long, n_tokens long, ids_crc32 long, ids array<long>")


def digest(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: sums run within a file, and over one row for each file."""
    found = Scratch(spark, "tokens").keep(read_files(spark, root).drop("ids", "offset", "length"), "read")
    sums = found.groupBy("path").agg(F.sum("n_tokens").alias("_sum"))
    order = F.regexp_extract("path", "/part-([0-9]+)[^/]*$", 1).cast("long")
    files = sums.select("path", (F.sum("_sum").over(Window.orderBy(order)) - F.col("_sum")).alias("_before"))
    within = F.sum("n_tokens").over(Window.partitionBy("path").orderBy("place")) - F.col("n_tokens")
    return found.join(F.broadcast(files), "path").select("doc_id", (within + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, root: str, doc_ids: list[int], most: int = 10_000) -> dict[int, list[list[int]]]:
    """The ids of a few documents: only their bytes are read, by offset.  A list for each document with that id; more than ``most`` ids are refused."""
    if len(doc_ids) > most:
        raise ValueError("read the files for as many documents")
    dictionary = dictionary_of(spark, root)
    pack, out = dictionary.decompressor(), {}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in spark.read.parquet(f"{root}/index").filter(F.col("doc_id").isin(doc_ids)).orderBy("doc_id", "path", "place").select("doc_id", "path", "offset", "length").limit(most).collect():
        path = jvm.org.apache.hadoop.fs.Path(r["path"])
        stream = path.getFileSystem(conf).open(path)
        try:
            stream.seek(r["offset"])
            content = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, r["length"]))
        finally:
            stream.close()
        out.setdefault(r["doc_id"], []).extend(ids.tolist() for _, _, _, ids in documents_in(memoryview(content), dictionary, pack))
    return out
