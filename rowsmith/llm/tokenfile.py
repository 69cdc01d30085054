"""Operator 6, token ids in bit-plane files.

Texts are encoded, each document's ids end with `end`, and documents in ascending doc_id order fill segments.
A segment is one self-contained binary value: a header, an index of chunks, and the chunks. A chunk holds
CHUNK ids (the last fewer); its ids are cut into planes, one for each byte or each bit of the largest id, and
every plane is a zstandard frame of its own, so equal high bytes nearly vanish and a reader can fetch one chunk
by the index. Spark's Parquet writer stores the segments, so tasks may be retried and any Hadoop file system
serves; with each segment stand the doc_ids and lengths of its documents, which never straddle segments.

Rows are put in order by a range partitioning of the texts; a first position follows from sums in two levels
(over the partitions, then within each). Encoding is by white-space pieces where that is exact (see Encoder).

Defined cases: a null or empty text has only the end id; null doc_ids come first; repeated rows each get
a row, in order of a hash of the text; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import freed, gathered, slices, write_table

CHUNK = 1 << 16  # ids
SEGMENT = 1 << 19  # ids after which a segment ends, at a document's end
CACHE = 400_000  # stems
GATHER, SLICE = 4_500_000, 6_000_000  # bytes of text at once: about as much, and at most
MAGIC = b"BITPLANE"
HEAD = struct.Struct("<8sIIIHBB")  # magic, ids, ids to a chunk, chunks, planes, 1 for bits, bytes of an id
END = 2


def planes_of(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The byte planes, or bit planes, of ids that have `width` bytes."""
    by_byte = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(len(ids), 4)[:, :width]
    if not bits:
        return [np.ascontiguousarray(by_byte[:, i]).tobytes() for i in range(width)]
    by_bit = np.unpackbits(np.ascontiguousarray(by_byte), axis=1, bitorder="little")
    return [np.packbits(by_bit[:, i], bitorder="little").tobytes() for i in range(8 * width)]


def ids_of(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    """The reverse of planes_of."""
    out = np.zeros((n, 4), np.uint8)
    if not bits:
        for i, p in enumerate(planes):
            out[:, i] = np.frombuffer(p, np.uint8)
    elif n:
        columns = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes]
        out[:, :width] = np.packbits(np.stack(columns, axis=1), axis=1, bitorder="little")
    return out.view("<u4").ravel()


def write_segment(ids: np.ndarray, chunk: int = CHUNK, bits: bool = False, level: int = 1) -> bytes:
    top = int(ids.max()) if len(ids) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
    frames = [packer.compress(p) for at in range(0, len(ids), chunk) for p in planes_of(ids[at : at + chunk], width, bits)]
    n_planes = 8 * width if bits else width
    head = HEAD.pack(MAGIC, len(ids), chunk, -(-len(ids) // chunk), n_planes, bits, width)
    ends = np.cumsum([len(f) for f in frames], dtype="<u8")
    return b"".join([head, ends.tobytes(), *frames])


def read_segment(data: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a segment, or of one chunk of it."""
    magic, n, chunk, n_chunks, n_planes, bits, width = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment")
    ends = np.frombuffer(data, "<u8", n_chunks * n_planes, HEAD.size).astype(int)
    base = HEAD.size + 8 * len(ends)
    unpacker = zstandard.ZstdDecompressor()
    out = [np.zeros(0, "<u4")]
    for c in range(n_chunks) if only is None else [only]:
        frames = []
        for k in range(c * n_planes, (c + 1) * n_planes):
            frames.append(unpacker.decompress(data[base + (ends[k - 1] if k else 0) : base + ends[k]]))
        out.append(ids_of(frames, min(chunk, n - c * chunk), width, bool(bits)))
    return np.concatenate(out)


#: Marks that may stand behind a word: they are neither letters nor digits and combine with nothing, so the
#: pre-tokeniser cuts before them, and a run of them is a word of its own.
TAIL = ",.!?;:*$%&#|"
#: What a normaliser and pre-tokeniser must be for pieces between spaces to be encoded on their own: neither
#: works across white space, and a word's last id ends with the suffix.
PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SUFFIX = "</w>"
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
WORDS_AT_ONCE = 200


def by_pieces(library) -> bool:
    """Whether the tokenizer is of the kind that `Encoder` may use by pieces."""
    spec = json.loads(library.to_str())
    normal, parts = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    kinds = [x["type"] for x in normal.get("normalizers", [])], [x["type"] for x in parts.get("pretokenizers", [])]
    return (
        kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
        and normal["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        and parts["pretokenizers"][0]["pattern"] == {"Regex": PARTS}
        and not parts["pretokenizers"][1]["add_prefix_space"]
        and spec["model"].get("end_of_word_suffix") == SUFFIX
        and all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] for x in spec["added_tokens"])
    )


class Encoder:
    """Ids of texts. With a tokenizer of the kind that `by_pieces` knows, a text's pieces between white space are
    cut into a stem and the marks behind it; each distinct one is encoded by the library once and kept in a table
    of CACHE of them, which starts anew when full. Any other tokenizer gets whole texts."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        self.apart = by_pieces(self.library)
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for x, i in vocabulary.items() if x.endswith(SUFFIX)]] = True
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([""], pa.large_string())  # stems by number
        self.start, self.size, self.flat, self.used = np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int64), np.zeros(1 << 18, np.uint32), 0

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids in a row."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return size, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters only, many to a call: each ends with its only id that ends a word."""
        groups = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        size, flat = self.raw([" ".join(g) for g in groups])
        if len(groups) and (np.add.reduceat(self.last[flat].astype(np.int64), np.cumsum(size) - size) != list(map(len, groups))).any():
            return self.raw(words)
        return np.diff(np.flatnonzero(self.last[flat]) + 1, prepend=0), flat

    def numbers(self, stems: pa.Array) -> np.ndarray:
        """Places of distinct stems in the table."""
        place = pc.index_in(stems, value_set=self.known)
        if place.null_count and len(self.known) + place.null_count > CACHE:
            self.clear()
            place = pc.index_in(stems, value_set=self.known)
        if place.null_count:
            new = stems.filter(place.is_null())
            plain = pc.match_substring_regex(new, f"^[{LETTERS}]+$")
            sure, rest = new.filter(plain), new.filter(pc.invert(plain))
            size, flat = map(np.concatenate, zip(self.words(sure.to_pylist()), self.raw(rest.to_pylist()), strict=True))
            k, n = len(self.known), len(self.known) + len(new)
            while n > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.start[k:n], self.size[k:n] = self.used + np.cumsum(size) - size, size
            self.flat[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.known = pa.concat_arrays([self.known, sure, rest])
            place = pc.index_in(stems, value_set=self.known)
        return place.to_numpy().astype(np.int64)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of them, with the end id."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.apart:
            size, flat = self.raw(texts.to_pylist())
            return np.insert(flat, np.cumsum(size), end), size + 1
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary
        stem, tail = stems(pieces)
        both = pa.concat_arrays([stem, tail]).dictionary_encode()
        number = self.numbers(both.dictionary)[both.indices.to_numpy()]
        # the ids of each distinct piece, its stem's and its tail's, and last the end id
        part = np.stack([number[: len(pieces)], number[len(pieces) :]], axis=1).ravel()
        of_piece = np.append(self.size[part].reshape(-1, 2).sum(axis=1), 1)
        flat = np.append(_runs(self.flat, self.start[part], self.size[part]), np.uint32(end))
        # pieces in the order of the texts, with an end behind each text
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        order = np.insert(coded.indices.to_numpy(), offsets[1:], len(pieces))
        size = of_piece[order]
        per_text = np.add.reduceat(size, offsets[:-1] + np.arange(len(texts)))
        return _runs(flat, (np.cumsum(of_piece) - of_piece)[order], size), per_text


def _runs(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The given runs of an array, one after the other."""
    upto = np.cumsum(size)
    return flat[np.repeat(start - upto + size, size) + np.arange(int(upto[-1]) if len(size) else 0)]


def stems(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each piece as a word and the marks behind it; an ASCII word in lower case, as the normaliser has it. What
    might hold a special token, or a word that ends with anything but a plain letter, stays whole."""
    word = pc.utf8_rtrim(pieces, characters=TAIL)
    apart = pc.or_(pc.match_substring_regex(word, f"[{LETTERS}]$"), pc.equal(word, ""))
    special = pc.match_substring(pieces, "<|")
    word = pc.if_else(pc.and_(apart, pc.invert(special)), word, pieces)
    ends = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)[1:]
    size = (pc.binary_length(pieces).to_numpy() - pc.binary_length(word).to_numpy()).astype(np.int64)
    tails = _runs(np.frombuffer(pieces.buffers()[2] or b"", np.uint8), ends - size, size)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    tail = pa.Array.from_buffers(pa.large_string(), len(pieces), [None, pa.py_buffer(offsets), pa.py_buffer(tails)])
    return pc.if_else(pc.and_(pc.string_is_ascii(word), pc.invert(special)), pc.ascii_lower(word), word), tail


@cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = END, bits: bool = False) -> DataFrame:
    """The segments, written: shard, segment, n_tokens, doc_ids, sizes, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, library = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        held: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []
        total = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "segment": number, "n_tokens": total, "doc_ids": names, "sizes": sizes, "payload": write_segment(np.concatenate(held), bits=bits)}], schema=kind
            )

        for batch in gathered(batches, GATHER):
            kind = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())])
            for part in slices(batch, limit=SLICE):
                ids, per_text = library.encode(part.column("text"), end)
                held.append(ids)
                names += part.column("doc_id").to_pylist()
                sizes += per_text.tolist()
                total += len(ids)
                if total >= SEGMENT:
                    yield flush()
                    held, names, sizes, total, number = [], [], [], 0, number + 1
        if names:
            yield flush()

    kind = dict(docs.dtypes)["doc_id"]
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return write_table(ordered.mapInArrow(freed(run), f"shard int, segment int, n_tokens bigint, doc_ids array<{kind}>, sizes array<bigint>, payload binary"), "tokens")


def read_back(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = read_segment(row.column("payload")[0].as_py()).astype("<u4").tobytes()
                size = np.array(row.column("sizes")[0].as_py(), np.int64)
                at = np.cumsum(size) - size
                crc = [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(at.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.column(c)[0].as_py()] * len(size), pa.int32()) for c in ("shard", "segment")] + [row.column("doc_ids")[0].values, pa.array(at), pa.array(size), pa.array(crc, pa.int64())],
                    names=["shard", "segment", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    docs = segments.select("shard", "segment", "doc_ids", "sizes", "payload").mapInArrow(freed(run), f"shard int, segment int, doc_id {kind}, local bigint, n_tokens bigint, ids_crc32 bigint")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = segments.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("n"))
    shards = per.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", earlier(Window.orderBy("shard")).alias("shard_start"))
    inside = per.select("shard", "segment", earlier(Window.partitionBy("shard").orderBy("segment")).alias("segment_start"))
    starts = inside.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("base"))
    return docs.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
