"""Token ids in a binary format: range asymmetric numeral coding with one shared frequency table.

1. Every task encodes whole texts by their distinct words, merged as arrays, and keeps the ids packed, one row per document
   (16 bits an id, 32 for large vocabularies).
2. Ids are counted over all documents; the counts, scaled to 2**SCALE with at least 1 for each id that occurs, are the shared
   static table. It has one entry per vocabulary id, so it is small whatever the input, and travels as a broadcast.
3. Documents are put in ascending id order by range partitions. Each partition is cut into blocks of whole documents. A block is
   coded alone: its tokens are dealt to interleaved lanes, and every CHECKPOINT steps the lanes' states and the position in the
   word stream are noted, so a block can be decoded from several places at once. Checksums cover the block and its ids.
4. Files hold blocks as Parquet binary values, so any store that Spark writes to will do and lost tasks are redone.
"""

from __future__ import annotations

import json
import struct
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, keep
from tidemark.llm.token_counts import BLANK, LETTER, NUMBER, OTHER, TABLED, Merger, code_points

END_ID = 0
SCALE = 18
BLOCK_TOKENS = 1 << 19
LANES = 2048
CHECKPOINT = 128
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_HEAD = "<4sIIQQII"
_MAGIC = b"TRA1"
#: A space between white space, or between white space and the end: it may belong to the token before it, so such texts go whole.
_BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_ODD = f"{_BLANK} (?:{_BLANK}|$)"
#: Texts are encoded in groups of about this many bytes, words in groups of this many.
GROUP_BYTES = 8 << 20
GROUP_WORDS = 100_000


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one of those from code point 256 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Encodes texts by their distinct words, all at once; ids equal those of encoding each text whole.

    Between two characters that are not white space, a single space always begins a new piece of the byte-level tokenizer, so a
    text is the sequence of its pieces " word". Texts where that does not hold go to the tokenizer whole. Words of Latin characters
    are cut into pieces by table look-ups and merged as arrays; words with other characters go to the tokenizer, many at a time.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        raw = json.loads(vocabulary)
        step, model = raw.get("pre_tokenizer") or {}, raw["model"]
        if (raw.get("normalizer") or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True)
                or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges")
                or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
            raise ValueError("a vocabulary of another form: token_output handles byte-level byte pair vocabularies")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.spaced = np.zeros(self.size + 1, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.spaced[number] = token.startswith("\u0120")
        self.merger = Merger(model["vocab"], model["merges"])
        self.symbols = np.array([model["vocab"][c] for c in byte_letters()], np.int32)
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.classes = np.full(TABLED, BLANK, np.uint8)
        for code in range(TABLED):
            for sample, kind in (("x", LETTER), ("1", NUMBER), ("!", OTHER)):
                if len(cut(sample + chr(code))) == 1:
                    self.classes[code] = kind

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ids(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has; the words follow a space or (first words of texts) do not."""
        parts, sizes = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for at in range(0, len(words), GROUP_WORDS):
            ids, counts = self._group(words.slice(at, GROUP_WORDS), spaced)
            parts.append(ids.astype(self.kind))
            sizes.append(counts)
        return np.concatenate(parts), np.concatenate(sizes)

    def _group(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        if spaced:
            words = pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type))
        codes, lengths = code_points(words)
        odd_rows = np.unique(np.searchsorted(np.cumsum(lengths), np.flatnonzero(codes >= TABLED), "right"))
        plain = np.ones(len(words), bool)
        plain[odd_rows] = False
        symbols, sizes, of = self._pieces(codes[np.repeat(plain, lengths)], lengths[plain])
        ids, left = self.merger.merge(symbols, sizes)
        counts = np.zeros(len(words), np.int64)
        counts[plain] = np.bincount(of, left, minlength=int(plain.sum())).astype(np.int64)
        if not len(odd_rows):
            return ids, counts
        found = self._by_library([words[int(i)].as_py() for i in odd_rows])
        counts[odd_rows] = [len(x) for x in found]
        out = np.empty(int(counts.sum()), np.int64)
        mine = np.repeat(plain, counts)
        out[mine] = ids
        out[~mine] = np.concatenate(found)
        return out, counts

    def _pieces(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First symbols and sizes of the tokenizer's pieces, and the word of each."""
        if not len(codes):
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        kind = self.classes[codes]
        first = np.zeros(len(codes) + 1, bool)
        first[np.cumsum(lengths) - lengths] = True  # a zero length repeats a place or lands behind the end
        first = first[:-1]
        starts = first.copy()
        starts[1:] |= kind[1:] != kind[:-1]
        # White space leaves its last character to what follows it in the word; of these a space opens the next piece.
        last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~first[1:])
        starts[last] = True
        opens = last[codes[last] == ord(" ")] + 1
        starts[opens] = False
        # Contractions: an apostrophe that opens a piece, with its letters.
        for ending in ("s", "t", "m", "d", "re", "ve", "ll"):
            n = len(ending)
            if len(codes) <= n:
                continue
            at = (codes[:-n] == ord("'")) & starts[:-n]
            for i, c in enumerate(ending, 1):
                at &= (codes[i:len(codes) - n + i] == ord(c)) & ~first[i:len(codes) - n + i]
            at = np.flatnonzero(at)
            starts[at + 1] = False
            after = at + n + 1
            starts[after[after < len(codes)]] = True
        wide = codes >= 128
        width = 1 + wide.astype(np.int64)
        place = np.cumsum(width) - width
        data = np.empty(int(width.sum()), np.uint8)
        data[place] = np.where(wide, 0xC0 | (codes >> 6), codes)
        data[place[wide] + 1] = 0x80 | (codes[wide] & 0x3F)
        begins = np.flatnonzero(starts)
        word = np.repeat(np.arange(len(lengths)), lengths)[begins]
        return self.symbols[data], np.diff(np.append(place[begins], len(data))), word

    def _by_library(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, with its space; those that begin with one and have no other white space at an edge go many at a time."""
        out: list = [None] * len(words)
        joint = [i for i, w in enumerate(words) if w[:1] == " " and len(w) > 1 and not w[1].isspace() and not w[-1].isspace()]
        for at in range(0, len(joint), 300):
            part = joint[at:at + 300]
            found = np.array(self._whole("".join(words[i] for i in part)), np.int64)
            begins = np.flatnonzero(self.spaced[found])
            if len(begins) == len(part) and begins[0] == 0:
                for i, ids in zip(part, np.split(found, begins[1:])):
                    out[i] = ids
        return [np.array(self._whole(w), np.int64) if x is None else x for w, x in zip(words, out)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(index), bool)
        first[bounds[:-1]] = True
        used = np.zeros(len(coded.dictionary), bool)
        used[index[~first]] = True
        place = np.cumsum(used) - 1
        pool, sizes = self._ids(coded.dictionary.filter(pa.array(used)), True)
        head_pool, head_sizes = self._ids(lists.values.take(pa.array(bounds[:-1])), False)
        codes = place[index]
        codes[first] = len(sizes) + np.arange(len(texts))
        pool, sizes = np.concatenate([pool, head_pool]), np.concatenate([sizes, head_sizes])
        begins = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        ends = np.cumsum(counts)
        ids = pool[np.repeat(begins[codes] - (ends - counts), counts) + np.arange(counts.sum())]
        edge = np.concatenate(([0], ends))[bounds]
        out = [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]
        for i in odd:
            out[i] = np.array(self._whole(texts[int(i)].as_py()), self.kind)
        return out


def worker_encoder(vocabulary: str) -> WordEncoder:
    """The encoder of this worker process: its tables are made once, no text or word is kept.

    Functions of this folder come to a worker by value and so have no module there; the process keeps one for the encoder.
    """
    held = sys.modules.setdefault("tidemark_llm_worker", ModuleType("tidemark_llm_worker"))
    if getattr(held, "vocabulary", None) != vocabulary:
        held.vocabulary, held.encoder = vocabulary, WordEncoder(vocabulary)
    return held.encoder


def _encode(vocabulary, kind: str):
    """Rows (doc_id, text) to (row_key, doc_id, n_tokens, packed ids with the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary.value)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            groups = (np.cumsum(sizes) - sizes) // GROUP_BYTES
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
            for at, end in zip(edges[:-1], edges[1:]):
                part = batch.slice(at, end - at)
                packed = [np.append(ids, ids.dtype.type(END_ID)).astype(kind, copy=False) for ids in encoder.encode(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + len(packed))), part.column(0), pa.array([len(x) for x in packed], pa.int64()),
                     pa.array([x.tobytes() for x in packed], pa.binary())], names=["row_key", "doc_id", "n_tokens", "ids"])
                key += len(packed)

    return run


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                new = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(new) > len(counts):
                    counts = np.pad(counts, (0, len(new) - len(counts)))
                counts[:len(new)] += new
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["token", "count"])

    return run


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for every id with a count. The rounding rest goes to the commonest ids."""
    total = 1 << scale
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(seen):
        return out
    if len(seen) > total:
        raise ValueError("more distinct ids than the scale can hold")
    out[seen] = np.maximum(1, np.floor(counts[seen] * (total / counts.sum())).astype(np.int64))
    order = seen[np.argsort(-counts[seen], kind="stable")]
    rest = total - int(out.sum())
    if rest > 0:
        out[order[0]] += rest
    at = 0
    while rest < 0:
        give = min(int(out[order[at]]) - 1, -rest)
        out[order[at]] -= give
        rest += give
        at += 1
    return out


class Coder:
    """Codes and decodes blocks with one frequency table."""

    def __init__(self, frequencies: np.ndarray, scale: int = SCALE) -> None:
        self.scale = np.uint64(scale)
        self.mask = np.uint64((1 << scale) - 1)
        self.freq = frequencies.astype(np.uint64)
        self.start = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.limit = ((LOW >> self.scale) << _32) * self.freq
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def pack(self, doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words, sizes, points = [], np.zeros(steps, np.int64), []
        freq, start, limit = self.freq[ids], self.start[ids], self.limit[ids]
        for step in range(steps - 1, -1, -1):
            a = step * lanes
            width = min(lanes, n - a)
            x, f = state[:width], freq[a:a + width]
            full = x >= limit[a:a + width]
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                sizes[step] = len(words[-1])
                x = np.where(full, x >> _32, x)
            q = x // f
            state[:width] = (q << self.scale) + (x - q * f) + start[a:a + width]
            if step and step % CHECKPOINT == 0:
                points.append((step, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        before = np.concatenate(([0], np.cumsum(sizes)))
        body = [np.array([d is not None for d in doc_ids], np.uint8), np.array([d or 0 for d in doc_ids], "<i8"),
                np.array(lengths, "<i8"), state.astype("<u8")]
        for step, states in reversed(points):
            body += [np.array([step, before[step]], "<i8"), states.astype("<u8")]
        data = b"".join(x.tobytes() for x in body) + stream.astype("<u4").tobytes()
        head = struct.pack(_HEAD, _MAGIC, lanes, len(doc_ids), n, len(stream), len(points), zlib.crc32(ids.astype("<u4").tobytes()))
        return head + data + struct.pack("<I", zlib.crc32(head + data))

    def unpack(self, block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
        """doc ids, lengths and ids of a block; raises on damage."""
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("block does not match its checksum")
        magic, lanes, docs, n, n_words, n_points, check = struct.unpack_from(_HEAD, block)
        if magic != _MAGIC:
            raise ValueError("not a token block")
        at = struct.calcsize(_HEAD)

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(block, kind, count, at)
            at += out.nbytes
            return out

        there, doc_ids, lengths = take("u1", docs), take("<i8", docs), take("<i8", docs)
        begins = [(0, 0, take("<u8", lanes))]
        for _ in range(n_points):
            step, offset = take("<i8", 2)
            begins.append((int(step), int(offset), take("<u8", lanes)))
        stream = take("<u4", n_words)
        steps = -(-n // lanes)
        ids = np.empty(n, np.uint32)
        ends = [b[0] for b in begins[1:]] + [steps]
        for (first, offset, states), last in zip(begins, ends):  # each part could be decoded by another reader
            self._decode(ids, stream, states.astype(np.uint64), first, last, offset, lanes, n)
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError("ids do not match their checksum")
        return [d if t else None for d, t in zip(doc_ids.tolist(), there)], lengths, ids

    def _decode(self, ids, stream, state, first, last, offset, lanes, n) -> None:
        for step in range(first, last):
            a = step * lanes
            width = min(lanes, n - a)
            x = state[:width]
            slot = x & self.mask
            token = self.symbol[slot]
            ids[a:a + width] = token
            x = self.freq[token] * (x >> self.scale) + slot - self.start[token]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << _32) | stream[offset:offset + len(low)]
                offset += len(low)
            state[:width] = x


_BLOCKS = "part int, part_start long, n_docs long, n_tokens long, block binary"


def _pack(frequencies, kind: str, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = Coder(frequencies.value), TaskContext.get().partitionId(), 0
        docs, parts, held = [], [], 0

        def block():
            ids = np.concatenate(parts).astype(np.uint32)
            data = coder.pack(docs, [len(x) for x in parts], ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before]), pa.array([len(docs)]), pa.array([len(ids)]), pa.array([data])],
                names=["part", "part_start", "n_docs", "n_tokens", "block"])

        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                parts.append(np.frombuffer(packed, kind))
                held += len(parts[-1])
                if held >= block_tokens:
                    yield block()
                    before, docs, parts, held = before + held, [], [], 0
        if docs:
            yield block()

    return run


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _unpack(frequencies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies.value)
        for batch in batches:
            for begin, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, lengths, ids = coder.unpack(block.as_py())
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends - lengths, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begin + ends - lengths), pa.array(lengths),
                                                  pa.array(crc, pa.int64())], names=[f.split()[0] for f in _READ.split(", ")])

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode doc_id and text of docs and write the files: path/blocks and the shared table, path/table.

    Every row becomes a document, in ascending doc_id order (null ids first, equal ids in a fixed order of their own). A null text
    counts as empty and has the end id alone. Other columns are not read. An empty input leaves no blocks. The vocabulary file
    is read on the driver and sent to the tasks.
    """
    spark = docs.sparkSession
    with open(vocabulary_path or default_vocabulary(), encoding="utf-8") as file:
        vocabulary = file.read()
    from tokenizers import Tokenizer

    size = Tokenizer.from_str(vocabulary).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"
    tokens = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _encode(spark.sparkContext.broadcast(vocabulary), kind), "row_key long, doc_id long, n_tokens long, ids binary"),
        "tokens", "zstd")
    counts = tokens.select("ids").mapInArrow(_count(kind), "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    dense = np.zeros(size, np.int64)
    for token, count in counts.collect():  # at most one row per id of the vocabulary
        dense[token] = count
    freq = scaled(dense)
    rows = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(rows, "token long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    (tokens.select("doc_id", "row_key", "ids").repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")
     .select("doc_id", "ids").mapInArrow(_pack(spark.sparkContext.broadcast(freq), kind, block_tokens), _BLOCKS)
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 of every document in the files."""
    pairs = spark.read.parquet(f"{path}/table").collect()  # bounded by the vocabulary
    freq = np.zeros(max((t for t, _ in pairs), default=0) + 1, np.int64)
    for token, frequency in pairs:
        freq[token] = frequency
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition that wrote blocks
    starts = keep(blocks.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).select(
        "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")), "token-starts")
    placed = blocks.join(starts, "part").select((F.col("before") + F.col("part_start")).alias("start"), "block")
    return placed.mapInArrow(_unpack(spark.sparkContext.broadcast(freq)), _READ)


def token_output(docs: DataFrame, vocabulary_path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write docs to token files in the shared folder and read them back, see write_tokens and read_tokens."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, vocabulary_path, block_tokens)
    return read_tokens(docs.sparkSession, path)
