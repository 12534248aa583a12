"""Token counts of whole texts by rank-synchronous merging of ragged arrays; no text is encoded one by one.

1. A text falls into chunks at ASCII white space, which no pre-token holds. Equal chunks of a batch are handled once.
2. Chunks of plain Latin characters are normalised and cut into pre-tokens by table look-ups over code points; the tables are asked
   of the tokenizer itself. Chunks with other characters go through its own normaliser and pre-tokenizer.
3. All pre-tokens of a batch lie in one array of symbol ids, a row of symbols each. In every round each pre-token finds its
   lowest-ranked pair of neighbours, and all occurrences of it merge at once, in all pre-tokens. Pre-tokens without a pair leave.
   A text's count is the number of symbols that survive.

Merging all occurrences at once equals merging them one after another where no merge has a lower rank than a merge that makes one of
its parts; the vocabulary is checked for it, and where it does not hold only the leftmost occurrence merges in a round.

Rows are judged alone, so there is no shuffle. Null counts as the empty text: 0 bytes and 0 tokens. Repeated rows give repeated
results, an empty table an empty one; columns other than doc_id and text are not read. Very long texts are cut into pieces at white
space, so memory is bounded by PIECE bytes or one chunk without white space, whichever is longer.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
PIECE = 8 << 20
#: Code points under this go by tables: Latin letters, none of which combines with the one before it.
TABLED = 0x300
NEVER = np.int32(2**31 - 1)
#: Classes of characters; a number is a pre-token of its own.
BLANK, LETTER, NUMBER, OTHER = range(4)
#: The form of normaliser and pre-tokenizer that the tables stand for.
FORM = {"normalizer": ["NFC", "Replace", "Lowercase"],
        "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


class PairTable:
    """Ranks and results of merges by pair of symbols: open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, NEVER)
        self.made = np.asarray(made, np.int32)
        for rank, (key, slot) in enumerate(zip(keys, self._slots(keys).tolist())):
            while self.ranks[slot] != NEVER:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER where it is no merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self._slots(keys)
        out = self.ranks[slots]
        open_ = np.flatnonzero((self.keys[slots] != keys) & (out != NEVER))
        out[np.flatnonzero(self.keys[slots] != keys)] = NEVER
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            at = slots[open_]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.ranks[at] != NEVER)]
        return out


class Merger:
    """Merges the symbols of many sequences at once."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.table = PairTable(left, right, made)
        lowest = np.full(max(vocab.values(), default=0) + 1, -1, np.int64)
        np.maximum.at(lowest, made, np.arange(len(made)))  # the latest rank that makes a symbol
        self.ordered = bool((np.maximum(lowest[left], lowest[right]) < np.arange(len(made))).all()) if len(made) else True

    def survivors(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols are left of each sequence; symbols holds them end to end, every length is 1 or more."""
        return self.merge(symbols, lengths)[1]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of all sequences end to end, and how many each has."""
        out = np.array(lengths, np.int64)
        live = np.flatnonzero(out > 1)
        result, left = symbols.copy(), np.ones(len(symbols), bool)
        home = np.flatnonzero(np.repeat(out > 1, out))  # place of each live symbol in the result
        symbols = symbols[home]
        sizes = out[live]
        ranks = self._ranks(symbols, sizes)
        while len(live):
            begins = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, begins)
            going = least != NEVER
            if not going.all():  # finished sequences leave with what they have
                out[live[~going]] = sizes[~going]
                keep = np.repeat(going, sizes)
                symbols, ranks, home = symbols[keep], ranks[keep], home[keep]
                live, sizes, least = live[going], sizes[going], least[going]
                if not len(live):
                    break
                begins = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            owner = np.searchsorted(begins, hits, "right") - 1
            if self.ordered:  # of overlapping pairs (a run of one symbol) every second merges, from the left
                fresh = np.ones(len(hits), bool)
                fresh[1:] = hits[1:] != hits[:-1] + 1
                place = np.arange(len(hits))
                chosen = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
            else:
                chosen = np.ones(len(hits), bool)
                chosen[1:] = owner[1:] != owner[:-1]
            hits, owner = hits[chosen], owner[chosen]
            symbols[hits] = result[home[hits]] = self.table.made[ranks[hits]]
            left[home[hits + 1]] = False
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            # A pair's rank stands at its left symbol: it changes at the merged symbol and at the one before it.
            ranks[hits] = -1
            before = hits - 1
            before = before[before >= 0]
            ranks[before] = -1
            symbols, ranks, home = symbols[stay], ranks[stay], home[stay]
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            ends = np.cumsum(sizes) - 1
            ranks[ends] = NEVER
            stale = np.flatnonzero(ranks == -1)
            ranks[stale] = self.table.rank(symbols[stale], symbols[stale + 1])
        return result[left], out

    def _ranks(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ranks = np.full(len(symbols), NEVER)
        if len(symbols):
            ranks[:-1] = self.table.rank(symbols[:-1], symbols[1:])
            ranks[np.cumsum(sizes) - 1] = NEVER
        return ranks


class TokenCounter:
    """Counts tokens of Arrow text columns as the tokenizer of a vocabulary file (JSON text) gives them."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        raw = json.loads(vocabulary)
        self._require(raw)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        model = raw["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merger = Merger(model["vocab"], model["merges"])
        letters = self._byte_letters()
        self.inner = np.array([model["vocab"][c] for c in letters], np.int32)
        self.final = np.array([model["vocab"][c + self.suffix] for c in letters], np.int32)
        self.special = sorted((t["content"] for t in raw["added_tokens"]), key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._tables()

    @staticmethod
    def _require(raw: dict) -> None:
        normalizers = [n["type"] for n in (raw.get("normalizer") or {}).get("normalizers", [])]
        steps = (raw.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = raw["model"]
        fit = (normalizers == FORM["normalizer"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
               and steps[0]["pattern"] == {"Regex": FORM["pattern"]} and steps[0]["invert"] and not steps[1]["use_regex"]
               and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
               and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in raw["added_tokens"]))
        if not fit:
            raise ValueError("a vocabulary of another form: token_counts handles lower-casing byte pair vocabularies with word ends")

    def _byte_letters(self) -> list[str]:
        """The character that stands for each byte, asked of the byte-level step itself."""
        from tokenizers.pre_tokenizers import ByteLevel

        step = ByteLevel(add_prefix_space=False, use_regex=False)
        own = {}
        for c in map(chr, range(TABLED)):
            own.update(zip(c.encode(), step.pre_tokenize_str(c)[0][0]))
        rest = [b for b in range(256) if b not in own]
        # Bytes of no code point in the table: lead bytes of longer sequences, and those UTF-8 never uses.
        for c in map(chr, (0x800, 0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000, 0xA000, 0xB000, 0xC000, 0xD000,
                           0xE000, 0xF000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000, *range(0x300, 0x800, 0x40))):
            own.update(zip(c.encode(), step.pre_tokenize_str(c)[0][0]))
        return [own.get(b, own[32]) for b in range(256)] if rest else [own[b] for b in range(256)]

    def _tables(self) -> None:
        self.lower = np.zeros(TABLED, np.uint32)
        self.classes = np.zeros(TABLED, np.uint8)
        self.slow = np.zeros(TABLED, bool)
        for code in range(TABLED):
            lowered = self.tokenizer.normalizer.normalize_str(chr(code))
            if len(lowered) != 1 or ord(lowered) >= TABLED:
                self.slow[code] = True
                continue
            self.lower[code] = ord(lowered)
        for code in range(TABLED):
            c = chr(code)
            cut = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)]
            if not cut:
                self.classes[code] = BLANK
            elif len(self.tokenizer.pre_tokenizer.pre_tokenize_str("x" + c)) == 1:
                self.classes[code] = LETTER
            elif len(self.tokenizer.pre_tokenizer.pre_tokenize_str("!" + c)) == 1:
                self.classes[code] = OTHER
            else:
                self.classes[code] = NUMBER

    def chunk_counts(self, chunks: pa.Array) -> np.ndarray:
        """Tokens of each chunk, none of which holds ASCII white space."""
        out = np.zeros(len(chunks), np.int64)
        texts, owners = chunks, np.arange(len(chunks))
        marked = np.zeros(len(chunks), bool)
        for mark in self.special:
            marked |= pc.match_substring(chunks, mark).to_numpy(zero_copy_only=False)
        if marked.any():  # special strings are tokens by themselves; what lies between them is ordinary text
            parts, of = [], []
            for i in np.flatnonzero(marked):
                text = chunks[int(i)].as_py()
                pieces = self.special_pattern.split(text)
                out[i] += len(pieces) - 1
                parts += pieces
                of += [i] * len(pieces)
            texts = pa.concat_arrays([chunks.filter(pa.array(~marked)), pa.array(parts, chunks.type)])
            owners = np.concatenate([owners[~marked], np.array(of, np.int64)])
        codes, lengths = code_points(texts)
        small = np.minimum(codes, TABLED - 1)
        odd = (codes >= TABLED) | self.slow[small]
        ends = np.cumsum(lengths)
        odd_rows = np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right"))
        if len(odd_rows):
            keep = np.ones(len(lengths), bool)
            keep[odd_rows] = False
            symbols, sizes, of = self._by_library([texts[int(i)].as_py() for i in odd_rows])
            np.add.at(out, owners[odd_rows[of]], self.merger.survivors(symbols, sizes))
            small = small[np.repeat(keep, lengths)]
            lengths, owners = lengths[keep], owners[keep]
        symbols, sizes, of = self._by_table(small, lengths)
        np.add.at(out, owners[of], self.merger.survivors(symbols, sizes))
        return out

    def _by_table(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols and sizes of pre-tokens, and the chunk of each."""
        codes = self.lower[codes]
        kind = self.classes[codes]
        first = np.zeros(len(codes) + 1, bool)
        first[(np.cumsum(lengths) - lengths)] = True  # a zero length repeats a place or lands behind the end
        first = first[:-1]
        starts = first | (kind == NUMBER)
        starts[1:] |= kind[1:] != kind[:-1]
        # Contractions: an apostrophe that opens a run of other characters, with its letters.
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
        chunk = np.repeat(np.arange(len(lengths)), lengths)
        shown = kind != BLANK
        codes, starts, chunk = codes[shown], starts[shown], chunk[shown]
        begins = np.flatnonzero(starts)
        wide = codes >= 128
        width = 1 + wide.astype(np.int64)
        place = np.cumsum(width) - width
        data = np.empty(int(width.sum()), np.uint8)
        data[place] = np.where(wide, 0xC0 | (codes >> 6), codes)
        data[place[wide] + 1] = 0x80 | (codes[wide] & 0x3F)
        if not len(begins):
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        sizes = np.diff(np.append(place[begins], len(data)))
        symbols = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        return symbols, sizes, chunk[begins]

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes, of = [], [], []
        step, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        vocab = self.tokenizer.token_to_id
        known: dict[str, int] = {}
        for i, text in enumerate(texts):
            for piece, _ in step.pre_tokenize_str(normal.normalize_str(text)):
                for c in (*piece[:-1], piece[-1] + self.suffix):
                    if c not in known:
                        known[c] = vocab(c)
                    ids.append(known[c])
                sizes.append(len(piece))
                of.append(i)
        return np.array(ids, np.int32), np.array(sizes, np.int64), np.array(of, np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text without nulls."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.values.dictionary_encode()
        per_chunk = self.chunk_counts(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        sums = np.concatenate(([0], np.cumsum(per_chunk)))
        bounds = lists.offsets.to_numpy()
        return sums[bounds[1:]] - sums[bounds[:-1]]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points end to end, and how many each text has."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    joined = memoryview(data)[offsets[0]:offsets[-1]].tobytes().decode() if data is not None else ""
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), lengths


_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Groups of about `limit` bytes as (row of each text, texts); longer texts come in pieces cut at white space."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for row in np.flatnonzero(sizes > limit).tolist() + [len(texts)]:
        while begin < row:
            end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:row]), limit, "right")))
            yield np.arange(begin, end), texts.slice(begin, end - begin)
            begin = end
        if row < len(texts):
            data, at = memoryview(texts[row].as_buffer()), 0
            while at < len(data):
                cut = _SPACES.search(data, min(len(data), at + limit))
                end = cut.start() if cut else len(data)
                yield np.array([row]), pa.array([bytes(data[at:end]).decode()], pa.large_string())
                at = end
            begin = row + 1


def worker_counter(vocabulary: str) -> TokenCounter:
    """The counter of this worker process; functions of this folder come by value, so the process keeps it under a name of its own."""
    held = sys.modules.setdefault("tidemark_llm_counter", ModuleType("tidemark_llm_counter"))
    if getattr(held, "vocabulary", None) != vocabulary:
        held.vocabulary, held.counter = vocabulary, TokenCounter(vocabulary)
    return held.counter


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or worker_counter(vocabulary.value)
            texts = batch.column(1).cast(pa.large_string())
            tokens = np.zeros(batch.num_rows, np.int64)
            for rows, part in pieces(texts):
                np.add.at(tokens, rows, counter.counts(part))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    The vocabulary file is read by the driver and broadcast; its size does not depend on the documents.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    counted = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _count(shipped), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
