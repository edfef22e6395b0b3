"""Packing documents into token sequences along a space-filling curve.

A document's vector is the sum of pseudo-random directions of its token ids (a hashed random projection of its token
counts to DIMENSIONS numbers), normalised; its cell on the Hilbert curve is the sort key. Documents are range-sorted by
that key, and each range is packed by filling sequences of `length` tokens with neighbouring documents, cutting where a
sequence is full. What is left at a range's end is cut into sequences of lengths that are powers of two, so nothing is padded.

Defined results: a null or empty text is the end id alone; documents of any length are cut over many sequences;
repeated rows are packed each on their own; equal keys are ordered by doc_id (null first) and text hash, so one hot cell
is spread over several ranges; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.llm.common import materialize, mixed, prepare, trimmed

LENGTH = 2048
END_ID = 1
DIMENSIONS = 4
BITS = 10
#: Distinct chunks of text whose ids a worker remembers; beyond it, and after each task, only those learned first are
#: kept, which are the frequent ones.
REMEMBERED, FIRST = 500_000, 150_000
#: New words that one call encodes; the library holds some hundred bytes a token meanwhile.
CALL_WORDS = 5_000
#: Bytes of text that one vectorised step encodes.
STEP_BYTES = 6_000_000
#: Tokens that one range should hold, about.
RANGE_TOKENS = 4_000_000

_tokenizers: dict = {}


class ChunkTokenizer:
    """Ids of the tokenizer for whole texts, put together from remembered ids of their white-space-free chunks.

    Valid for tokenizers that never join across white space and drop it (word_bpe_49k); others are refused, as far as probes
    show. Texts are parted at ASCII white space; a chunk with any other goes through the tokenizer as it is.
    """

    PROBES = ("a b", " Two  words.\nA line, and\tmore ", "x.y z , w", "ÉÀ ñ — 日本 e\u0301\u2003q")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        # For lower-case words in one call: the same model behind nothing but the parting of words and the mapping of bytes.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

        for text in self.PROBES:
            whole = self.tokenizer.encode(text, add_special_tokens=False).ids
            if self.encode(pa.array([text]), END_ID)[0][:-1].tolist() != whole:
                raise ValueError(f"{path} joins words or keeps white space, so texts can't be encoded word by word")

    def forget(self) -> None:
        self.known = dict(islice(self.known.items(), FIRST))

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one run of letters each, from one call: a word ends where a token does that ends words."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):  # no tokenizer of the kind this is made for
            return [self._bytes(e.ids) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        raw, size = ids.tobytes(), self.kind.itemsize
        cuts = [0, *(ends * size).tolist()]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if c.isalpha() and _plain_letters(c)]
        for i in range(0, len(plain), CALL_WORDS):
            part = plain[i : i + CALL_WORDS]
            self.known.update(zip(part, self._plain([c.lower() for c in part])))
        other = [c for c in chunks if c not in self.known]
        for i in range(0, len(other), CALL_WORDS):
            part = other[i : i + CALL_WORDS]
            self.known.update((c, self._bytes(e.ids)) for c, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids laid end to end, each text's followed by the end id, and the number of each text's.

        To have fewer chunks, A-Z are lowered first and a mark between a letter and white space is set apart, both of
        which the tokenizer does itself; texts that might hold its special tokens are left as they are.
        """
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\pL)([.,])([\t-\r ]|$)", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words, codes = _listed(coded.dictionary), coded.indices.to_numpy()
        found = list(map(self.known.get, words))
        fresh = [w for w, ids in zip(words, found) if ids is None]
        if fresh:
            if len(self.known) > REMEMBERED:
                self.forget()
                fresh = [w for w in words if w not in self.known]
            self._learn(fresh)
            found = list(map(self.known.__getitem__, words))
        pool = np.frombuffer(b"".join(found), self.kind)
        size = np.fromiter(map(len, found), np.int32, len(found)) // self.kind.itemsize
        start = np.cumsum(size, dtype=np.int32) - size
        n = size[codes]
        done = np.concatenate((np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)))
        flat = pool[np.repeat(start[codes] - done[:-1].astype(np.int32), n) + np.arange(done[-1], dtype=np.int32)]
        cuts = done[lists.offsets.to_numpy().astype(np.int64)]
        return np.insert(flat, cuts[1:], end), np.diff(cuts) + 1


def _listed(words: pa.Array) -> list[str]:
    """to_pylist() for strings without line ends, by way of one long one, which takes a tenth of the time."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")
    return whole[0].as_py().split("\n") if len(words) else []


def _plain_letters(x: str) -> bool:
    """Letters up to U+00FF that neither composition nor lower-casing changes in any unusual way."""
    return x.isascii() or max(x) <= "ÿ" and "ª" not in x and "º" not in x


def tokenizer_at(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def directions(size: int) -> np.ndarray:
    """A fixed pseudo-random direction for each token id."""
    x = mixed(np.arange(1, size * DIMENSIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - np.float32(1)).reshape(size, DIMENSIONS)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of integer coordinates (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenize(path: str):
    def run(batches):
        tokenizer = tokenizer_at(path)
        toward = directions(1 << 16 if not tokenizer.wide else tokenizer.tokenizer.get_vocab_size(with_added_tokens=True) + 2)
        for batch in batches:
            # Steps of about STEP_BYTES; a longer text stands alone.
            size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // STEP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                ids, counts = tokenizer.encode(part.column("text"), END_ID)
                ends = np.cumsum(counts)
                sums = np.add.reduceat(toward[ids], ends - counts, axis=0, dtype=np.float64)
                unit = sums / np.maximum(1e-12, np.linalg.norm(sums, axis=1, keepdims=True))
                cells = np.clip(((unit + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1)
                raw, width = ids.tobytes(), tokenizer.kind.itemsize
                each = [raw[a * width : b * width] for a, b in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(hilbert(cells)), pa.array(counts), pa.array(each, pa.binary())], names=["doc_id", "tie", "key", "n", "ids"])
        tokenizer.forget()

    return run


def _pack(length: int, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches):
        # Sequences of a range are numbered from its own block of numbers.
        base = TaskContext.get().partitionId() << 40
        sequence, room, held = 0, length, []

        def flush(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            done = []
            for doc, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist()):
                raw = memoryview(np.frombuffer(ids, kind).astype("<u4").tobytes())
                at = 0
                while at < n:
                    take = min(room, n - at)
                    held.append((doc, at, take, raw[4 * at : 4 * (at + take)], n))
                    at, room = at + take, room - take
                    if not room:
                        place = 0
                        for d, s, k, part, total in held:
                            done.append((d, s, k, zlib.crc32(part), total, base + sequence, place))
                            place += k
                        sequence, room, held = sequence + 1, length, []
            if done:
                yield flush(done)
        left, done = length - room, []
        while left:
            room = fill = 1 << (left.bit_length() - 1)
            while fill:
                d, s, k, part, total = held.pop(0)
                take = min(k, fill)
                done.append((d, s, take, zlib.crc32(part[: 4 * take]), total, base + sequence, room - fill))
                if take < k:
                    held.insert(0, (d, s + take, k - take, part[4 * take :], total))
                fill -= take
            sequence, left = sequence + 1, left - room
        if done:
            yield flush(done)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. doc_id is a number; one that isn't is an error."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("pack() numbers pieces by a whole doc_id")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    prepare(docs.sparkSession)
    wide = tokenizer_at(tokenizer).wide  # here too, so that an unfit one is refused before any work
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    tokens = materialize(rows.mapInArrow(trimmed(_tokenize(tokenizer)), "doc_id long, tie long, key long, n long, ids binary"), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_TOKENS))
    spread = tokens.repartitionByRange(ranges, "key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie")
    return spread.select("doc_id", "n", "ids").mapInArrow(trimmed(_pack(length, wide)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
