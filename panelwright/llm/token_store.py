"""Token ids of all documents in a compressed binary file format.

Ids are written as a canonical Huffman code, limited in length, in blocks that can be decoded alone. A block holds whole
documents, their sizes, and the bit lengths of its lanes: runs of ``LANE`` ids whose beginnings are known without decoding
what comes before, so that a block is decoded in all lanes at once from one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.text import row_chunks
from panelwright.sources.writers import settle

MAX_BITS = 18
LANE = 64
BLOCK_IDS = 1 << 16

#: Encoded word forms that a task, and bytes of stems and their ids that a worker, remember at a time; beyond, they start anew.
CACHED_FORMS, CACHED_BYTES = 300_000, 24 << 20


# Huffman code ---------------------------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of every symbol in the best prefix code of at most ``limit`` bits; 0 for symbols that do not occur.

    Package-merge: in ``limit`` rounds, leaves are merged with the pairs of the round before; how many leaves are among the
    chosen items of each round says how many bits the rarest symbols get.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves, pairs, leaf_flags = counts[used].astype(np.int64), np.zeros(0, dtype=np.int64), []
    for _ in range(limit):
        items = np.concatenate([leaves, pairs])
        order = np.argsort(items, kind="stable")
        leaf_flags.append(order < n)
        items = items[order]
        pairs = items[0:len(items) - 1:2] + items[1::2]
    take, bits = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for flags in reversed(leaf_flags):
        chosen = int(flags[:take].sum())
        bits[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[used] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of length, then symbol; the lengths alone define them."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code = previous = 0
    for s in order.tolist():
        code <<= int(lengths[s]) - previous
        codes[s], previous = code, int(lengths[s])
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every value of the next ``MAX_BITS`` bits."""
    codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
    used = used[np.argsort(codes[used].astype(np.int64) << (MAX_BITS - lengths[used]), kind="stable")]
    spans = 1 << (MAX_BITS - lengths[used])
    symbols, bits = np.repeat(used, spans), np.repeat(lengths[used], spans)
    rest = (1 << MAX_BITS) - len(symbols)
    return np.pad(symbols, (0, rest)).astype(np.uint32), np.pad(bits, (0, rest), constant_values=1)


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, bits of every lane as 16-bit numbers)."""
    bits = lengths[ids]
    ends = np.cumsum(bits)
    at = ends - bits
    shifted = codes[ids].astype(np.uint64) << (np.uint64(32) - (bits + (at & 7)).astype(np.uint64))
    size = (int(ends[-1]) + 7 >> 3) + 4 if len(ids) else 4
    out = np.zeros(size)
    for j in range(4):
        out += np.bincount((at >> 3) + j, weights=((shifted >> np.uint64(24 - 8 * j)) & np.uint64(255)).astype(float), minlength=size)
    lanes = np.add.reduceat(bits, np.arange(0, len(ids), LANE)) if len(ids) else bits
    return out.astype(np.uint8).tobytes(), lanes.astype("<u2").tobytes()


def decode_block(payload: bytes, lane_bits: bytes, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    symbols, bits = table
    raw = np.frombuffer(payload, dtype=np.uint8).astype(np.uint32)
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    lanes = np.frombuffer(lane_bits, dtype="<u2").astype(np.int64)
    at = np.cumsum(lanes) - lanes
    out = np.zeros((len(lanes), LANE), dtype=np.uint32)
    last = len(words) - 1
    for step in range(LANE):
        if step and step == n - (len(lanes) - 1) * LANE:  # the last lane ends here
            at = at[:-1]
        window = (words[np.minimum(at >> 3, last)] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32)) & ((1 << MAX_BITS) - 1)
        out[:len(at), step] = symbols[window]
        at = at + bits[window]
    return out.reshape(-1)[:n]


# Tokenising -----------------------------------------------------------------------------------------------------------

#: Marks that are cut off the end of a word, where they form a token run of their own.
MARKS = b".,;:!?#$%&*|"

def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all items of runs, each given by its first place and its size."""
    behind = np.cumsum(size)
    total = int(behind[-1]) if len(size) else 0
    return np.repeat((start - (behind - size)).astype(np.int32), size) + np.arange(total, dtype=np.int32)


class _Stems:
    """Ids of stems, those met before from memory.

    Stems and ids are held in Arrow and numpy arrays, about 35 bytes a stem where Python objects take 200. When they exceed
    ``CACHED_BYTES``, only the stems asked for last are kept.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.forms, self.size, self.start, self.flat = pa.array([], pa.string()), *[np.zeros(0, dtype=t) for t in ("i4", "i4", "<u4")]

    def __call__(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size, first place, ids): the ids of every form are as many as its size says, from its first place on."""
        at = pc.fill_null(pc.index_in(forms, value_set=self.forms), -1).to_numpy(zero_copy_only=False).copy()
        new = at < 0
        if new.any():
            coded = forms.filter(pa.array(new)).dictionary_encode()
            ids, size = self._encode(coded.dictionary.to_pylist())
            if self.forms.nbytes + self.flat.nbytes + coded.dictionary.nbytes + ids.nbytes > CACHED_BYTES:
                kept, at[~new] = np.unique(at[~new], return_inverse=True)
                self.forms, self.flat, self.size = self.forms.take(pa.array(kept)), self.flat[_places(self.start[kept], self.size[kept])], self.size[kept]
            at[new] = len(self.forms) + coded.indices.to_numpy()
            self.forms, self.flat = pa.concat_arrays([self.forms, coded.dictionary]), np.concatenate([self.flat, ids])
            self.size = np.concatenate([self.size, size])
            self.start = (np.cumsum(self.size) - self.size).astype("i4")
        return self.size[at], self.start[at], self.flat

    def _encode(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stems, number of each one's)."""
        ids, sizes = [], []
        for i in range(0, len(stems), 4096):
            words = stems[i:i + 4096]
            begins = np.cumsum([0] + [len(w) + 1 for w in words])
            e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            ids.append(np.array(e.ids, dtype="<u4"))
            sizes.append(np.diff(np.searchsorted(np.array([a for a, _ in e.offsets], dtype=np.int64), begins)).astype("i4"))
        return np.concatenate(ids), np.concatenate(sizes)


#: Stems met by this Python process, by tokenizer; tasks that follow on the same worker find them.
_STEMS: dict[str, _Stems] = {}


class _WordEncoder(dict):
    """Ids of words, as little-endian bytes; what is new in a batch is encoded in one call.

    Words are split at space and U+0009 to U+000D, where the tokenizer splits as well, so ids of words in a row are the ids
    of the text. It also splits between a letter and marks; so a word is put together from its stem and the marks at its end,
    and only these go through the tokenizer, once each. Words that may hold a special token go whole.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__()
        key = md5(tokenizer_json.encode()).hexdigest()
        if key not in _STEMS:
            _STEMS[key] = _Stems(tokenizer_json)
        self.stems = _STEMS[key]

    def table(self, stems: list[str]) -> list[bytes]:
        """Ids of every stem; those not met by this worker are encoded first."""
        size, start, flat = self.stems(pa.array(stems, pa.string()))
        return [flat[a:a + n].tobytes() for a, n in zip(start.tolist(), size.tolist())]

    def learn(self, found: set[bytes]) -> None:
        if len(self) > CACHED_FORMS:
            self.clear()
        pending = []
        for w in found.difference(self):
            stem = w.rstrip(MARKS)
            pending.append((w, stem, w[len(stem):]) if stem[-1:].isalpha() and b"<" not in w else (w, w, b""))
        ids = self.table([x.decode() for _, stem, mark in pending for x in (stem, mark)])
        for (w, _, _), stem, mark in zip(pending, ids[::2], ids[1::2]):
            self[w] = stem + mark

    def words(self, text: str) -> list[bytes]:
        """A-Z in lower case, as the tokenizer has it too, except where a special token may be spelled out."""
        raw = text.encode("utf-8", "replace")
        return (raw if b"<|" in raw else raw.lower()).split()


#: What ``_WordEncoder`` relies on, as tokenizer files put it: blanks and lower case, and the pattern that cuts texts.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_blanks_and_marks(tokenizer_json: str) -> bool:
    """Whether a tokenizer file has the rules by which a text's ids are those of its words, stems and marks."""
    rules = json.loads(tokenizer_json)
    cut = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return ((rules.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and cut[0].get("pattern") == {"Regex": _CUTS}
            and cut[0].get("type") == "Split" and cut[0].get("invert") is True and not rules.get("truncation")
            and all(t["content"].startswith("<|") and not t["normalized"] for t in rules.get("added_tokens", [])))


class _TextEncoder:
    """(ids of all texts, ids of each text) of Arrow arrays of texts.

    A chunk's distinct words are found by Arrow, and their distinct stems are looked up or, once each, sent through the tokenizer;
    ids are then gathered by code for all words at once. With a tokenizer of other rules whole texts go through it.
    """

    def __init__(self, tokenizer_json: str):
        self.words = _WordEncoder(tokenizer_json)
        self.by_word = cuts_at_blanks_and_marks(tokenizer_json)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            ids = [e.ids for e in self.words.stems.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in ids for i in x], dtype="<u4"), np.array([len(x) for x in ids], dtype=np.int64)
        plain = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        stem, mark = self._parts(coded.dictionary)
        found = [x.dictionary_encode() for x in (stem, mark)]
        size, start, flat = self.words.stems(pa.concat_arrays([f.dictionary for f in found]))
        items = np.empty((len(codes), 2), dtype=np.int32)
        items[:, 0] = found[0].indices.to_numpy(zero_copy_only=False)[codes]
        items[:, 1] = (found[1].indices.to_numpy(zero_copy_only=False) + len(found[0].dictionary))[codes]
        items = items.reshape(-1)
        n = size[items]
        out = flat[_places(start[items], n)]
        ends = 2 * (split.offsets.to_numpy() - split.offsets[0].as_py())
        return out, np.diff(np.concatenate([[0], np.cumsum(n)])[ends])

    @staticmethod
    def _parts(forms: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Stem and marks at the end of every form; a form that does not come apart is its own stem."""
        stem = pc.ascii_rtrim(forms, characters=MARKS.decode())
        apart = pc.and_(pc.match_substring_regex(stem, r"[A-Za-z]\z"), pc.invert(pc.match_substring(forms, "<")))
        marks = pc.struct_field(pc.extract_regex(forms, r"(?s)(?P<m>[.,;:!?#$%&*|]*)\z"), "m")
        return pc.if_else(apart, stem, forms), pc.if_else(apart, marks, "")


def tokenize(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, before, id, n, ids) in order of id, then of text's hash: part by part, and in a part by ``before``, the ids
    before the document in its part. ids: little-endian 32-bit numbers, ``end_id`` last. NULL is an empty text.

    ``tokenizer_json``: the tokenizer's file as text, so that tasks need no file.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ("id", "_key")
    base = base.withColumn("_key", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    base = base.select(F.spark_partition_id().alias("part"), "id", "text")
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = _TextEncoder(tokenizer_json), 0
        for batch in batches:
            for part in row_chunks(batch, "text"):
                ids, n = encode(part.column("text"))
                ids, n = np.insert(ids, np.cumsum(n), end_id).astype("<u4"), n + 1
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                cuts = np.concatenate([[0], 4 * np.cumsum(n)]).astype(np.int64)
                raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("part"), pa.array(starts), part.column("id"), pa.array(n), raw.cast(pa.binary())],
                                                 ["part", "before", "id", "n", "ids"])

    return base.mapInArrow(run, f"part int, before bigint, id {kind}, n bigint, ids binary")


def _count(tokens: DataFrame) -> dict[int, int]:
    """Times of every id; as many rows as the vocabulary has ids reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                found = np.bincount(np.frombuffer(b"".join(batch.column("ids")[i:i + 512].to_pylist()), dtype="<u4"), minlength=len(total))
                found[:len(total)] += total
                total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["s", "n"])

    rows = tokens.select("ids").mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    return {r["s"]: r["n"] for r in rows.collect()}


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write them to ``path``: ``blocks`` (one folder per part, in order) and ``codebook``.

    Documents stand in ascending id (NULL first; of one id in the order of a hash of their text); repeated rows are written
    as often as they come. No task holds more than one document beyond a block.
    """
    tokens = settle(tokenize(docs, tokenizer_json, end_id, id_col, text_col), "tokens")
    spark = docs.sparkSession
    counts = _count(tokens)
    dense = np.zeros(max(counts, default=0) + 1, dtype=np.int64)
    for s, n in counts.items():
        dense[s] = n
    lengths = code_lengths(dense)
    codes = canonical_codes(lengths)
    kind = tokens.schema["id"].dataType.simpleString()
    book = spark.range(1).select(F.lit(lengths.astype(np.uint8).tobytes()).alias("lengths"), F.lit(kind).alias("id_type"))
    book.write.mode("overwrite").parquet(f"{path}/codebook")

    parts = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    placed = tokens.join(F.broadcast(offsets), "part").select("part", (F.col("first") + F.col("before")).alias("start"), "id", "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(h[4] for h in held), dtype="<u4")
            payload, lanes = encode_block(ids, lengths, codes)
            sizes = [h[3] for h in held]
            columns = [pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]]), pa.array([[h[2] for h in held]], pa.list_(id_type)),
                       pa.array([sizes]), pa.array([lanes], pa.binary()), pa.array([payload], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "start", "ids", "sizes", "lanes", "payload"])

        id_type, size = pa.null(), 0
        for batch in batches:
            id_type = batch.schema.field("id").type
            for i in range(batch.num_rows):
                row = tuple(batch.column(j)[i].as_py() for j in range(5))
                apart = held and (held[-1][0] != row[0] or held[-1][1] + held[-1][3] != row[1])
                if held and (apart or size + row[3] > BLOCK_IDS):
                    yield block()
                    size = 0
                held.append(row)
                size += row[3]
        if held:
            yield block()

    blocks = placed.mapInArrow(run, f"part int, start bigint, ids array<{kind}>, sizes array<bigint>, lanes binary, payload binary")
    blocks.sortWithinPartitions("part", "start").write.partitionBy("part").mode("overwrite").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids) of every document, from the files alone: ``start`` counts the ids of all documents before it, ids
    are little-endian 32-bit numbers. Blocks are decoded independently of each other."""
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths, kind = np.frombuffer(book["lengths"], dtype=np.uint8).astype(np.int64), book["id_type"]
    blocks = spark.read.schema(f"start bigint, ids array<{kind}>, sizes array<bigint>, lanes binary, payload binary").parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                start, names, sizes, lanes, payload = (batch.column(j)[i].as_py() for j in range(5))
                ends = np.cumsum(sizes)
                raw = decode_block(payload, lanes, int(ends[-1]), table).astype("<u4").tobytes()
                parts = [raw[4 * (e - s):4 * e] for e, s in zip(ends.tolist(), sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(names, id_type), pa.array(start + ends - np.array(sizes)), pa.array(parts, pa.binary())],
                                                 ["id", "start", "ids"])

    return blocks.mapInArrow(run, f"id {kind}, start bigint, ids binary")
