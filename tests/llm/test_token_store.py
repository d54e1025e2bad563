import heapq
import json
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm import token_store
from panelwright.llm.token_store import (_TextEncoder, _WordEncoder, canonical_codes, code_lengths, decode_block, decoding_table, encode_block,
                                         read_tokens, write_tokens)

PATH = public_tokenizers.path("word_bpe_49k.json")


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("seed", range(6))
def test_lengths_are_best_and_limited(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 200) * rng.integers(0, 2, 200)
    lengths = code_lengths(counts)
    assert (counts * lengths).sum() == huffman_cost(counts)
    tight = code_lengths(2 ** np.arange(20), 6)
    assert tight.max() <= 6 and sum(2.0 ** -x for x in tight) == 1


@pytest.mark.parametrize("n, k", [(0, 3), (1, 1), (63, 2), (64, 5), (65, 5), (128, 3), (5000, 900)])
def test_block_round_trip(n, k):
    ids = (np.random.default_rng(n).zipf(1.4, n) % k).astype(np.uint32)
    lengths = code_lengths(np.bincount(ids, minlength=k))
    payload, lanes = encode_block(ids, lengths, canonical_codes(lengths))
    assert (decode_block(payload, lanes, n, decoding_table(lengths)) == ids).all()


def test_words_have_the_ids_of_the_whole_text():
    words, whole, draw = _WordEncoder(open(PATH).read()), Tokenizer.from_file(PATH), random.Random(7)
    pieces = ["a", "B", "é", "'s", ".", ",", "...", "3.14", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "\u0301", "#", "*.", "&&&", "|", "ß", "\x1c", "漢", "😀", "-", " ", " ", "\n", "\xa0", "’"]
    for _ in range(1500):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(14)))
        split = words.words(text)
        words.learn(set(split))
        assert np.frombuffer(b"".join(words[w] for w in split), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_files_give_back_all_documents(spark, tmp_path):
    rows = [(5, "five"), (None, "no id"), (1, None), (2, ""), (3, "Die Größe, the SIZE. " * 30_000), (5, "five"), (5, "another five"), (-4, "minus"), (9, "x " * 10)]
    docs = spark.createDataFrame([(*r, b"clash") for r in rows], "doc_id long, text string, ids binary").repartition(3)
    write_tokens(docs, str(tmp_path / "t"), open(PATH).read(), 2)
    out = read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(PATH)
    assert [r["id"] for r in out] == [None, -4, 1, 2, 3, 5, 5, 5, 9]
    start = 0
    found = []
    for r in out:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert r["start"] == start and ids[-1] == 2
        start += len(ids)
        found.append((r["id"], zlib.crc32(r["ids"])))
    encoded = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
    assert sorted(found, key=str) == sorted([(d, zlib.crc32(encoded(t))) for d, t in rows], key=str)
    write_tokens(docs.where("false"), str(tmp_path / "none"), open(PATH).read(), 2)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0
    assert spark.read.parquet(str(tmp_path / "t/blocks")).agg(F.count("*")).first()[0] >= 2


def test_chunks_of_texts_have_the_ids_of_the_tokenizer():
    rules, whole, draw = open(PATH).read(), Tokenizer.from_file(PATH), random.Random(11)
    pieces = ["a", "B", "é", "'s", ".", ",", "...", "3.14", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "\u0301", "#", "*.", "&&&", "|", "ß", "\x1c", "漢", "😀", "-", " ", " ", "\n",
              "\xa0", "’", "<", "word", "Word!?", "\t", "\x0b"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(14))) for _ in range(3000)] + ["", " ", "\n a \n"]
    encode = _TextEncoder(rules)
    assert encode.by_word
    other = json.loads(rules)
    other["normalizer"] = None
    plain = _TextEncoder(json.dumps(other))
    assert not plain.by_word
    for encoder, tokenizer in ((encode, whole), (plain, Tokenizer.from_str(json.dumps(other)))):
        for cut in (0, 700):
            ids, n = encoder(pa.array(texts)[cut:])
            cuts = np.cumsum(n)[:-1]
            assert [x.tolist() for x in np.split(ids, cuts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[cut:]]
    assert encode(pa.array([], pa.string()))[0].size == 0


def test_remembered_stems_take_little_memory(monkeypatch):
    rules, whole, draw = open(PATH).read(), Tokenizer.from_file(PATH), random.Random(13)
    monkeypatch.setattr(token_store, "_STEMS", {})
    encode = _TextEncoder(rules)
    encode(pa.array(["warm up"]))
    stems = {"".join(draw.choice("abcdefghij") for _ in range(9)) for _ in range(100_000)}
    texts = pa.array([" ".join(sorted(stems))])
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    encode(texts)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 80 * len(stems)
    monkeypatch.setattr(token_store, "CACHED_BYTES", 3000)
    for _ in range(60):
        texts = [" ".join(draw.choice("abcdeé") * draw.randrange(1, 4) + draw.choice("xyz.,") for _ in range(draw.randrange(20))) for _ in range(4)]
        texts.append("".join(draw.choice("klmno") for _ in range(30)))
        ids, n = encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert encode.words.stems.forms.nbytes + encode.words.stems.flat.nbytes <= 3000
