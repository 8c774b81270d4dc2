"""Token ids, shards and packing against plain computations."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from costbook.llm import packing, shards
from costbook.llm.tokens import Encoder
from costbook.session import scratch_path

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, tokens long, start long, Shard string"
LONG = "word " * 30_000
TEXTS = [(3, "It's the END."), (1, ""), (2, None), (None, "no id"), (5, "same"), (5, "same"), (5, "other"), (7, LONG), (-4, "minus"), (9, "ÀÉ ß naïve 漢字 <|endoftext|> x")]


def plain_ids(text, end):
    encoder = Encoder(VOCABULARY)
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_encoder_equals_the_library():
    encoder = Encoder(VOCABULARY, keep=50)
    dice = random.Random(7)
    signs = "aAzZ sS'tTéÉßÿ×ªµ\n\t ́ΣςİI1²½.,!<|>endoftext漢字😀revmd\x1c\x85"
    texts = ["".join(dice.choice(signs) for _ in range(dice.randrange(70))) for _ in range(3000)] + ["<|startoftext|>a", "I'LL 'Re don't"]
    for text, want in zip(texts, encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids, text


def test_other_vocabularies_get_whole_texts():
    encoder = Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert not encoder.by_word
    assert np.frombuffer(encoder.encode(" a  b\n"), "<u4").tolist() == encoder.tokenizer.encode(" a  b\n", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-2**62, 2**62, n))
    hash_ = shards.Hash.build(keys)
    assert sorted(hash_.slots(keys).tolist()) == list(range(n))
    index = shards.Index.load(shards.Index.build(keys, 0, np.ones(n, np.int64), 2).dump())
    assert index.find(keys)[1].tolist() == [1] * n
    assert index.find(np.array([2**62 + k for k in range(500)]))[1].sum() == 0


def test_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        shards.Hash.build(np.array([4, 4]))


def test_shards_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in TEXTS], SCHEMA)
    path = scratch_path(spark, "shards")
    shards.write_shards(docs, path, VOCABULARY, end=2)
    rows = sorted(shards.read_shards(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, -4, 1, 2, 3, 5, 5, 5, 7, 9]
    start, by_id = 0, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == start and r["n_tokens"] == len(ids)
        start += len(ids)
        by_id.setdefault(r["doc_id"], []).append(ids)
    for key in by_id:
        want = [plain_ids(t, 2) for i, t in TEXTS if i == key]
        assert sorted(by_id[key]) == sorted(want)
    reader = shards.Reader(spark, path)
    assert [x.tolist() for x in reader[7]] == by_id[7] and sorted(x.tolist() for x in reader[5]) == sorted(by_id[5])
    assert reader[6] == [] and reader[10**12] == []
    # a fingerprint that fits by chance does not make a key known
    for name in [s.name for s in reader.shards]:
        index = reader._index(name)
        if len(index.prints):
            slot = int(index.hash.slots(np.array([6]))[0])
            index.prints = index.prints.copy()
            index.prints[slot] = shards.fingerprint(np.array([6]))[0]
    assert reader[6] == []
    few = shards.Reader(spark, path, held=1)
    assert all(sorted(x.tolist() for x in few[k]) == sorted(by_id[k]) for k in by_id if k is not None) and len(few.indexes) == 1


def test_shards_of_nothing(spark):
    path = scratch_path(spark, "shards")
    assert shards.write_shards(spark.createDataFrame([], SCHEMA), path, VOCABULARY).count() == 0
    assert shards.read_shards(spark, path).count() == 0


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_covers_every_id_once(spark, capacity):
    dice = random.Random(capacity)
    own = [(100 + k, " ".join(dice.choice(["the", "of", "zebra", "12"]) for _ in range(dice.randrange(400)))) for k in range(120)]
    docs = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in TEXTS + own], SCHEMA).repartition(3)
    rows = packing.pack(docs, VOCABULARY, capacity=capacity, end=1).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    for i, t in TEXTS + own:
        if i == 5:
            continue
        pieces = sorted(by_id[i], key=lambda r: r["start"])
        assert sum((np.frombuffer(r["ids"], "<u4").tolist() for r in pieces), []) == plain_ids(t, 1)
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert {r["doc_tokens"] for r in pieces} == {len(plain_ids(t, 1))}
    assert sum(r["length"] for r in by_id[5]) == sum(len(plain_ids(t, 1)) for i, t in TEXTS if i == 5)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    used = padded = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        held, length = sum(r["length"] for r in pieces), pieces[0]["sequence_length"]
        assert held <= length <= capacity and (length == capacity or held == length and length & (length - 1) == 0)
        used, padded = used + held, padded + length
    assert padded <= used * 1.03


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0


def test_cut_fits_its_class():
    for tokens in range(1, 5000):
        pieces = packing.cut(tokens, 2048, 32, 32)
        assert sum(n for n, _ in pieces) == tokens and all(n * k <= 2048 for n, k in pieces)


def test_crc_is_that_of_zlib(spark):
    from pyspark.sql import functions as F
    assert spark.range(1).select(F.crc32(F.lit(b"\x01\x02"))).first()[0] == zlib.crc32(b"\x01\x02")
