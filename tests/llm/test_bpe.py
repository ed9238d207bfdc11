import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from quillmesh.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fuzz():
    rng = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "中", "😀", "1", "23", "'s", "'ll", "<|endoftext|>", "!!", "...", "\xa0", "\u0301", "aaaa", "\x00", "\x1c", "\x85", "\r\n", "İ", "ﬁ", "٣", "_", "²", "\u2028"]
    out = ["", " ", "a" * 3000, "=" * 500, "<|endoftext|>" * 3]
    out += ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    return out + ["".join(rng.choice("abcdefgehtnisr") for _ in range(60)) for _ in range(300)] + ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(30)) for _ in range(300)]


def test_equals_the_library():
    own, lib = bpe.load(bpe.read_spec(PATH)), Tokenizer.from_file(PATH)
    texts = fuzz()
    for t, mine, theirs in zip(texts, own.encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert mine == list(theirs.ids), repr(t)
        assert own.decode(mine) == lib.decode(mine, skip_special_tokens=False)
    assert 0 < own.failed < own.checked


def test_decode_of_broken_bytes():
    own, lib = bpe.load(bpe.read_spec(PATH)), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(12)]
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_compatibility_equals_exact_merging():
    own = bpe.load(bpe.read_spec(PATH))
    import numpy as np

    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
    said = own.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), said.tolist()):
        assert ok == (own.merge(own.bytes[x] + own.bytes[y]) == [x, y])


def test_long_words_merge_alike(monkeypatch):
    own = bpe.load(bpe.read_spec(PATH))
    rng = random.Random(8)
    for _ in range(50):
        word = "".join(rng.choice("abetnisr") for _ in range(250)).encode()
        parts = [own.ids[word[i : i + 1]] for i in range(len(word))]
        assert own._merge_long(list(parts)) == own.merge(word)


def test_words_of_a_batch_merge_at_once(monkeypatch):
    own, lib = bpe.Bpe(bpe.read_spec(PATH)), Tokenizer.from_file(PATH)
    rng = random.Random(6)
    words = list({"".join(rng.choice("abehinorstéç") for _ in range(rng.randrange(1, 30))) for _ in range(2000)})
    alone = [tuple(own.merge(w.encode())) for w in words]
    calls = []
    monkeypatch.setattr(own, "merge", calls.append)
    got = own.encode_words(words)
    assert got == alone == [tuple(e.ids) for e in lib.encode_batch(words, add_special_tokens=False)]
    assert own.failed > 500 and not calls


def test_array_merging_equals_merge_in_any_vocabulary():
    name = {b: c for c, b in bpe._byte_names().items()}
    rng = random.Random(9)
    for _ in range(100):
        tokens, merges = [bytes([b]) for b in rng.sample(b"abcd", rng.randrange(1, 5))], []
        for _ in range(rng.randrange(20)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        rng.shuffle(merges)
        spelled = ["".join(name[b] for b in t) for t in tokens]
        own = bpe.Bpe({"model": {"vocab": dict(zip(spelled, range(len(spelled)))), "merges": [[spelled[tokens.index(t)] for t in m] for m in merges]}})
        words = ["".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 5, 9, 64, 65, 300]))) for _ in range(50)]
        assert own.encode_words(words) == [tuple(own.merge(w.encode())) for w in words]


def test_remembered_words_are_looked_up_not_passed_through(monkeypatch):
    class Remembered(dict):
        def __iter__(self):
            raise AssertionError("all remembered words were visited")

    own = bpe.Bpe(bpe.read_spec(PATH))
    first = own.encode_batch(["hinting onerstha", "whesor"])
    tried = own.checked
    own._older, own._cache = Remembered(own._cache), {}
    assert own.encode_batch(["hinting onerstha", "whesor", "onerly"])[:2] == first
    assert own.checked == tried + 1


def test_columns(spark):
    spec = queries.tokenizer_spec(spark)
    from pyspark.sql import functions as F

    rows = [(0, None), (1, ""), (2, "Hello wörld <|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in df.select("doc_id", bpe.encode_column(spec, F.col("text")).alias("ids"), bpe.digest_column(spec, F.col("text")).alias("d")).withColumn("back", bpe.decode_column(spec, F.col("ids"))).collect()}
    assert got[0]["ids"] == got[1]["ids"] == [] and got[0]["d"]["n_tokens"] == 0
    assert got[2]["back"] == rows[2][1] and got[2]["ids"][-1] == 50256
    assert got[2]["d"]["ids_sha256"] == hashlib.sha256(",".join(map(str, got[2]["ids"])).encode()).hexdigest()
