"""The transducer, the lexicon and the round trip against the tokenizer itself."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postmill.llm import bpe, packing
from postmill.llm.queries import op13_bpe, tokenizer

SIGNS = list("abcde'é ßİſ") + ["<|endoftext|>", "<|", "́", " ", "\x1f", "\n", "Σ", "漢", "12", "don't", "ÀÉ", "😀", " "]


def mapped(entries):
    return bpe.Transducer(np.frombuffer(bpe.compiled(entries), "<u4"))


@pytest.mark.parametrize("seed", range(4))
def test_transducer_gives_each_words_ids_and_no_others(seed):
    draw = random.Random(seed)
    words = {bytes(draw.choices(b"ab\xc3\xa9z", k=draw.randint(0, 6))): tuple(draw.choices(range(5), k=draw.randint(1, 4))) for _ in range(300)}
    own = mapped(sorted(words.items()))
    asked = [*words, *(bytes(draw.choices(b"ab\xc3\xa9zq", k=draw.randint(0, 8))) for _ in range(200))]
    known, sizes, ids = own.find(asked)
    assert known.tolist() == [w in words for w in asked]
    ends = np.cumsum(sizes)
    assert [tuple(ids[a:b].tolist()) for a, b in zip(ends - sizes, ends, strict=True)] == [words[w] for w in asked if w in words]


def test_transducer_is_minimal():
    # one ending for all stems, ids included: stem states, the ending's states and one last state
    stems = [b"p", b"q", b"r", b"s"]
    own = mapped(sorted((a + b"ing", (7,)) for a in stems))
    assert len(own.finals) == 5 and len(own.keys) == 7
    assert not mapped([]).find([b"", b"a"])[0].any()
    # no two states have the same arcs and outputs
    words = {f"{a}{b}{c}".encode(): (len(a), 9) for a in "xyz" for b in ("on", "at", "") for c in ("s", "ed", "ing")}
    own = mapped(sorted(words.items()))
    rests = [(int(own.finals[n]), tuple((int(k & 255), int(t), int(o)) for k, t, o in zip(own.keys, own.targets, own.arc_outs, strict=True) if k >> 8 == n)) for n in range(len(own.finals))]
    assert len(rests) == len(set(rests))


def test_round_trip_of_random_texts_with_any_lexicon(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choices(SIGNS, k=draw.randint(0, 60))) for _ in range(300)] + [None, "", " \t", "a" * 20_000, " ".join(["the cat"] * 20_000)]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids int, decoded string").repartition(3)
    own = Tokenizer.from_file(tokenizer())
    want = {i: own.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    for most in (0, 30, 10_000):
        coded = bpe.encode(docs, tokenizer(), bpe.lexicon(docs, tokenizer(), most=most, least=1))
        got = {r["doc_id"]: r for r in bpe.decode(coded, tokenizer()).collect()}
        assert {i: r["ids"] for i, r in got.items()} == want
        assert {i: r["decoded"] for i, r in got.items()} == {i: own.decode(x, skip_special_tokens=False) for i, x in want.items()}


def test_words_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([("The the cat",), ("THE dog <|x",), (None,), ("漢 é",)], "text string").repartition(2)
    assert {r["word"]: r["n"] for r in bpe.word_counts(docs, tokenizer()).collect()} == {"the": 3, "cat": 1, "dog": 1, "é": 1}


def test_query_against_the_tokenizer(spark, sf, odd_docs, no_docs, tmp_path):
    own = Tokenizer.from_file(tokenizer())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def want(text):
        ids = own.encode(text or "", add_special_tokens=False).ids
        return len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))

    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs, no_docs):
        place = str(tmp_path / hashlib.sha256(str(docs.schema).encode()).hexdigest()[:8] / str(random.random()))
        docs.write.parquet(f"{place}/documents.parquet")
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op13_bpe(spark, place).collect())
        assert got == sorted((str(r["doc_id"]), *want(r["text"])) for r in docs.collect())


@pytest.fixture(scope="module")
def spaced(tmp_path_factory):
    """A public byte-level tokenizer whose tokens hold the blank before a word, with padding and truncation set."""
    import public_tokenizers

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.enable_truncation(3)
    made.enable_padding(length=8)
    path = str(tmp_path_factory.mktemp("files") / "spaced.json")
    made.save(path)
    return path


def test_tokens_that_hold_white_space(spark, spaced):
    own = Tokenizer.from_file(spaced)
    own.no_truncation()
    own.no_padding()
    text = "the cat  sat on the mat"
    want = own.encode(text).ids
    assert any("Ġ" in own.id_to_token(i) and len(own.id_to_token(i)) > 1 for i in want)
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    assert bpe.lexicon(docs, spaced) is None
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, spaced), spaced).collect()}
    assert got[1]["ids"] == want and got[1]["decoded"] == own.decode(want, skip_special_tokens=False) and got[2]["ids"] == []
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pieces(docs, spaced).collect()}
    assert ids == {1: [*want, packing.END_ID], 2: [packing.END_ID]}


def test_other_columns_stay(spark, odd_docs):
    coded = bpe.encode(odd_docs, tokenizer())
    assert coded.columns == [*odd_docs.columns, "ids"]
    assert coded.agg(F.count(F.lit(1))).first()[0] == odd_docs.count()
