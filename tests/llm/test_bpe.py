"""BPE against the tokenizers library, and the automaton against a dictionary."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.llm import bpe

SCHEMA = "doc_id long, text string, ids string"
ALPHABET = [*"abAB's .,\n\t\r1２½#$é日", " ", "  ", "\x1c", "\x85", "\xa0", " ", " ", "　", "​", "́", "\U0001f600", "<|endoftext|>", "<|endof", "'ll", "aaaa" * 30, "the", " of"]


def library(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)], t


def test_coder_equals_the_library(model_path):
    model = bpe.read_model(model_path)
    words = [b"the", b" the", b" of", b"\n", b" thing", b"ing"]
    block = bpe.compile_lexicon({w: bpe.merge(w, model["singles"], model["merges"]) for w in words})
    draw = random.Random(4)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 25))) for _ in range(3000)] + ["", "x" * 5000, " ".join(["word"] * 3000), "ab" * 3000]
    want, library_ = library(model_path, texts)
    got = [np.frombuffer(x, np.int32) for x in bpe.Coder(model, bpe.map_block(block)).encode_many(texts)]
    assert [g.tolist() for g in got] == want
    offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])])
    decoded = bpe.Decoder(model["pieces"]).column(np.concatenate(got), offsets).to_pylist()
    assert decoded == [library_.decode(w, skip_special_tokens=False) for w in want] == texts


def test_ids_that_are_no_utf8(model_path):
    model = bpe.read_model(model_path)
    half = model["pieces"].index(b"\xc3")
    _, t = library(model_path, [])
    assert bpe.Decoder(model["pieces"]).column(np.array([half, half]), np.array([0, 1, 2])).to_pylist() == [t.decode([half])] * 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=30), st.lists(st.binary(max_size=7), max_size=10))
def test_automaton_equals_a_dictionary(entries, others):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    asked = [*entries, *others]
    want = [np.array(entries[w], np.int32).tobytes() if w in entries else None for w in asked]
    assert lexicon.get(asked) == want


def test_suffixes_are_shared():
    words = {f"{a}{b}ation".encode(): [1] for a in "abcdefgh" for b in "xyz"}
    states = int(np.frombuffer(bpe.compile_lexicon(words), np.int64, 1)[0])
    assert states <= 1 + 1 + 1 + len("ation") + 1


def test_dataframe(spark, model_path):
    rows = [(1, "the of and", "mine"), (2, None, None), (3, "", "x"), (1, "the of and", "mine"), (None, "é\n\n b", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = bpe.encode_decode(df, model_path).collect()
    want, _ = library(model_path, ["the of and", "", "é\n\n b"])
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in got) == sorted([(1, want[0], "the of and")] * 2 + [(2, [], ""), (3, [], ""), (0, want[2], "é\n\n b")])
    assert bpe.encode_decode(df.limit(0), model_path).count() == 0


def test_a_task_has_one_worker(spark, model_path):
    coded = bpe.encode_decode(spark.createDataFrame([(1, "the of", "x")], SCHEMA), model_path)
    assert coded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
