"""Token queries against the libraries on whole tables, added tokens inside texts, and what a task leaves behind."""

from __future__ import annotations

import gc
import os
import weakref
import zlib

import numpy as np
import pytest

import public_tokenizers
from facetspark.llm import bpe, chunks, huffman
from facetspark.llm.common import table
from facetspark.llm.queries import QUERIES, bpe_ranks
from test_corpus_small import documents

SF = "/root/testdata/sf0.001"


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_added_tokens_are_recognised_inside_texts(spark):
    texts = [
        "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y", "two  <|endoftext|>\n\n<|endoftext|> <|endoftext", "a \t<|endoftext|>  b ",
        "<|endoftext|><|endoftext|>z", "no |> such <| endoftext", None, "line\n<|endoftext|>\n end  ",
    ]
    got = huffman.binary_output(
        documents(spark, list(enumerate(texts))), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2
    ).collect()
    want = library_ids(texts)
    for r in got:
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not there")
def test_registered_token_output_is_that_of_the_library(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_id_output"](spark, SF).collect()}
    start, want = 0, {}
    for d, ids in zip(docs, library_ids([d.text for d in docs])):
        want[d.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_a_task_leaves_nothing_behind():
    gc.disable()
    try:
        with bpe.PartitionBpe(bpe_ranks(), public_tokenizers.PATTERN) as own:
            own.encode_chunks([" something", " new"])
        gone = weakref.ref(own)
        del own
        assert gone() is None
    finally:
        gc.enable()


def test_what_is_remembered_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(chunks, "KNOWN_BYTES", 2_000)
    known = chunks.Remembered()
    for k in range(100):
        known.make_room()
        known.add([f"word{k}", "x" * 500], [b"1234", b"5678"])
        assert known.size < 4_000 and known[f"word{k}"] == b"1234"
