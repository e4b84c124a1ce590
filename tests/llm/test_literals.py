"""Texts that hold the literal of an added token get the ids of the library's plain call."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lateweave.llm import packing, records
from lateweave.llm.bpe import ChunkEncoder
from lateweave.llm.queries import BYTE_BPE
from lateweave.session import scratch_path

TEXTS = ["page one.<|endoftext|>page two", "plain words only", "<|endoftext|>", "a  <|endoftext|>  b <|endoftext|>\n c",
         "cut <|endoftext| >off<|endoftext|><|endoftext|>Größe, ", "last one"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(BYTE_BPE)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder(plain):
    assert plain(TEXTS[0]).count(50256) == 1 and len(plain(TEXTS[0])) == 6
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|endoftext|>", " ", "  ", "\n", "\t", "word", "Größe", ".", ",", "<|", "|>", "don't", "7", "é"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(5000)]
    flat, counts = ChunkEncoder(BYTE_BPE)(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert flat[a:b].tolist() == plain(text), text


def test_token_records_and_packing(spark, plain):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    folder = scratch_path(spark, "records")
    manifest = records.write_token_records(docs, folder, BYTE_BPE)
    got = records.record_digests(records.read_token_records(spark, manifest, folder)).orderBy("doc_id").collect()
    ids = [plain(t) for t in TEXTS]
    starts = np.cumsum([0] + [len(x) + 1 for x in ids]).tolist()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [
        (i, starts[i], len(x) + 1, crc(x + [0])) for i, x in enumerate(ids)]
    pieces = packing.pack_documents(docs, BYTE_BPE).orderBy("doc_id").collect()
    assert [(r.doc_id, r.doc_tokens, r.length, r.ids_crc32) for r in pieces] == [
        (i, len(x) + 1, len(x) + 1, crc(x + [1])) for i, x in enumerate(ids)]
