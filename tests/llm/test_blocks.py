"""The comparison in blocks of what the first text of a bucket leaves apart."""

import numpy as np
import pyarrow as pa

from lateweave.llm import minhash


def chain(n, size=100):
    """Each text has one more word of its own than the one before, and a repeated tail."""
    words = [f"w{i}" for i in range(size)] + ["la"] * 12
    out = []
    for i in range(n):
        out.append(" ".join(words))
        words[(i * 7) % size] = f"new{i}"
    return out


def classes(texts, pairs):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return [root(i) for i in range(len(texts))]


def alike(texts, similarity):
    sets = [minhash.shingles(minhash.words_of(t)) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if minhash.jaccard(sets[i], sets[j]) >= similarity]


def test_links_of_a_group(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    texts = chain(30) + ["", "one two", "one two"]
    for similarity in (0.5, 0.8, 0.95):
        group = pa.table({"side": np.zeros(len(texts), dtype=np.int32), "node": np.arange(len(texts)),
                          "class": np.arange(len(texts)), "text": texts})
        got = minhash._block_links(similarity)(group).to_pydict()
        assert classes(texts, zip(got["a"], got["b"])) == classes(texts, alike(texts, similarity))
        assert len(got["a"]) < len(texts)


def test_chain_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 8)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    texts = chain(60) + ["apart " * 9, "quite another text of seven words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = minhash.near_duplicates(docs).toPandas().sort_values("doc_id")
    assert list(got.class_id) == classes(texts, alike(texts, 0.8))
    assert len(set(got.class_id)) == 3


def test_parts_of_words_give_the_path_of_the_words():
    from lateweave.llm import pieces
    from lateweave.llm.queries import PIECES

    model = pieces.PieceModel.load(PIECES)
    assert model.parts is pieces._RUN
    for text in ["the end.  (of)\nla fin,12 años! ", "  ", "▁a ▁", "x́y _z_ ²a 9b", "«été»—naïve|| |a", "語.語 a"]:
        marked = pieces.MARKER + text.replace(" ", pieces.MARKER)
        assert "".join(model.parts.findall(marked)) == marked
        whole = [i for w in pieces._WORD.findall(marked) for i in model.best_path(w)]
        assert pieces.PieceEncoder(model)(text) == whole


def test_pieces_of_mixed_kinds_keep_words_whole():
    from lateweave.llm import pieces

    names = [f"<0x{b:02X}>" for b in range(256)] + ["▁a", "b.", ".c", "a"]
    model = pieces.PieceModel.build(names, [0.0] * 256 + [-1.0, -1.0, -3.0, -2.0], [256, 257, 258, 259])
    assert model.parts is pieces._WORD
    assert pieces.PieceEncoder(model)("ab.c")[:2] == [256, 257]
