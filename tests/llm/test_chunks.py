"""The encoder remembers what is met again, and gives the library's ids however it cuts the texts."""

import random
from collections import Counter

import numpy as np
from tokenizers import Regex, Tokenizer, models, pre_tokenizers, trainers

from lateweave.llm.bpe import ChunkEncoder
from lateweave.llm.queries import BYTE_BPE

PARTS = ["<|endoftext|>", " ", " ", "  ", "\n", "\n", "\n\n", "\t", "\v", "\r\n", " ", "　", "\x1c", "word", "word", "Größe",
         "ɏ", "ɐ", "Ж", "中文", "́", "'s", "'", "'ll", ".", ",", "...", ").", "***", "<|", "don't", "7", "½", "×", "Ġthe", "\0"]


def agree(encoder, texts):
    flat, counts = encoder(texts)
    ends = np.cumsum(counts)
    plain = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, a, b, want in zip(texts, ends - counts, ends, plain, strict=True):
        assert flat[a:b].tolist() == want.ids, text


def letters(number):
    return "".join("abcdefghij"[int(d)] for d in f"{number:06d}")


def test_words_met_again_are_not_merged_again():
    """Words that occur once, many times the limit, and 300 that every call has, with signs and lines."""
    encoder = ChunkEncoder(BYTE_BPE, limit=2000)
    merge, merged = encoder.merge, Counter()

    def counted(word):
        merged[word] += 1
        return merge(word)

    encoder.merge = counted
    often = [letters(i) for i in range(300)]
    for call in range(60):
        once = [letters(1000 * (call + 1) + i) for i in range(400)]
        agree(encoder, [" ".join(["x", *often, *once]), "x " + ", ".join(often) + "."])
    assert sum(merged.values()) >= 60 * 400
    assert max(merged["Ġ" + w] for w in often) == 1


def test_ids_of_odd_texts_while_chunks_are_dropped():
    rng = random.Random(11)
    for limit in (50, 400_000):
        encoder = ChunkEncoder(BYTE_BPE, limit)
        assert encoder.fine and encoder.words
        for _ in range(6):
            agree(encoder, ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(1500)])
        agree(encoder, ["a  b", "<|endoftext|>"])
        agree(encoder, ["", ""])
        agree(encoder, [])


def test_a_vocabulary_that_joins_signs_and_newlines(tmp_path):
    """Its signs take the newline after them, so it is cut at spaces alone."""
    rng = random.Random(12)
    t = Tokenizer(models.BPE())
    rule = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(rule), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    texts = [" ".join(rng.choice(["one", "two", "Größe"]) + rng.choice(["", "!\n", ").\n\n", "\n"]) + rng.choice(["", "x"])
                      for _ in range(12)).strip() for _ in range(300)]
    t.train_from_iterator(texts, trainers.BpeTrainer(
        vocab_size=400, special_tokens=["<|endoftext|>"], initial_alphabet=pre_tokenizers.ByteLevel.alphabet()))
    t.save(str(tmp_path / "other.json"))
    encoder = ChunkEncoder(str(tmp_path / "other.json"))
    assert any("Ċ" in w and len(w) > 1 for w in t.get_vocab())
    agree(encoder, texts + ["one!\ntwo", "one\ntwo", "Größe).\n\nx"])
