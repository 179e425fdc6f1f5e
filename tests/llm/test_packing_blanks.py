"""Token ids of texts with every kind of white space and control against one encode of the whole text."""

import sys
import zlib

import numpy as np
import pytest

from troughline.llm import packing
from troughline.llm.queries import tokenizer_path

CONTROLS = [chr(c) for c in (*range(1, 32), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]


def test_words_are_cut_only_at_white_space_of_the_tokenizer():
    spaces = {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()} - set("\x1c\x1d\x1e\x1f")
    assert {c for c in map(chr, range(sys.maxunicode + 1)) if packing.token_words(f"a\x1fb{c}d") != [f"a\x1fb{c}d"]} == spaces


def test_ids_are_those_of_the_whole_text(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    texts = [f"ab{c}cd {c} ef.{c}{c} It's{c}" for c in CONTROLS] + ["".join(CONTROLS), "plain text, no control", "a\x1cb " * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got: dict = {}
    for r in packing.pieces(docs, path).orderBy("id", "piece").collect():
        got.setdefault(r.id, []).append((r.start, r.length, r.ids_crc32))
    whole = tokenizers.Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = [*whole.encode(t, add_special_tokens=False).ids, packing.END_ID]
        cuts = [ids[a:a + packing.CAPACITY] for a in range(0, len(ids), packing.CAPACITY)]
        want = [(n * packing.CAPACITY, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for n, c in enumerate(cuts)]
        assert got[i] == want, repr(t[:40])


def test_every_letter_before_every_mark():
    import sys

    from tokenizers import Tokenizer

    from troughline.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    whole, ids_of = Tokenizer.from_file(path), packing.WordIds(path)
    letters = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalpha()]
    odd = [*map(chr, range(0x958, 0x960)), "\u0130", "\u09dc", "\u09dd", "\u09df", "\ufb2a", "\u0f43"]
    words = [c + "." for c in letters] + ["ab" + c + m for c in [*odd, *letters[::97]] for m in packing.MARKS] + [c + "\u0301," for c in odd]
    rng = np.random.default_rng(1)
    words += ["".join(map(chr, rng.integers(97, 123, n))) for n in range(1, 30) for _ in range(20)] + ["don't", "it's.", "'s", "UPPER", "a1b2", "<|endoftext|>"]
    ids_of.learn(set(words))
    want = whole.encode_batch_fast(words, add_special_tokens=False)
    wrong = [w for w, e in zip(words, want) if np.frombuffer(ids_of.of([w]), "<u4").tolist() != e.ids]
    assert not wrong
