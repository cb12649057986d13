import hashlib
import random
import struct

import cases
import pytest
from tokenizers import decoders, Regex, Tokenizer, normalizers, pre_tokenizers

from tabularlab.llm import bpe
from tabularlab.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def test_round_trip_equals_the_library(spark, library):
    got = bpe.encode_digests(cases.documents(spark), PATH).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r[0], *expected(library, r[1])) for r in cases.rows()), key=repr)
    assert bpe.encode_digests(cases.empty(spark), PATH).count() == 0


def test_long_words_are_streamed(library):
    code, rng = bpe.load(PATH), random.Random(1)
    tokens = [t.removesuffix("</w>") for t in code.vocab if t.isascii()]
    for make in (lambda: rng.choice(tokens), lambda: rng.choice("abcdefghijkl"), lambda: rng.choice("ab"), lambda: rng.choice("!?.")):
        word = "".join(make() for _ in range(4000))
        assert code.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_final_tokens_do_not_change_with_more_text():
    """The lookahead is sufficient: what is emitted stays, whatever follows."""
    code, rng = bpe.load(PATH), random.Random(2)
    for _ in range(20):
        data = "".join(rng.choice("aeinorst") for _ in range(code.lookahead + 60))
        first = None
        for _ in range(5):
            ids = code.merged([code.plain[b] for b in (data + "".join(rng.choice("aeinorst") for _ in range(30))).encode()])
            ends, at = [], 0
            for i in ids:
                at += code.length(i)
                ends.append(at)
            stable = [e for e in ends if e <= 60]
            assert first in (None, stable)
            first = stable


def test_mixed_characters(library):
    code, rng = bpe.load(PATH), random.Random(4)
    parts = ["é", "a", "the", "ing", "Σ", "İ", "中", "́", "ﬁ", "Ᲊ", "!", "1", " ", "\n", "\t", "\xa0", "\x1c", "<|endoftext|>",
             "'s", "’", " ", "한", "😀", "ا", "<|"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert code.digest(text) == expected(library, text)


def test_plain_characters_have_the_library_classes():
    spec = bpe.load(PATH)
    split = pre_tokenizers.Split(Regex(spec.pattern), "removed", invert=True)
    normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    plain = [chr(i) for i in [*range(0x530), *range(0x2010, 0x2060), *range(0x3040, 0x3100), *range(0x4E00, 0x5200), *range(0xAC00, 0xAE00)]
             if not bpe.NOT_PLAIN.search(chr(i))]
    for c in plain:
        for text in ("a" + c, "!" + c):
            assert list(spec.pieces(text)) == [p for p, _ in split.pre_tokenize_str(normal.normalize_str(text))], hex(ord(c))


def test_columns_and_readable_text(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld, 42!"), (2, None)], "doc_id long, text string")
    rows = bpe.decode_column(bpe.encode_column(docs, PATH), PATH, readable=True).orderBy("doc_id").collect()
    assert rows[0].decoded.split() == ["hello", "wörld", ",", "4", "2", "!"] and rows[1].ids == [] and rows[1].decoded == ""


def test_digest_decodes_the_ids(library, monkeypatch):
    text = "Hello  wörld 😀, 42! <|endoftext|> 中文"
    ids = library.encode(text, add_special_tokens=False).ids
    code = bpe.Bpe(PATH)
    assert "".join(code.decode(ids)) == library.decode(ids, skip_special_tokens=False)
    code.decoder = "ByteLevel"
    said = "".join(code.decode(ids))
    assert said == decoders.ByteLevel().decode([library.id_to_token(i) for i in ids]) and "😀" in said
    assert code.digest(text)[2] == hashlib.sha256(said.encode()).hexdigest()


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    code = bpe.Bpe(PATH)
    code.encode(" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)))
    assert len(code.cache) <= 10 and len(code.finished) <= 10
