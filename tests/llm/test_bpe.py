import hashlib

import pytest
from tokenizers import Tokenizer

from colsight.llm.bpe import Encoder, bpe, op3_bpe, read_vocabulary, vocabulary_path


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(vocabulary_path())
    out.no_truncation()
    out.no_padding()
    return out


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_equals_library_on_documents(spark, sf_dir, documents, library):
    got = {r.doc_id: tuple(r)[1:] for r in op3_bpe(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for i, text, _ in documents:
        ids, decoded = expected(library, text)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


HARD = [
    "", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abababababab", "I'LL we've IT'S 'tis rock'n'roll", "x<|endoftext|>y <|startoftext|>",
    "<|endoftext|>", "ΣοΦΟΣ İstanbul straße ǅ", "été ﬁn", "12345 ½ ٢٣", "日本語の文章です",
    "\U0001f600\U0001f44d\U0001f3fd!!??...", " 　\t\r\n\x0b\x1c\x85 x​y", "supercalifragilisticexpialidocious antidisestablishmentarianism",
    "mississippi bookkeeper nnnnnnmmmmmm hahahaha lololol", "$$$%%%***---===___~~~", "\x00\x01\x7f", "a" * 3000, "the" * 500,
]


def test_hard_texts(library):
    encoder = Encoder(read_vocabulary(vocabulary_path()))
    for text in HARD:
        ids, decoded = expected(library, text)
        raw, own = encoder.encode(text)
        assert [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)] == ids, text[:50]
        assert own == decoded


def test_every_token_text(library):
    encoder = Encoder(read_vocabulary(vocabulary_path()))
    words = [t.removesuffix("</w>") for t in encoder.names.values() if t.isascii() and "<" not in t]
    for w in words[::7]:
        assert encoder.encode(w)[1] == expected(library, w)[1], w


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id bigint, text string, ids string, decoded int"
    rows = [(None, None, "x", 1), (1, "", None, 2), (1, "hello world", None, 2), (1, "hello world", None, 2)]
    got = sorted(((r.doc_id, r.n_tokens, r.decoded) for r in bpe(spark.createDataFrame(rows, schema), vocabulary_path()).collect()), key=str)
    assert got == [(1, 0, ""), (1, 2, "hello</w> world</w>"), (1, 2, "hello</w> world</w>"), (None, 0, "")]
    assert bpe(spark.createDataFrame([], schema), vocabulary_path()).count() == 0
