"""BPE encoding and decoding by dynamic programming over prefixes.

A BPE encoding is the one segmentation whose neighbouring tokens are all compatible: BPE,
applied to the two tokens' characters, would not merge across their border. Any prefix of it
is the encoding of that prefix. So one token is stored per prefix: the only token that ends
there and is compatible with the token stored where it begins. An automaton over the
vocabulary names all tokens that end at a position (the suffixes of the prefix), and back
pointers from the end give the ids.

Pieces are encoded once per task and looked up afterwards; the table of known pieces is
bounded and starts again when full.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm import shared

KNOWN_PIECES = 400_000
OUT_BYTES = 2 << 20
END = "\0"  # stands for the end-of-word suffix; no byte is written with this character


def read_vocabulary(path: str) -> dict:
    """Tables of a word-level BPE file of the tokenizers library: byte-level pieces that end in
    a suffix, NFC, white space runs and lower case as normalizers, no decoder."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model = spec["model"]
    suffix = model["end_of_word_suffix"]
    return {
        "suffix": suffix,
        "vocab": model["vocab"],
        "merges": [m if isinstance(m, list) else m.split(" ") for m in model["merges"]],
        "pattern": spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next
    unused one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(own))
    return [out[b] for b in range(256)]


class Encoder:
    def __init__(self, tables: dict):
        import ahocorasick
        import regex

        suffix = tables["suffix"]
        vocab = {(t.removesuffix(suffix) + END if t.endswith(suffix) and t != suffix else t): i for t, i in tables["vocab"].items()}
        self.names = {i: t for t, i in tables["vocab"].items()} | {i: t for t, i in tables["added"].items()}
        self.added = tables["added"]
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        # The file's pattern; its white space is Unicode's.
        self.pieces = regex.compile(tables["pattern"].replace(r"\s", r"\p{White_Space}")).findall
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.characters = byte_characters()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(tables["merges"]):
            a, b = (x.removesuffix(suffix) + END if x.endswith(suffix) else x for x in (a, b))
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(vocab[a + b], (*pair, rank))
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.reached: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def _edge(self, token: int, side: int, memo: dict) -> list[tuple[int, float]]:
        """Symbols at one edge of a token from the character up, each with the rank of the merge that ends it."""
        found = memo.get(token)
        if found is None:
            chain = [token]
            while chain[-1] in self.parts:
                chain.append(self.parts[chain[-1]][side])
            ends = [math.inf] + [self.parts[t][2] for t in chain[:-1]]
            found = memo[token] = list(zip(chain, ends))[::-1]
        return found

    def _border_holds(self, a: int, b: int, upto_whole: bool) -> bool:
        """No merge crosses the border between a and b while both are built. With
        ``upto_whole`` the merge of the finished a and b is not looked at."""
        xs, ys = self._edge(a, 1, self.right), self._edge(b, 0, self.left)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            if upto_whole and x_ends == y_ends == math.inf:
                return True
            rank = self.rank.get((x, y))
            # Equal ranks: merges go from left to right.
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends == y_ends == math.inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _reachable(self, token: int) -> bool:
        """BPE turns the token's own text into this token."""
        found = self.reached.get(token)
        if found is None:
            if token not in self.parts:
                found = True
            else:
                a, b, _ = self.parts[token]
                found = self._reachable(a) and self._reachable(b) and self._border_holds(a, b, True)
            self.reached[token] = found
        return found

    def _compatible(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            found = self.fits[a, b] = self._border_holds(a, b, False)
        return found

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece: the last token of every prefix, then the back pointers."""
        characters = self.characters
        text = "".join([characters[b] for b in piece.encode()]) + END
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] is None and self._reachable(token):
                begin = end - size
                if begin == 0 or (last[begin] is not None and self._compatible(last[begin][1], token)):
                    last[end] = (begin, token)
        ids = []
        at = len(text)
        while at:
            at, token = last[at]
            ids.append(token)
        return ids[::-1]

    def _learn(self, pieces: Iterable[str]) -> None:
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        if len(self.fits) > 4 * KNOWN_PIECES:
            self.fits.clear()
        for p in pieces:
            ids = self.piece_ids(p)
            self.known[p] = (b"".join([i.to_bytes(4, "little") for i in ids]), " ".join([self.names[i] for i in ids]))

    def _ordinary(self, text: str) -> list[tuple[bytes, str]]:
        # Lower case character by character: a sigma at the end of a word is not special.
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        pieces = self.pieces(text)
        known = self.known
        if new := set(pieces).difference(known):
            self._learn(new)
            if not known.keys() >= set(pieces):  # the table has just been cleared
                self._learn(set(pieces).difference(known))
        return [known[p] for p in pieces]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text of those ids."""
        if "<" in text and self.added_pattern.search(text):
            found: list[tuple[bytes, str]] = []
            for k, part in enumerate(self.added_pattern.split(text)):
                found += [(self.added[part].to_bytes(4, "little"), part)] if k % 2 else self._ordinary(part)
        else:
            found = self._ordinary(text)
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found])


def bpe(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode every text and decode it again.

    Returns a row per input row: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit
    integers) and decoded (token strings joined by a space, as a vocabulary without decoder
    gives them; special tokens included). Strings of special tokens in a text become these
    tokens. A missing text counts as empty and has no tokens. ``vocabulary`` is the path of
    the vocabulary file on the driver; its tables travel with the tasks. doc_id keeps its
    value, also when missing or repeated; other columns are not looked at.
    """
    tables = read_vocabulary(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(tables)
            for piece in shared.batches_by_bytes(batch, "text", OUT_BYTES):
                done = [encoder.encode(t) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array([len(ids) // 4 for ids, _ in done], pa.int64()),
                        pa.array([ids for ids, _ in done], pa.binary()),
                        pa.array([text for _, text in done], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    source = docs.select("doc_id", shared.text_or_empty().alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded string")


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents with the public word-level vocabulary."""
    return digests(bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path()))
