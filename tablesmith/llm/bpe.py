"""BPE encoding by longest matches with backtracking, decoding by an offset table.

The vocabulary is a word-level BPE file: ids 0-255 are bytes, 256-511 bytes that end a
word, and each later id is one merge, in order of rank. A word is a string over those 512
symbols. Aho-Corasick finds the longest token that starts at each place; a token may
follow another only if no merge of BPE would cross their boundary, which a table of pairs
remembers; where none fits, the encoder steps back. Every place is left at most once per
token prefix, so the time is linear in the word, however long it is. Words are looked up
in a bounded per-worker table before they are encoded.

Decoding gathers bytes from one buffer of all tokens through an array of offsets; tokens
are joined by one space, as the file names no decoder.

Defined results: NULL counts as empty, an empty text has no tokens and decodes to the
empty text; equal rows give equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import text_of

CACHE_WORDS = 250_000
NO_TOKEN = -1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        letters = byte_letters()
        # symbol of each byte as one character: the byte, or 256 + the byte at a word's end
        self.base = [vocab[c] for c in letters] + [vocab[c + end] for c in letters]
        n = len(vocab)
        self.split: list[tuple[int, int] | None] = [None] * n
        self.pair: dict[tuple[int, int], int] = {}
        self.symbols: list[str] = [""] * n
        for s, t in enumerate(self.base):
            self.symbols[t] = chr(s)
        for a, b in merges:
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair[left, right] = whole
            self.split[whole] = (left, right)
            self.symbols[whole] = self.symbols[left] + self.symbols[right]
        self.length = [len(s) for s in self.symbols]
        known = {s: t for t, s in enumerate(self.symbols)}
        self.prefix = [next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), NO_TOKEN)
                       for s in self.symbols]
        self.automaton = ahocorasick.Automaton()
        for s, t in known.items():
            self.automaton.add_word(s, t)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        # fixed values: the file's split pattern, white space written out
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        texts = {t: s for s, t in vocab.items()} | {i: s for s, i in self.special.items()}
        parts = [texts[t].encode() + b" " for t in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the boundary between tokens a and b alone, undoing merges latest first."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        left, right, before, fits = a, b, len(self.split), True
        while True:
            whole = self.pair.get((left, right))
            if whole is not None and whole < before:
                fits = False
                break
            parts_l, parts_r = self.split[left], self.split[right]
            if parts_l is not None and (left > right or parts_r is None):
                before, left = left, parts_l[1]
            elif parts_r is not None:
                before, right = right + 1, parts_r[0]
            else:
                break
        if len(self.fits) >= 4 * CACHE_WORDS:
            self.fits.clear()
        self.fits[a, b] = fits
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece of the split, not empty."""
        raw = word.encode("utf-8", "surrogatepass")
        s = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        n, length = len(s), self.length
        longest = [NO_TOKEN] * n
        for stop, t in self.automaton.iter(s):
            at = stop - length[t] + 1
            if longest[at] == NO_TOKEN or length[t] > length[longest[at]]:
                longest[at] = t
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            if token == NO_TOKEN:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
                continue
            stop = at + length[token]
            if open_at[stop] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = stop
                token = longest[at] if at < n else NO_TOKEN
            else:
                token = self.prefix[token]
        return out

    def _piece(self, word: str) -> bytes:
        if len(self.cache) >= CACHE_WORDS:  # words not seen since the last change of tables go
            self.cache, self.older = {}, self.cache
        ids = self.older.get(word)
        if ids is None:
            t = self.encode_word(word)
            ids = struct.pack(f"<{len(t)}I", *t)
        self.cache[word] = ids
        return ids

    def _encode_plain(self, text: str) -> bytes:
        if text.isascii():
            pieces = self.ascii_words.findall(text.lower())
        else:
            # lower case letter by letter: no final form of sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            pieces = self.words.findall(text)
        piece = self._piece
        return b"".join([self.cache.get(w) or piece(w) for w in pieces])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._encode_plain(text)
        return b"".join(self.special_ids.get(p) or self._encode_plain(p) for p in self.special_at.split(text) if p)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of the ids."""
        t = np.frombuffer(ids, "<u4")
        if not len(t):
            return b""
        sizes = self.sizes[t]
        ends = np.cumsum(sizes)
        at = np.repeat(self.offsets[t] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.blob[at][:-1].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One encoder for each worker process."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
                     digest: bool = False) -> DataFrame:
    """(doc_id, ids binary, decoded); with `digest` their SHA-256 and n_tokens instead.

    `vocabulary` is the path of the tokenizer file on every executor.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for b in batches:
            ids = [bpe.encode(t) for t in b["text"]]
            n = np.fromiter((len(i) // 4 for i in ids), "int64", len(ids))
            if digest:
                yield pd.DataFrame({
                    "doc_id": b["doc_id"], "n_tokens": n,
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]})
            else:
                yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids": ids,
                                    "decoded": [bpe.decode(i).decode("utf-8", "replace") for i in ids]})

    schema = "doc_id long, n_tokens long, " + (
        "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInPandas(run, schema)
