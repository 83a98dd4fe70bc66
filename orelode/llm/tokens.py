"""Exact encoding with the tokenizers library, with pre-tokens kept in a cache of the worker.

Two pre-tokenizers have a fast path: byte-level BPE with its regular expression, and lower-cased words with word ends.
There, a text of characters up to U+017F is split by an equivalent expression with plain classes (a test compares both
over that range), and only pre-tokens that the cache lacks are encoded: short ones that aren't tokens themselves by
merging the same vocabulary by rank, the others by the library. All other texts go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import threading

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import tiktoken
from tokenizers import Tokenizer

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
DIGITS = "0-9²³¹¼-¾"
#: The contractions of both pre-tokenizers: fixed values.
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
#: Letters first, as most pre-tokens are words: no contraction starts with one.
BYTE_PIECES = re.compile(rf" ?[{LETTERS}]+| ?[{DIGITS}]+|{CONTRACTIONS}| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"[{LETTERS}]+|{CONTRACTIONS}|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
#: Characters whose class or lower case may differ between the two expression engines.
UNSURE = re.compile("[^\x00-\x1b\x20-ſ]")
ASCII_UNSURE = "\x1c\x1d\x1e\x1f"
#: The pattern of the word vocabulary's splitter: a fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for a word's end where ids are merged by rank.
END = b"\xff"
#: Pre-tokens longer than this are not kept.
LONG_PIECE = 256


#: Bytes without a printable character of their own stand for those from U+0100 on, in order: the byte-level alphabet.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
HIDDEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


def byte_level(text: str) -> str:
    """A character for each byte of the text."""
    return text.encode().decode("latin-1").translate(HIDDEN)


class Cache(dict):
    """What ``make`` gives for words, in two generations: when the young one is full it replaces the old one."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, word: str):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= LONG_PIECE:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class Encoder:
    """Encodes whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, as packed ids."""

    def __init__(self, path: str, entries: int = 400_000):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.path, self.size = path, len(made["model"]["vocab"].keys() | {t["content"] for t in made["added_tokens"]})
        self.cache = Cache(self.piece, entries)
        self.specials = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made["added_tokens"])
        pre, norm = made["pre_tokenizer"] or {}, made["normalizer"]
        self.lower = bool(norm)
        word = bool(norm) and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"] == {"Regex": WORD_PATTERN}
        byte = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.pieces = (WORD_PIECES if word else BYTE_PIECES if byte else None) if plain else None
        self.suffix = made["model"]["end_of_word_suffix"] or ""
        self.merge = self.by_rank(made)
        self.pack = [i.to_bytes(4, "little") for i in range(len(made["model"]["vocab"]) + len(self.specials) + 1)]
        made.update(added_tokens=[], normalizer=None)
        self.bare = Tokenizer.from_str(json.dumps(made))  # for text that is normalized already and holds no special token

    @functools.cached_property
    def library(self) -> Tokenizer:
        """The whole tokenizer, loaded when a text first needs it."""
        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, or None if only the library splits it."""
        if self.pieces is None or (any(c in text for c in ASCII_UNSURE) if text.isascii() else UNSURE.search(text)) or (self.special and self.special.search(text)):
            return None
        return self.pieces.findall(text.lower() if self.lower else text)

    def by_rank(self, made: dict):
        """A merger by rank over the same vocabulary, if ids are in the order of merges; else None.

        Word ends are a byte that UTF-8 never holds. Words that are tokens themselves are left to the library.
        """
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        vocab, suffix = made["model"]["vocab"], self.suffix
        ids = [vocab[a + b] for a, b in merges]
        if ids != list(range(len(vocab) - len(ids) - len(self.specials.keys() & vocab.keys()), len(vocab) - len(self.specials.keys() & vocab.keys()))):
            return None
        shown = {chr(HIDDEN.get(b, b)): bytes([b]) for b in range(256)}
        ranks = {}
        for token, i in vocab.items():
            if token not in self.specials:
                body = token.removesuffix(suffix) if suffix else token
                ranks[b"".join(shown[c] for c in body) + (END if len(body) < len(token) else b"")] = i
        if any(bytes([b]) not in ranks for b in range(255)):
            return None
        ranks.setdefault(END, len(vocab) + len(self.specials))
        self.words = {raw.removesuffix(END).decode(errors="ignore") if suffix else raw.decode(errors="ignore") for raw in ranks}
        return tiktoken.Encoding("by rank", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def piece(self, word: str) -> bytes:
        """The packed ids of one pre-token."""
        if self.merge is None or len(word) > LONG_PIECE or word in self.words:
            ids = [t.id for t in self.bare.model.tokenize(byte_level(word))]
        else:
            ids = self.merge(word.encode() + END if self.suffix else word.encode())
        return b"".join(map(self.pack.__getitem__, ids))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = self.split(text)
        if pieces is not None:
            return b"".join(map(self.cache.__getitem__, pieces))
        if self.pieces is not None and self.special and self.special.search(text):
            return self.between(text)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def between(self, text: str) -> bytes:
        """Special tokens, and the texts between them by themselves."""
        out, at = [], 0
        for found in self.special.finditer(text):
            out += [self.encode(text[at : found.start()]), self.specials[found[0]].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, self.encode(text[at:])])


_kept: dict[str, Encoder] = {}
_lock = threading.Lock()


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    with _lock:
        if path not in _kept:
            _kept[path] = Encoder(path)
        return _kept[path]


def unpack(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")
