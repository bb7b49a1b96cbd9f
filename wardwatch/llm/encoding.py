"""Token ids of whole texts by a public tokenizer, with a memo of chunks where that is exact."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np

MEMO_CHUNKS = 500_000  # seen twice or more that a worker remembers
NEW_CHUNKS = 400_000  # seen once; when they are full they are forgotten, so that rare chunks never push out frequent ones
TOGETHER = 500_000  # characters of the texts that are looked up at once
LONG_CHUNK = 64  # longer chunks are not remembered
# Letters of one piece with the blank before them (or digits), then marks that are a piece of their own, perhaps after a line feed.
WORD = re.compile(r"(\n?)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+|[0-9]+)([.,;:!?*&%$#@~^|+=<>()\[\]{}\"/_-]*)")
# How a byte-level vocabulary writes bytes: printable ones stand for themselves, the others are numbered from 256 on.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
WRITTEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def version_digest(path: str) -> str:
    """What decides a tokenizer's output: the library, its release and the file's bytes."""
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(f"{library.__name__} {library.__version__} {content}".encode()).hexdigest()


class Memo(dict):
    """Ids of chunks; what is not there is asked of ``missing``, which may store it."""

    def __init__(self, missing):
        super().__init__()
        self.missing = missing

    def __missing__(self, chunk: str) -> bytes:
        return self.missing(chunk)


class Encoder:
    """``ids(text)``: the library's ids as little-endian unsigned 32-bit bytes, without begin or end tokens.

    A byte-level pre-tokenizer never joins a blank that stands before another character with what precedes it, and it
    merges nothing across its pieces. So a text whose blanks (U+0020) are all followed by a character that is no
    white space can be cut in front of them, and each chunk has the same ids wherever it stands; so can a line feed
    between two such characters, which is a piece of its own. Other texts, and other kinds of tokenizer, are encoded whole.
    Equal texts that are given together are encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo = Memo(self.learn)
        self.new: dict[str, bytes] = {}
        self.unsafe = False  # whether the text at hand has a chunk at which it can't be cut
        self.by_chunk = False
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: processor.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            self.by_chunk = cuts_at_blanks(spec)
            self.model = tokenizer.model
            self.marks: dict[str, bytes] = {}
            self.written = [i.to_bytes(4, "little") for i in range(max(spec["model"]["vocab"].values()) + 1)] if self.by_chunk else []

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(ids, dtype="<u4").tobytes() for ids in self.encode(texts)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new chunks of several texts are encoded together."""
        if not self.by_chunk:
            return self.whole(texts)
        distinct = list(dict.fromkeys(texts))
        out: dict[str, bytes] = {}
        held, size = [], 0
        for text in distinct:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                out.update(zip(held, self.joined(held)))
                held, size = [], 0
        out.update(zip(held, self.joined(held)))
        return [out[text] for text in texts]

    def joined(self, texts: list[str]) -> list[bytes]:
        split = [text.replace("\n", " \n").split(" ") for text in texts]
        firsts = self.whole([parts[0] for parts in split])
        out, get = [], self.memo.__getitem__
        for text, parts, first in zip(texts, split, firsts):
            self.unsafe = False
            ids = list(map(get, parts[1:]))
            out.append(self.whole([text])[0] if self.unsafe else first + b"".join(ids))
        return out

    def learn(self, chunk: str) -> bytes:
        """Ids of a chunk that is not in the memo, with the blank in front of it (a line feed stands for itself)."""
        ids = self.new.pop(chunk, None)
        if ids is not None:  # the second sight
            if len(self.memo) >= MEMO_CHUNKS:
                self.memo.clear()
            self.memo[chunk] = ids
            return ids
        ids = self.made(chunk)
        if ids:
            self.remember(chunk, ids)
        else:  # not remembered, so that it is noticed each time
            self.unsafe = True
        return ids

    def remember(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= LONG_CHUNK:
            if len(self.new) >= NEW_CHUNKS:
                self.new.clear()
            self.new[chunk] = ids

    def made(self, chunk: str) -> bytes:
        parts = WORD.fullmatch(chunk)
        if parts is None:
            word = chunk[1:] if chunk[:1] == "\n" else chunk
            if not word or word[0].isspace():
                return b""  # a text can't be cut here
            return self.whole([chunk if word is not chunk else " " + chunk])[0]
        feed, stem, marks = parts.groups()
        if not marks:
            return self.piece("\n") + self.piece(stem) if feed else self.piece(" " + stem)
        key = feed + stem
        ids = self.memo.get(key) or self.new.get(key)
        if ids is None:
            ids = self.made(key)
            self.remember(key, ids)
        after = self.marks.get(marks)
        if after is None:
            after = self.piece(marks)
            if len(marks) <= LONG_CHUNK and len(self.marks) < NEW_CHUNKS:
                self.marks[marks] = after
        return ids + after

    def piece(self, text: str) -> bytes:
        """Ids of what the pre-tokenizer leaves in one piece: the model's alone."""
        if text.isascii():  # printable but for these two
            text = text.replace(" ", "\u0120").replace("\n", "\u010a")
        else:
            text = text.encode().decode("latin-1").translate(WRITTEN)
        written = self.written
        return b"".join([written[t.id] for t in self.model.tokenize(text)])


def cuts_at_blanks(spec: dict) -> bool:
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    added = all(
        not any(ch.isspace() for ch in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"])
        for t in spec.get("added_tokens") or []
    )
    return bool(plain and added and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("dropout"))
