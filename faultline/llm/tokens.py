"""Encoding with a public tokenizer whose pre-tokenisation drops white space.

Such a tokenizer treats the chunks between white space apart, so the ids of a chunk are kept in a bounded table and a text costs one look-up a
chunk. Chunks that aren't in the table are encoded together, those of Latin letters by the same merges in a faster library: a byte
that can't occur stands for the end of a word, and joining it to the last letter comes before all other merges. Other
chunks, and texts with the control characters \\x1c-\\x1f, on which Python and the tokenizer differ about white space, go
to the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Chunks kept at most; the table is emptied beyond that.
KEPT = 800_000
_ODD = re.compile("[\x1c-\x1f]")
_END = b"\x00"


def _byte_alphabet() -> list[str]:
    """The character that byte-level BPE writes for each byte: printable ones stand for themselves, others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Latin:
    """The model's merges for words of Latin letters and ASCII."""

    def __init__(self, model: dict):
        import tiktoken

        alphabet = _byte_alphabet()
        byte = {c: bytes([b]) for b, c in enumerate(alphabet)}

        def raw(token: str) -> bytes:
            end = token.endswith("</w>")
            return b"".join(byte[c] for c in (token[:-4] if end else token)) + _END * end

        vocab, ranks, ids = model["vocab"], {}, {}
        for b, c in enumerate(alphabet):
            ranks[bytes([b]) + _END], ids[b] = b, vocab[c + "</w>"]
        for k, pair in enumerate(model["merges"], 256):
            token = "".join(pair) if isinstance(pair, list) else pair.replace(" ", "", 1)
            ranks[raw(token)], ids[k] = k, vocab[token]
        last = 256 + len(model["merges"])
        for b, c in enumerate(alphabet):
            ranks[bytes([b])], ids[last + b] = last + b, vocab[c]
        self.ids = np.zeros(last + 256, "<u4")
        self.ids[list(ids)] = list(ids.values())
        self.blank = ranks[b" "]
        self.core = tiktoken.Encoding("words", pat_str=r" |[^\x00 ]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("[^\x01-ɏ]|[²³¹¼½¾]|<[|]")
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Chunks without `odd`; one blank between them marks where each ends."""
        marked = self.split.sub("\\g<0>\0", " ".join(chunks).lower()) + " "
        ranks = np.array(self.core.encode_ordinary(marked), np.int64)
        data, start, out = self.ids[ranks].tobytes(), 0, []
        for stop in (4 * np.flatnonzero(ranks == self.blank)).tolist():
            out.append(data[start:stop])
            start = stop + 4
        return out


def encoder(tokenizer: str = TOKENIZER) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit numbers. tokenizer: a name for public_tokenizers, or a path."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)
    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        latin = _Latin(json.load(f)["model"])
    table: dict[str, bytes] = {}

    def plain(text: str) -> bytes:
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(chunks: list[str]) -> dict[str, bytes]:
        quick = [c for c in chunks if not latin.odd.search(c)]
        new = dict(zip(quick, latin.encode(quick))) if quick else {}
        for c in chunks:
            if c not in new:
                new[c] = plain(c)
        if len(table) + len(new) > KEPT:
            table.clear()
        table.update((c, x) for c, x in new.items() if len(c) <= 64)
        return new

    def encode(text: str) -> bytes:
        if _ODD.search(text):
            return plain(text)
        chunks = text.split()
        found = list(map(table.get, chunks))
        if None in found:
            new = learn(list(dict.fromkeys([c for c, x in zip(chunks, found) if x is None])))
            found = [new[c] if x is None else x for c, x in zip(chunks, found)]
        return b"".join(found)

    return encode
