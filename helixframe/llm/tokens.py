"""Token ids of a byte-level BPE file (Hugging Face `tokenizers` JSON)."""

from __future__ import annotations

import json

import regex

#: Split pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which the two libraries cannot differ by their Unicode versions.
PLAIN = regex.compile(r"[\x00-\x84\x86-ʯ̀-ͯΑ-ΡΣ-ϿЀ-ӿ‐-‧‰-⁞€]*+")


class Encoder:
    """text -> ids as `Tokenizer.encode(text, add_special_tokens=False)` gives them. With
    `added`, the strings of added tokens get their one id, as they do by default there; else they
    are read as ordinary text.

    The file is loaded by `tokenizers`. Its merges are also given to `tiktoken`, which is about
    four times as fast and gives the same ids; it takes the texts made of long-established
    characters, and all others, with `added` also those that hold an added token's string, go to
    `tokenizers`, which is loaded when the first of them comes.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        self.path, self.added, self._slow = path, added, None
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        special = {t["content"] for t in model.get("added_tokens", [])}
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if word not in special}
        self.strings = sorted(special) if added else []
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.strings):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = not self.added
        return self._slow


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, with its added tokens, built once in each process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, added=True)
    return _encoders[path]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]
