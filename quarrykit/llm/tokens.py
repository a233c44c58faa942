"""Public vocabularies: where their files are, and what is read from them once a worker."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import public_tokenizers

TIKTOKEN_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZERS_FILE = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@lru_cache(2)
def tiktoken_encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def added_tokens(path: str) -> dict[str, int]:
    """The tokens that the tokenizers library finds in a text before it splits it into words."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that match by more than their text aren't supported")
    return {t["content"]: t["id"] for t in added}


@lru_cache(2)
def text_encoder(path: str, tokenizers_path: str):
    """text to ids, as the tokenizers library's encode(text, add_special_tokens=False) gives them: added tokens are one id."""
    import tiktoken

    added = added_tokens(tokenizers_path)
    encoding = tiktoken.Encoding("public-added", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens=added)
    names = set(added)

    def encode(text: str) -> list[int]:
        if any(name in text for name in names):
            return encoding.encode(text, allowed_special=names, disallowed_special=())
        return encoding.encode_ordinary(text)

    return encode


@lru_cache(2)
def words_pattern():
    import regex

    return regex.compile(PATTERN)


@lru_cache(2)
def hf_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_ADJACENT_SPACE = re.compile(r"\s\s")


def has_adjacent_space(text: str) -> bool:
    return _ADJACENT_SPACE.search(text) is not None


def split_text(text: str) -> list[str]:
    """text cut at places where PATTERN always ends one match and begins the next.

    A space after a character that isn't white space, and before another, begins a
    match. Where white space stands side by side, the matches of PATTERN themselves
    are returned. Joined, the parts give text again, and the matches of the
    parts are those of the text."""
    if has_adjacent_space(text):
        return words_pattern().findall(text)
    first, *rest = text.split(" ")
    parts = [f" {part}" for part in rest]
    return [first, *parts] if first else parts
