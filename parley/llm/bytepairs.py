"""Byte-level BPE ids of whole texts, for the operators that count or pack tokens.

The pattern that splits a text never takes a space into the end of a match unless more white space follows, so a text
without two spaces in a row splits at every space; each part's ids are made once and remembered.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from parley.llm.wordtable import BYTES_KEPT, WORDS_KEPT, Known, Strings


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file and their ids: a text is split at them before anything else."""
    with open(json_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t[flag] for t in found for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match as they stand are supported")
    return {t["content"]: t["id"] for t in found}


class TextIds:
    """Ids of texts by a rank file (fewer than 65,536 ids). The added tokens have ids of their own; without them their
    strings in a text are ordinary text."""

    def __init__(self, ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = dict(added)
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if added else None
        self.known, self.ids = Known(), Strings(np.uint16)

    def parts(self, text: str) -> list:
        """A part is a string with a space before it, a tuple of one string that has none, or an added token's id."""
        if self.split and any(t in text for t in self.added):
            return [x for k, part in enumerate(self.split(text)) for x in ([self.added[part]] if k % 2 else self.plain_parts(part))]
        return self.plain_parts(text)

    def plain_parts(self, text: str) -> list:
        if "  " in text:
            return [(text,)]
        first, *rest = text.split(" ")
        return [(first,), *rest]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin and end."""
        if len(self.known) > WORDS_KEPT or self.ids.used > BYTES_KEPT:
            self.known, self.ids = Known(), Strings(np.uint16)
        get = self.known.__getitem__
        found = [np.fromiter(map(get, w), np.int64, len(w)) for w in map(self.parts, texts)]
        fresh, self.known.fresh = self.known.fresh, []
        made = [[x] if isinstance(x, int) else self.encode(x[0] if isinstance(x, tuple) else " " + x) for x in fresh]
        sizes = np.array([len(x) for x in made], np.int64)
        self.ids.add(np.fromiter(chain.from_iterable(made), np.uint16, int(sizes.sum())), sizes)
        return self.ids.joined(np.concatenate([np.zeros(0, np.int64), *found]), np.array([len(x) for x in found], np.int64))


@lru_cache(2)
def text_ids(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> TextIds:
    """One for each Python worker, so that later tasks find the parts of earlier ones."""
    return TextIds(ranks_path, pattern, added)
