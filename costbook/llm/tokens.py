"""Token ids of whole texts, by a vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# The word rule of vocabularies that drop white space and never look across it.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same rule for texts of ASCII and Latin-1 letters only, in lower case.
PLAIN_RULE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
NOT_PLAIN = re.compile("[^ -~\nÀ-ÖØ-öø-ÿ]")


class Encoder:
    """Ids of texts without special tokens, equal to those of one call with each whole text.

    A vocabulary whose word rule drops white space treats every word by itself.  For it, texts are
    cut into words here, and the library's model encodes each distinct word once; at most ``keep``
    words are remembered.  Chunks with characters beyond ASCII and Latin-1 letters, or with a special token's
    string, go to the library as they are; so do whole texts with any other vocabulary.
    Null counts as empty.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep = keep
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        normal = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        first = steps[0]
        self.by_word = (first.get("pattern", {}).get("Regex"), first.get("behavior"), first.get("invert"), steps[-1].get("type"), normal) == (
            WORD_RULE, "Removed", True, "ByteLevel", ["NFC", "Replace", "Lowercase"])
        # the model sees a letter beyond ASCII as the two signs that stand for its bytes
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {i: bytewise.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        self.special = [x["content"] for x in rules["added_tokens"]]

    def _odd(self, text: str) -> bool:
        return NOT_PLAIN.search(text) is not None or any(x in text for x in self.special)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Adds the words that are not known; a blank in front marks a chunk that is encoded as it is."""
        fresh = set(pieces).difference(self.words)
        if len(self.words) + len(fresh) > self.keep:
            self.words.clear()
            fresh = set(pieces)
        for p in fresh:
            self.words[p] = self._whole(p[1:]) if p[0] == " " else np.array(
                [x.id for x in self.model.tokenize(p if p.isascii() else p.translate(self.signs))], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_word:
            return self._whole(text)
        if not self._odd(text):
            pieces = PLAIN_RULE.findall(text.lower())
        else:
            pieces = []
            for chunk in text.replace("\n", " ").split(" "):
                if self._odd(chunk):
                    pieces.append(" " + chunk)
                else:
                    pieces += PLAIN_RULE.findall(chunk.lower())
        try:
            return b"".join(map(self.words.__getitem__, pieces))
        except KeyError:
            self._learn(pieces)
            return b"".join(map(self.words.__getitem__, pieces))


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which keeps its words from task to task."""
    return Encoder(path)
