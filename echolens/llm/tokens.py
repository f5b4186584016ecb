"""Token ids of a public word-level BPE vocabulary, run by run, with the runs that a worker has seen remembered."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer


#: Split at by Python, but no white space to the vocabulary.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class _Runs(dict):
    """From a run of other characters than white space, or a word of it, to the bytes of its ids.

    A run is cut into words by the vocabulary's pattern, and each word goes through the library's BPE once, whatever
    punctuation it stands with. The memory starts anew when it is full.
    """

    def __init__(self, tokenizer: Tokenizer, pattern: regex.Pattern, dtype: np.dtype, most: int) -> None:
        super().__init__()
        self.model, self.pattern, self.dtype, self.most = tokenizer.model, pattern, dtype, most
        self.byte_names = str.maketrans(_byte_characters())

    def __missing__(self, run: str) -> bytes:
        words = (run,) if run.isalpha() else self.pattern.findall(run)
        found = b"".join(map(self.__getitem__, words)) if len(words) > 1 else self._encoded(run)
        if len(self) >= self.most:
            self.clear()
        self[run] = found
        return found

    def _encoded(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        named = word if plain else word.encode("utf-8", "replace").decode("latin-1").translate(self.byte_names)
        return np.array([token.id for token in self.model.tokenize(named)], self.dtype).tobytes()


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies name a byte by its printable Latin-1 character, the rest by those from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [byte for byte in range(256) if byte not in printable]
    return {byte: chr(256 + i) for i, byte in enumerate(others)}


class WordTokenizer:
    """Ids as the library gives them for the whole text, without special tokens added.

    Composition, lower case and the cut at white space are done here for whole texts, the words of each different run are
    looked up or made. Texts that hold the string of a special token go through it whole.
    """

    def __init__(self, path: str, most_runs: int = 1_000_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        self.special = [token["content"] for token in setup["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        pattern = setup["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space is the Unicode property, which Python's class exceeds by four control characters.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        kinds = [part["type"] for part in setup["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the vocabulary's normalizer is not the one that is followed here")
        self.runs = _Runs(self.tokenizer, self.pattern, self.dtype, most_runs)

    def ids(self, text: str) -> bytes:
        if any(token in text for token in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        # The library lowers character by character: a capital sigma never becomes a final one.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        runs = self.pattern.findall(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.runs.__getitem__, runs))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]
