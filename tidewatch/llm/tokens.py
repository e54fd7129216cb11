"""Token ids of whole texts, many texts at a time, by a public tokenizer file.

The tokenizer drops white space and cuts the rest into pieces by a rule; its model
encodes each piece by itself. Arrow makes the cut for a batch of texts and finds the
distinct pieces; ids of pieces are kept in a bounded cache. Texts for which the rule
does not hold to the letter (beyond Latin-1, or with what may be a special token) are
encoded whole by the tokenizer.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that the cache of a Python worker may hold; beyond it the cache starts afresh.
CACHE_PIECES = 700_000
#: ASCII and the letters of Latin-1: each stays as it is under NFC, and lower case is letter by letter.
_PLAIN = r"\A[ \t\r\n!-~À-ÖØ-öø-ÿ]*\z"
#: The tokenizer's own rule for these letters.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenIds:
    """`encode(texts)`: the ids of all texts on end (uint16), and where each text's begin."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary does not fit 16 bits")
        self._model, self._letters = self.tokenizer.model, _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {"": 0}
        self._ids, self._filled = np.zeros(1 << 20, np.uint16), 0
        self._ends = np.zeros(1 << 18, np.int64)  # of piece n, at n + 1; piece 0 is empty

    def _learn(self, pieces: list[str]) -> None:
        found: list[int] = []
        ends: list[int] = []
        for p in pieces:
            seen = p if p.isascii() else p.encode().decode("latin-1").translate(self._letters)
            found += [t.id for t in self._model.tokenize(seen)]
            ends.append(self._filled + len(found))
        first = len(self._number)
        self._number.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        while self._filled + len(found) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while first + len(pieces) + 1 > len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
        self._ids[self._filled:self._filled + len(found)] = found
        self._ends[first + 1:first + 1 + len(pieces)] = ends
        self._filled += len(found)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`texts`: strings, null for the empty text. Text n has ids[at[n]:at[n + 1]]."""
        texts = pc.fill_null(texts, "")
        plain = pc.and_(pc.match_substring_regex(texts, _PLAIN), pc.invert(pc.match_substring(texts, "<|")))
        if pc.all(plain).as_py() is not False:
            return self._encode_plain(texts)
        of_plain, at_plain = self._encode_plain(texts.filter(plain))
        parts, sizes, n = [], [], 0
        for text, easy in zip(texts.to_pylist(), plain.to_pylist(), strict=True):
            if easy:
                parts.append(of_plain[at_plain[n]:at_plain[n + 1]])
                n += 1
            else:
                parts.append(np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16))
            sizes.append(len(parts[-1]))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 0:
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        if len(self._number) > CACHE_PIECES:
            self._clear()
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _PIECE, r"\0 "))
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = list(map(self._number.get, words))
        if None in known:
            self._learn([w for w, k in zip(words, known, strict=True) if k is None])
            known = list(map(self._number.__getitem__, words))
        piece = np.asarray(known, np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        start, size = self._ends[piece], self._ends[piece + 1] - self._ends[piece]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self._ids[np.arange(total) + np.repeat(start - end + size, size)]
        per_text = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return ids, np.concatenate([[0], end])[per_text]


_READY: dict[tuple, TokenIds] = {}


def token_ids(path: str, special_as_text: bool = False) -> TokenIds:
    """One per Python worker."""
    key = (path, special_as_text)
    if key not in _READY:
        _READY.clear()
        _READY[key] = TokenIds(*key)
    return _READY[key]
