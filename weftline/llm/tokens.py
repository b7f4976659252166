"""Token ids of whole texts by a public byte-level BPE file of the ``tokenizers`` library.

A byte-level BPE never merges across its pre-tokens, and a pre-token never
runs from a letter or sign into white space. Texts are therefore cut before
single spaces, the distinct pieces of a batch are encoded once, and the ids of
every text are gathered from them: the ids are those of the whole text. Texts
with other white space around spaces, or with special tokens, are encoded in
one call.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hold, ragged

END = 0
KEEP = 200_000  # words of a generation of a worker's memory, which has two; results never depend on it

_SPACE = "\\t-\\r "
_SIGNS = frozenset(",.;:!?")
_PIECES = re.compile(rf" ?[^\W\d_]+(?=[!-&(-/:-@\[-`{{-~']|$)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
# white space and blanks beyond the plain ones, on which Python and the tokenizer may differ
_ODD_SIGNS = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
# parts behind which no cut is sound, and parts with an odd sign or the mark of a special token
_LOOSE = r"\A\z|[\t-\r ]\z|<\||[" + "".join(f"\\x{{{sign:X}}}" for sign in _ODD_SIGNS) + "]"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level BPE files: printable Latin-1 as it is, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b if b in plain else 256 + others.index(b)) for b in range(256)}


class Encoder:
    """Encodes Arrow strings to flat ids with their bounds; every text ends with id 0."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters, self.words, self.old = _byte_letters(), {}, {}
        self.tokenize, self.space = self.tokenizer.model.tokenize, self.letters[32]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self.words) >= KEEP:
            # the older half goes; words that are met again move to the younger one
            self.old, self.words = self.words, {}
        self.words[word] = ids
        return ids

    def _known(self, word: str) -> bytes | None:
        ids = self.words.get(word)
        if ids is None and (ids := self.old.get(word)) is not None:
            self._keep(word, ids)
        return ids

    def _letters(self, word: str) -> bytes:
        """Ids of a run of letters behind at most one space, which is exactly one pre-token."""
        if word.isascii():
            spelled = self.space + word[1:] if word[0] == " " else word
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return self._keep(word, array("I", [t.id for t in self.tokenize(spelled)]).tobytes())

    def _word(self, word: str) -> bytes:
        known = self._known(word)
        if known is None:
            if word.lstrip(" ").isalpha() and len(word) < 64:
                return self._letters(word)
            known = self._keep(word, self.whole(word))
        return known

    def _part(self, word: str, led: str) -> bytes:
        """Ids of ``led`` (a space or nothing) and a part that holds no odd sign, met for the first time."""
        if (known := self._known(led + word)) is not None:
            return known
        if len(word) < 63:
            if word.isalpha():
                return self._letters(led + word)
            # letters and one sign behind them are two pre-tokens
            if word[-1:] in _SIGNS and word[:-1].isalpha():
                letters = led + word[:-1]
                return (self._known(letters) or self._letters(letters)) + self._word(word[-1])
        return self.part(led + word)

    def part(self, part: str) -> bytes:
        """Ids of a part that holds no odd sign."""
        return b"".join([self._word(w) for w in _PIECES(part)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.array(texts.fill_null(""), pa.large_string())
        parts = pc.split_pattern(texts, " ")
        counts = np.diff(parts.offsets.to_numpy())
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        # a cut is sound where the part before it ends with neither white space nor an odd sign
        loose = pc.match_substring_regex(coded.dictionary, _LOOSE).to_numpy(zero_copy_only=False).astype(bool)
        owner = np.repeat(np.arange(len(texts)), counts)
        odd = np.zeros(len(texts), bool)
        odd[owner[loose[codes]]] = True
        key = codes * 2
        key[firsts] += 1
        key = key[~odd[owner]]
        asked = np.zeros(2 * len(words), np.int64)
        asked[key] = 1
        used = np.flatnonzero(asked)
        asked[used] = np.arange(len(used))
        place = asked[key]
        made = []
        for k in used.tolist():
            word, led = words[k >> 1], "" if k & 1 else " "
            made.append(self.words.get(led + word) or self._part(word, led))
        made.append(array("I", [END]).tobytes())
        for i in np.flatnonzero(odd).tolist():
            made.append(self.whole(texts[i].as_py()))
        pool = np.frombuffer(b"".join(made), np.uint32)
        sizes = np.fromiter((len(m) >> 2 for m in made), np.int64, len(made))
        starts = np.cumsum(sizes) - sizes
        # the sequence of pool entries: the parts of a text (or its whole), then the end id
        per_text = np.where(odd, 1, counts) + 1
        total = int(per_text.sum())
        entry = np.full(total, len(used), np.int64)
        last = np.cumsum(per_text) - 1
        body = np.ones(total, bool)
        body[last] = False
        whole_at = (last - 1)[odd]
        entry[whole_at] = len(used) + 1 + np.arange(int(odd.sum()))
        body[whole_at] = False
        entry[body] = place
        entry_sizes = sizes[entry]
        ids = pool[ragged(starts[entry], entry_sizes)]
        ends = np.cumsum(entry_sizes)[last] if total else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], ends]).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; its word memory lives on between batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        hold("tokens", _ENCODERS.clear)
    return _ENCODERS[path]


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
