"""Encoders of public vocabularies: the ids of whole texts, as their own libraries give them.

Two of them go a faster way, through the same merges in tiktoken, where every character's
class and case is the same in all versions of Unicode. Texts fall apart at white space
where no merge reaches across, so that the rest alone goes through the vocabulary's own
library. Tests hold the ids against those of the library for whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np

#: Words that an encoder remembers, characters of the longest one, and characters that are encoded at once.
REMEMBERED, LONG, PIECE = 100_000, 64, 1 << 20
_PLAIN_SET = "\t\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[{_PLAIN_SET}]*")
#: White space beside blanks, tabs and line feeds, and what some library takes for it: such a text isn't cut.
_OTHER_SPACE = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_STARTS = re.compile(r"(?<=[^ \t\n])[ \t\n]")


def _cut(text: str) -> Iterator[str]:
    """text in pieces of PIECE characters or little more, cut where white space starts."""
    i = 0
    while len(text) - i > PIECE and (m := _STARTS.search(text, i + PIECE)):
        yield text[i : m.start()]
        i = m.start()
    yield text[i:] if i else text


def _packed(ids: list[int]) -> bytes:
    """Little-endian, four bytes an id."""
    return array("I", ids).tobytes()


class Parted:
    """A vocabulary of `tokenizers` and the faster way for what is plain; words that aren't are remembered."""

    def __init__(self, path: str, special: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        self.special = {x.content for x in self._tokenizer.get_added_tokens_decoder().values()}
        self.vocabulary = self._tokenizer.get_vocab()
        marks = "|".join(map(re.escape, self.special)) if special else "(?!)"
        self._marks = re.compile(marks)
        self._other = re.compile(f"[ \t\n]*[^ \t\n]*(?:[^{_PLAIN_SET}]|{marks})[^ \t\n]*")
        self._known: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        return _packed(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _word(self, word: str) -> bytes:
        found = self._known.get(word)
        if found is None:
            found = self.whole(word)
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            if len(word) <= LONG:
                self._known[word] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        plain = _PLAIN.fullmatch(text) is not None and not self._marks.search(text)
        if not plain and _OTHER_SPACE.search(text):
            return np.frombuffer(self.whole(text), "<u4")
        out = []
        for t in _cut(text):
            if plain:
                out.append(self.plain(t))
                continue
            at = 0
            for m in self._other.finditer(t):
                out += [self.plain(t[at : m.start()]), self._word(m[0])]
                at = m.end()
            out.append(self.plain(t[at:]))
        return np.frombuffer(b"".join(out), "<u4")


def _byte_alphabet() -> dict[str, int]:
    """Character that stands for a byte in a byte-level vocabulary -> the byte: printable Latin-1 for itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordBpe(Parted):
    """A vocabulary that drops white space. Special tokens in a text count as such.

    In tiktoken a line feed stands for the mark of a word's last character, which is joined
    to it before any other merge.
    """

    _WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z\u00df-\u00f6\u00f8-\u00ff0-9]+")

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__(path, special=True)
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in x.removesuffix("</w>")) + b"\n" * x.endswith("</w>"): i for x, i in self.vocabulary.items() if x not in self.special}
        self._fast = tiktoken.Encoding("words", pat_str="[^\n]*\n", mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        words = self._WORDS.findall(text.lower())
        return _packed(self._fast.encode_ordinary("\n".join([*words, ""]))) if words else b""


class ByteBpe(Parted):
    """A byte-level vocabulary; bytes_of[id] are a token's bytes. Special tokens in a text are plain text."""

    #: Fixed: the pattern of the vocabulary's words.
    _WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__(path, special=False)
        alphabet = _byte_alphabet()
        self.bytes_of = [b""] * (max(self.vocabulary.values()) + 1)
        for x, i in self.vocabulary.items():
            self.bytes_of[i] = x.encode() if x in self.special else bytes(alphabet[c] for c in x)
        ranks = {self.bytes_of[i]: i for x, i in self.vocabulary.items() if x not in self.special}
        self._fast = tiktoken.Encoding("bytes", pat_str=self._WORDS, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return _packed(self._fast.encode_ordinary(text))


class PieceBpe:
    """A vocabulary of pieces with byte fallback, which puts a space before a text; bytes_of as above."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes_of = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("\u2581", " ").encode() for x in pieces]
        self._encode: Callable[[str], list[int]] = lambda text: m.encode(text, num_threads=1)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a space, which the model adds, and text."""
        return np.array(self._encode(text), "<u4")
