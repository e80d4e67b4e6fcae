"""Token ids of whole texts, by tables of pieces.

A text is cut where the tokenizer's own pre-tokenization always cuts; each different piece is encoded once by the
tokenizers library and kept in a bounded table as bytes, so a text's ids are a join of table entries. The result is the
same as encoding the text in one call, which the tests check. Where to cut depends on the tokenizer's kind:

* byte-level BPE: before a space or a line end that follows a character other than white space, and after a line end
  that one such character follows. A text in which white space follows white space is cut by a regular expression.
* BPE with word ends, white space dropped: at spaces and line ends.
* both: between a letter and a mark, where one run of letters ends and one of marks begins.

A new piece that is Latin letters, with at most a space before, is one pre-token, so it goes straight to the library's BPE
model; any other piece goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hushframe.llm.common import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces in a table, after which it is emptied; only memory depends on it (about 170 bytes each). Longer pieces aren't kept.
TABLE, LONGEST = 700_000, 32
#: Bytes of texts that are cut at once.
CHARS = 4 << 20
#: White space (as Python's \\s has it) that follows white space, or a zero, for Arrow's regular expressions.
_ODD = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|\x00"
_PIECES = re.compile(r"\s*\S+|\s+")
#: Letters that composition leaves alone and whose lower case is one letter of the same kind.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Such a letter and a mark behind it, for Arrow's regular expressions.
_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?#$%&*])"


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes bytes: printable ones as themselves, the others as the letters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


class Encoder:
    """Ids as bytes of dtype: little-endian (the machine's own order on all that Spark runs on), of 16 bits if the vocabulary allows, else of 32."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.byte_level = kind == "ByteLevel"
        self.dtype, self.kind = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.table: dict[str, bytes] = {}
        self.most: int | None = None  # a bound on the table in place of TABLE
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _add(self, pieces: set[str]) -> None:
        """Encodes pieces into the table."""
        others, table, tokenize, match, kind = [], self.table, self.model.tokenize, _WORD.fullmatch, self.kind
        for p in pieces:
            if match(p) is None:
                others.append(p)
                continue
            word = p
            if not self.byte_level:
                word = p.lower()
                if word is not p and word in table:
                    table[p] = table[word]
                    continue
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            elif word[0] == " ":
                word = self.letters[32] + word[1:]
            table[p] = array(kind, [t.id for t in tokenize(word)]).tobytes()
        table.update(zip(others, self._whole(others)))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each text's pieces begin (and the last one's end) among all pieces, and the pieces."""
        if not self.byte_level:
            lists = pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(texts, _MARK, r"\1 \2"), "\n", " "), " ")
            return lists.offsets.to_numpy(), lists.flatten()
        parts = pc.replace_substring_regex(texts, _MARK, "\\1\0\\2")
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(parts, "\n", "\0\n\0"), " ", "\0 "), "\0")
        odd = pc.match_substring_regex(texts, _ODD)
        if not pc.any(odd).as_py():
            return lists.offsets.to_numpy(), lists.flatten()
        found = pa.array([_PIECES.findall(t) if o else [] for t, o in zip(texts.to_pylist(), odd.to_pylist())], pa.list_(pa.string()))
        lists = pc.if_else(odd, found, lists)
        return lists.offsets.to_numpy(), lists.flatten()

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text, without special tokens; null: none. Texts are worked on some at a time, by their different pieces."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        sizes, out, at = pc.binary_length(texts).to_numpy(zero_copy_only=False), [], 0
        while at < len(texts):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), CHARS, "right")))
            out += self._encode(texts.slice(at, to - at))
            at = to
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        begins, pieces = self._cut(texts)
        coded = pieces.dictionary_encode()
        kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # all in one call, where to_pylist makes an object a value first
        missing = set(kinds).difference(self.table)
        if len(self.table) + len(missing) > (self.most or TABLE):
            self.table.clear()
            missing = set(kinds)
        self._add(missing)
        ids = pa.array(map(self.table.__getitem__, kinds), pa.large_binary(), size=len(kinds)).take(coded.indices)
        for p in missing:
            if len(p) > LONGEST:
                del self.table[p]
        if not len(ids):
            return [b""] * len(texts)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        data, cuts = memoryview(ids.buffers()[2] or b""), ends[begins - begins[0]].tolist()
        return [bytes(data[a:z]) for a, z in zip(cuts, cuts[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drops a worker's encoders and their tables, where what follows needs none."""
    _encoders.clear()
    give_back()


def default_path(name: str) -> str:
    """A vocabulary file of the machine's public tokenizers; on other machines, give operators a path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)
