"""Encoding by the tokenizers library, word by word, in Arrow arrays.

Both vocabularies used here split a text into pieces that are encoded on their own. A cut is made only where a border between
pieces is certain, so the ids of the words in a row are the ids of the text. Arrow splits a batch of texts into words and numbers the distinct ones; each
worker remembers the ids of words (a bounded number; common ones stay), and what it has not seen goes to the library in a few calls.
Texts with a special string of the vocabulary are encoded whole.

- "before_space": byte-level pieces that carry the space before them; one or two line breaks between characters that are not
  white space are a piece each. Texts with other runs of white space are encoded whole.
- "white_space": a vocabulary with word ends that drops white space; words are what stands between spaces and line breaks.

Special strings of the vocabulary in a text become their ids, as the library does unless told otherwise;
special_strings=False encodes them as ordinary text.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of Unicode but for LF, in RE2 syntax: fixed value.
BLANK = r"[\t\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Where cuts of byte-level pieces are not certain, or a text is empty.
UNSAFE = rf"^[ \n]|[ \n]$|^$|{BLANK}[ \n]|[ \n]{BLANK}|\n\n\n"
#: A space (start of a text), a line break or nothing; letters whose normal form and lower case are one code point each; signs.
PLAIN = r"^(?P<lead>[ \n]?)(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[.,;:!?]*)$"
#: Words that a worker remembers, some 40 bytes each.
REMEMBERED = 300_000
MARK = "~"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write bytes as characters: printable ones as themselves, the others from 256 on.
BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cut: str, special_strings: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if cut not in ("before_space", "white_space"):
            raise ValueError(f"unknown cut {cut!r}")
        self.tokenizer, self.by_words = Tokenizer.from_file(path), cut == "white_space"
        self.tokenizer.encode_special_tokens = not special_strings
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Words of letters are pieces already: the vocabulary's own model, without the search for pieces.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        (self.mark,) = self.model.encode(MARK, add_special_tokens=False).ids
        nothing = pa.array([], pa.string()), pa.array([], pa.binary())
        self.memory = dict.fromkeys(("letters", "signs", "others"), nothing)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str], per_call: int = 256) -> list[bytes]:
        """ids of words of letters, which may begin with the sign for a space; by the model, with a mark between them."""
        space = "" if self.by_words else "Ġ"
        shown = [w if (bare := w.removeprefix(space)).isascii() else w[: len(w) - len(bare)] + "".join(map(BYTES.__getitem__, bare.encode())) for w in words]
        groups = [shown[i : i + per_call] for i in range(0, len(shown), per_call)]
        out: list[bytes] = []
        for group, e in zip(groups, self.model.encode_batch_fast([f" {MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            data = array("I", e.ids)
            marks = (4 * np.flatnonzero(np.frombuffer(data, "<u4") == self.mark)).tolist()
            data = data.tobytes()
            out += [data[a:b] for a, b in zip([0, *(m + 4 for m in marks)], [*marks, len(data)], strict=True)]
            if len(marks) != len(group) - 1:
                raise ValueError("the mark is part of a word")
        return out

    def _coded(self, kind: str, words: pa.Array, learn: Callable[[list[str]], list[bytes]]) -> pa.Array:
        """ids of words; what the memory of this kind does not hold is learnt. A full memory keeps what these words use."""
        d = words.dictionary_encode()
        names, (known, ids) = d.dictionary, self.memory[kind]
        place = pc.index_in(names, value_set=known)
        absent = place.is_null()
        missing = names.filter(absent)
        place = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            held = ~absent.to_numpy(zero_copy_only=False)
            if len(known) + len(missing) > REMEMBERED:
                used = np.sort(place[held])
                known, ids = known.take(pa.array(used)), ids.take(pa.array(used))
                place[held] = np.searchsorted(used, place[held])
            place[~held] = np.arange(len(known), len(known) + len(missing))
            known, ids = pa.concat_arrays([known, missing]), pa.concat_arrays([ids, pa.array(learn(missing.to_pylist()), pa.binary())])
            self.memory[kind] = known, ids
        return ids.take(pa.array(place)).take(d.indices)

    def _distinct_words(self, words: pa.Array) -> pa.Array:
        """ids of distinct words: as they stand after a space, with LF in front after a line break, with a space in front at the start of a text."""
        parts = pc.extract_regex(words, PLAIN)
        plain = parts.is_valid()
        n = pc.sum(plain).as_py() or 0
        found = parts.filter(plain)
        lead, stem, signs = (found.field(k) for k in range(3))
        if self.by_words:
            shown = pc.utf8_lower(stem)
        else:
            shown = pc.binary_join_element_wise(pc.if_else(pc.equal(lead, ""), "Ġ", ""), stem, "")
        tail = self._coded("signs", signs, self._whole)
        broken = self._whole(["\n"])[0]
        head = pc.if_else(pc.equal(lead, "\n"), pa.scalar(broken, pa.binary()), pa.scalar(b"", pa.binary()))
        ids = pc.binary_join_element_wise(head, self._coded("letters", shown, self._pieces), tail, pa.scalar(b"", pa.binary()))
        if n == len(words):
            return ids

        def learn(rest: list[str]) -> list[bytes]:
            return self._whole(rest if self.by_words else [w[1:] if w[:1] == " " else w if w[:1] == "\n" else " " + w for w in rest])

        other = self._coded("others", words.filter(pc.invert(plain)), learn)
        mask = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), np.int64)
        place[mask], place[~mask] = np.arange(n), np.arange(n, len(words))
        return pa.concat_arrays([ids, other]).take(pa.array(place))

    def _by_words(self, texts: pa.Array) -> pa.Array:
        broken = pc.replace_substring(texts, "\n", " " if self.by_words else " \n")
        lists = pc.split_pattern(broken, " ")
        words, offsets = lists.flatten(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        if not self.by_words:  # the first word of a text has no space before it
            first = pc.binary_join_element_wise(" ", words.take(pa.array(offsets[:-1])), "")
            words = pa.concat_arrays([words, first])
        coded = words.dictionary_encode()
        place = coded.indices.to_numpy()
        if not self.by_words:
            n = int(offsets[-1])
            place = place.copy()
            place[offsets[:-1]] = place[n:]
            place = place[:n]
        out = self._distinct_words(coded.dictionary).take(pa.array(place))
        ends = np.frombuffer(out.buffers()[1], np.int32)[out.offset : out.offset + len(out) + 1]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends[offsets])), out.buffers()[2]])

    def encode_array(self, texts: pa.Array, part_bytes: int = 4_000_000) -> list[pa.Array]:
        """Binary arrays with the ids of the texts in order; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        out = []
        for part in slices(texts, part_bytes):
            odd = pc.equal(part, "") if self.by_words else pc.match_substring_regex(part, UNSAFE)
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(part, s))
            n = pc.sum(odd).as_py()
            if not n:
                out.append(self._by_words(part))
                continue
            whole = pa.array(self._whole(part.filter(odd).to_pylist()), pa.binary())
            if n == len(part):
                out.append(whole)
                continue
            both = pa.concat_arrays([self._by_words(part.filter(pc.invert(odd))), whole])
            mask = odd.to_numpy(zero_copy_only=False)
            place = np.empty(len(part), np.int64)
            place[~mask], place[mask] = np.arange(len(part) - n), np.arange(len(part) - n, len(part))
            out.append(both.take(pa.array(place)))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [ids for part in self.encode_array(pa.array(texts, pa.string())) for ids in part.to_pylist()]


def slices(texts: pa.Array, part_bytes: int) -> list[pa.Array]:
    """The array in runs of about part_bytes, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(texts):
        before = int(size[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + part_bytes, "right")))
        out.append(texts.slice(at, end - at))
        at = end
    return out


@lru_cache(maxsize=4)
def encoder(path: str, cut: str, special_strings: bool = True) -> Encoder:
    """One per worker process, kept between tasks."""
    return Encoder(path, cut, special_strings)
