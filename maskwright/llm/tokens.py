"""Token ids of a word-level BPE (``tokenizers``), by encoding every distinct word once.

The vocabulary's normaliser works character by character and neither white space nor
the place where a letter and a punctuation mark meet lies inside a pre-token, so the
ids of a text are the ids of its chunks between those, one after another.  A worker
encodes each chunk it has not met in a batch call of the library and keeps the ids'
bytes; the memory for that is bounded.  Texts are put together by array operations.
Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Bytes that are printable Latin-1 characters stand for themselves, the others for U+0100 and up.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in _PRINTABLE else chr(next(spare)) for b in range(256)]


#: Chunks that a worker remembers; beyond it, those not met again since are forgotten at the next turn.
REMEMBERED = 150_000
#: A longer chunk is encoded, but not remembered.
LONGEST = 64
#: A control character, which is a token by itself between blanks.
MARK = "\x01"
#: Appended to every document.
END_ID = 1

def vocabulary(name: str) -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


WORD_BPE = "word_bpe_49k.json"


#: ASCII characters that are neither letters, digits nor blanks; the apostrophe, which the split pattern may leave with letters, is none of them.
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
#: Words that normalisation leaves alone but for their case, and that the split pattern leaves whole: letters up to U+00FF, or marks.
_PLAIN = f"^(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[{re.escape(_MARKS)}]+)$"
#: By byte: whether it is a mark.
_IS_MARK = np.array([chr(b) in _MARKS for b in range(256)])
#: By byte: whether it is an ASCII letter; whether it is the second of a letter up to U+00FF whose first is ``_LATIN``.
_IS_LETTER = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
_IS_SECOND = np.array([0x80 <= b < 0xC0 and b not in b"\x97\xb7" for b in range(256)])
_LATIN = 0xC3
#: Bytes that are searched for marks at once.
_WINDOW = 16 << 20


def _cuts(body: np.ndarray) -> np.ndarray:
    """Where in UTF-8 bytes a letter up to U+00FF and a mark meet."""
    table = _IS_MARK.tobytes()
    found = []
    for at in range(0, len(body), _WINDOW):
        marks = np.flatnonzero(np.frombuffer(body[at : at + _WINDOW].tobytes().translate(table), bool))
        # from two bytes before the window to two after it; blanks stand for those that are not there
        low, high = max(at - 2, 0), min(at + _WINDOW + 2, len(body))
        wide = np.pad(body[low:high], (2 - (at - low), 2), constant_values=0x20)
        before, after = wide[marks + 1], wide[marks + 3]
        ends = _IS_LETTER[before] | _IS_SECOND[before] & (wide[marks] == _LATIN)
        starts = _IS_LETTER[after] | (after == _LATIN) & _IS_SECOND[wide[marks + 4]]
        found += [at + marks[ends], at + marks[starts] + 1]
    cuts = np.concatenate(found or [np.zeros(0, np.int64)])
    cuts.sort()
    return cuts


def _parted(texts: pa.Array) -> pa.Array:
    """Texts without nulls, with a blank wherever a letter up to U+00FF and a mark meet.

    No token of the split pattern holds both, so the ids are the same; but fewer distinct words are left.
    """
    large = pa.types.is_large_string(texts.type)
    width = np.int64 if large else np.int32
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    edge = np.frombuffer(places, width, len(texts) + 1, texts.offset * np.dtype(width).itemsize)
    body = np.frombuffer(data, np.uint8)[: edge[-1]]
    cuts = _cuts(body)
    if not len(cuts) or len(body) + len(cuts) > np.iinfo(width).max:
        return texts
    edge = edge + np.searchsorted(cuts, edge, side="right").astype(width)
    return (pa.LargeStringArray if large else pa.StringArray).from_buffers(len(texts), pa.py_buffer(edge), pa.py_buffer(np.insert(body, cuts, 0x20)))


def _lowered(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case, null ones empty (``pc.ascii_lower`` does not mind a slice's offset)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    width = np.int64 if large else np.int32
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    edge = np.frombuffer(places, width, len(texts) + 1, texts.offset * np.dtype(width).itemsize)
    body = pa.py_buffer(data[int(edge[0]) : int(edge[-1])].to_pybytes().lower())
    return (pa.LargeStringArray if large else pa.StringArray).from_buffers(len(texts), pa.py_buffer(edge - edge[0]), body)


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the same merges without normaliser and split pattern, for words that need neither
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: By id: whether it ends a word, if the vocabulary marks the ends of words.
        self.ends = None
        if suffix := self.tokenizer.model.end_of_word_suffix:
            names = self.merges.get_vocab()
            self.ends = np.zeros(max(names.values()) + 1, bool)
            self.ends[[i for name, i in names.items() if name.endswith(suffix)]] = True
        #: Bytes, as Latin-1 characters, that do not stand for themselves; blanks stay.
        self.others = [(chr(b), c) for b, c in enumerate(byte_characters()) if chr(b) != c and b != 0x20]
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers, ``end`` last; a null text is empty."""
        return self.encode_array(texts, end).to_pylist()

    def encode_array(self, texts: pa.Array, end: int | None = END_ID) -> pa.LargeBinaryArray:
        """The same as an array without nulls, from a first offset of 0."""
        # A-Z in lower case from the start: the normaliser lowers all letters, and fewer distinct words are left
        chunks = pc.ascii_split_whitespace(_parted(_lowered(texts)))
        words = chunks.flatten().dictionary_encode()
        place = words.indices.to_numpy(zero_copy_only=False)
        often = np.bincount(place, minlength=len(words.dictionary)) > 1
        found = self._ids_of(words.dictionary, often)
        edge = chunks.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        edge -= edge[:1]
        if end is not None:  # one more word, at the end of every text
            place = np.insert(place, edge[1:], len(found))
            edge += np.arange(len(edge))
            found.append(end.to_bytes(4, "little"))
        _, offsets, data = pa.array(found, pa.large_binary()).take(pa.array(place)).buffers()
        offsets = np.frombuffer(offsets, np.int64)[edge] if len(place) else np.zeros(len(edge), np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), data])

    def _ids_of(self, words: pa.Array, often: np.ndarray) -> list[bytes]:
        """The ids of distinct words, as bytes of little-endian unsigned 32-bit integers; those met ``often`` are remembered."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {"": b""}
        known, older = self.known, self.older
        chunks = words.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        found = list(map(known.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if older:
            again = [(i, ids) for i in missing if (ids := older.get(chunks[i])) is not None]
            for i, ids in again:
                known[chunks[i]] = found[i] = ids
            missing = [i for i in missing if found[i] is None]
        if not missing:
            return found
        new = words.take(pa.array(missing, pa.int64()))
        short = pc.less_equal(pc.utf8_length(new), LONGEST)
        plain = pc.and_(short, pc.match_substring_regex(new, _PLAIN)).to_numpy(zero_copy_only=False)
        missing = np.array(missing)
        keep = often[missing] & short.to_numpy(zero_copy_only=False)
        for which, library in ((plain, self._encode_plain), (~plain, self._encode_others)):
            own = missing[which].tolist()
            for i, kept, ids in zip(own, keep[which].tolist(), library([chunks[i] for i in own])):
                found[i] = ids
                if kept:
                    known[chunks[i]] = ids
        return found

    def _encode_plain(self, chunks: list[str]) -> list[bytes]:
        """Ids of plain words."""
        return self._encode_many("\n".join(chunks).lower().split("\n"), True) if chunks else []

    def _encode_many(self, chunks: list[str], plain: bool) -> list[bytes]:
        """Ids of each chunk, encoded as one text with a mark between chunks whose id no other chunk has; plain ones show their ends."""
        out: list[bytes] = []
        marked = not plain or self.ends is None
        for at in range(0, len(chunks), 2_000):
            some = chunks[at : at + 2_000]
            text = (f" {MARK} " if marked else " ").join(some)
            if plain:
                text = text.encode().decode("latin-1")
                for byte, char in self.others:  # few of them occur; a table would look at every character
                    if byte in text:
                        text = text.replace(byte, char)
            library = self.merges if plain else self.tokenizer
            ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)) if marked else np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                raise ValueError("the vocabulary has no id of its own for the mark" if marked else "the vocabulary does not mark the end of every word")
            data, ends = ids.tobytes(), (4 * ends).tolist()
            out += [data[s:e] for s, e in zip([0] + [e + 4 * marked for e in ends], ends)]
        return out

    def _encode_others(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that need the library's whole way; those that hold the mark are encoded alone."""
        joined = [c for c in chunks if MARK not in c]
        many = iter(self._encode_many(joined, False))
        return [np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes() if MARK in c else next(many) for c in chunks]


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    return common.model(WordEncoder, path)
