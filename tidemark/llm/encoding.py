"""Token ids of whole texts by the tokenizers library, through a word cache.

A text is cut only where the tokenizer's own pre-tokenizer always ends a piece,
so ids of the parts are the ids of the whole. Each distinct part is encoded
once by the library, words of letters by its model alone, and its ids are kept as
little-endian bytes. Arrow cuts the texts, finds the distinct parts of some
megabytes of text and strings their ids together; Python sees distinct parts only.
"""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np

#: Entries after which the cache of a worker starts anew.
CACHE_WORDS = 1_500_000
_LINE, _HEAD = "\x00", "\x01"
_INNER = re.compile(r" (?=\S)")


class WordCacheEncoder:
    """``style`` "byte": byte-level BPE, a space belongs to the word after it.
    ``style`` "word": white space is dropped and never inside a piece.

    ``dtype`` is the stored width of an id.
    """

    def __init__(self, path: str, style: str, dtype: str = "<u2"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.style, self.dtype = Tokenizer.from_file(path), style, dtype
        self.model = self.tokenizer.model.tokenize
        if dtype == "<u2" and self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary needs wider ids")
        pieces = self.tokenizer.pre_tokenizer
        byte = [pieces.pre_tokenize_str(c)[0][0] for c in map(chr, range(33, 127))]
        if byte != [chr(c) for c in range(33, 127)]:
            raise ValueError("not a byte-level vocabulary")
        #: Letters that are one piece with their neighbours, as the model's alphabet writes their bytes.
        self.letters = {c: "".join(x for x, _ in pieces.pre_tokenize_str(c)) for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower() < "\u0250"}
        self.table = str.maketrans(self.letters)
        self.space = pieces.pre_tokenize_str(" a")[0][0][0] if style == "byte" else ""
        #: Such letters, and at most eight marks after them: together a piece of their own, whatever they are.
        self.pattern = f"(?P<stem>[{''.join(self.letters)}]+)(?P<mark>[{re.escape(string.punctuation)}]{{0,8}})"
        self.simple = re.compile(self.pattern).fullmatch
        self.line, self.marks = self._ids(["\n"]), {}
        #: Ids of a part; None for a part that says that its text has to be cut with care.
        self.cache: dict[str, bytes | None] = {}

    def _ids(self, texts: list[str]) -> bytes:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return b"".join([np.array(e.ids, self.dtype).tobytes() for e in found])

    def parts(self, texts):
        """List array of the parts of an Arrow array of texts, cut at single spaces and line feeds.

        In the byte style a part stands for itself after a space, after ``_LINE`` for
        itself after a line feed, after ``_HEAD`` for itself.
        """
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        if self.style == "word":
            return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), " ")
        odd = pc.or_(pc.match_substring(texts, _LINE), pc.match_substring(texts, _HEAD))
        cut = pc.binary_join_element_wise(_HEAD, pc.replace_substring(texts, "\n", f" {_LINE}"), "")
        return pc.split_pattern(pc.if_else(odd, "", cut), " ")

    def _word(self, word: str, space: str) -> bytes:
        """Ids of a word of letters, in the word style small ones, by the model alone."""
        if not word.isascii():
            word = word.translate(self.table)
        return array("H" if self.dtype == "<u2" else "I", [t.id for t in self.model(space + word)]).tobytes()

    def _encode_new(self, new: list[str]) -> None:
        """Puts the ids of ``new`` parts into the cache."""
        cache, marks, byte, alone = self.cache, self.marks, self.style == "byte", []
        for w in new:
            first = w[:1]
            told = byte and (first == _LINE or first == _HEAD)
            core = w[1:] if told else w
            if byte and (not core or core[0].isspace() or core[-1].isspace()):
                cache[w] = b"" if w == _HEAD else None
                continue
            if not (found := self.simple(core)):
                alone.append((w, core if told or not byte else f" {core}"))
                continue
            stem, mark = found.groups()
            key = (_HEAD + stem if told else stem) if byte else stem.lower()
            if (ids := cache.get(key)) is None:
                ids = cache[key] = self._word(stem if byte else key, "" if told else self.space)
            if mark:
                if mark not in marks:
                    marks[mark] = self._ids([mark])
                ids = ids + marks[mark]
            cache[w] = self.line + ids if byte and first == _LINE else ids
        for at in range(0, len(alone), 20_000):
            some = alone[at : at + 20_000]
            for (w, _), e in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype).tobytes()
                cache[w] = self.line + ids if byte and w[0] == _LINE else ids

    def _careful(self, text: str) -> bytes:
        """Ids of a text in the byte style with runs of white space or control characters in it."""
        head, *rest = _INNER.split(text)
        words = [head, *[" " + x for x in rest]]
        return self._ids(words)

    def _by_part(self, parts):
        """Ids of an Arrow array of parts, each of them kept in the cache."""
        import pyarrow as pa

        known = parts.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.cache.get, known))
        new = [k for k, x in enumerate(ids) if x is None]
        if new:
            self._encode_new([known[k] for k in new])
            for k in new:
                ids[k] = self.cache[known[k]]
        return pa.array(ids, pa.large_binary())

    def _by_stem(self, words):
        """Ids of an Arrow array of words of the word style, of which only those of small letters without marks are kept."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.extract_regex(words, f"^{self.pattern}$")
        stems = pc.coalesce(pc.utf8_lower(pc.struct_field(found, "stem")), words).dictionary_encode()
        marks = pc.coalesce(pc.struct_field(found, "mark"), "").dictionary_encode()
        sides = (self._by_part(x.dictionary).take(x.indices) for x in (stems, marks))
        return pc.binary_join_element_wise(*sides, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of a list or an Arrow array (None: empty), as bytes of ``dtype``."""
        import pyarrow as pa

        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.marks = {}
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        split = self.parts(texts)
        words = split.flatten().dictionary_encode()
        ids = (self._by_stem if self.style == "word" else self._by_part)(words.dictionary).take(words.indices)
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[ids.offset :][at].tolist() if len(ids) else [0] * len(at)
        data = memoryview(data or b"")
        out = [bytes(data[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
        if ids.null_count:  # of parts that say so
            for i in set((np.searchsorted(at, np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)), "right") - 1).tolist()):
                out[i] = self._careful(texts[i].as_py())
        return out


_ENCODERS: dict[tuple, WordCacheEncoder] = {}


def encoder(path: str, style: str, dtype: str = "<u2") -> WordCacheEncoder:
    """The worker's encoder; kept, as Spark reuses its Python workers."""
    key = (path, style, dtype)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordCacheEncoder(*key)
    return _ENCODERS[key]


def chunks(texts, size: int = 8_000_000):
    """Slices of an Arrow array of texts, of about ``size`` bytes each, to bound what is cut at once, with their starts."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size)) + 1
        yield start, texts.slice(start, stop - start)
        start = stop
