"""Whole-text tokenising with the ``tokenizers`` library.

Most of a corpus is the same few hundred thousand words, so each worker keeps the
ids of the segments it has met.  A segment starts at a single space between two
characters that aren't white space (at any, where ``lead`` is empty): both kinds of tokenizer used here break there
whatever stands around, so the ids of a text are those of its segments in turn.
"""

from __future__ import annotations

import os
import re

import numpy as np

_BREAK = re.compile(r"(?<=\S) (?=\S)")
#: White space that is rare enough in text to send the whole text down the careful path.
_RARE_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SENTINEL = "|"


class SegmentTokenizer:
    """Ids of whole texts, equal to those of one ``encode`` call on each.

    ``lead``: what stands before every segment but the first (a space for byte-level
    vocabularies, which keep it).  ``cache``: how many segments are remembered; the
    first ones met stay, and the others are encoded each time.
    """

    def __init__(self, path: str, lead: str, cache: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.lead, self.limit = Tokenizer.from_file(path), lead, cache
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        mark = self.tokenizer.encode(lead + _SENTINEL, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.tails = {c: self._encode(c).tobytes() for c in ".,"}
        self.lowers = self._encode("AB").tobytes() == self._encode("ab").tobytes()

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.width)

    def _led(self, segment: str) -> str:
        return segment if segment[:1] == "\n" else self.lead + segment

    def _learn(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of segments that aren't known yet: those without the sentinel in one call, between sentinels."""
        # a word and the mark after it are always tokenised apart
        marked = {s: s[:-1] for s in segments if s[-1:] in self.tails and s[:-1].isalpha()}
        if marked:
            known = {w: b for w in marked.values() if (b := self.later.get(w)) is not None}
            rest = dict.fromkeys(w for s in segments if (w := marked.get(s, s)) not in known)
            known |= self._learn(list(rest)) if rest else {}
            return {s: known[marked[s]] + self.tails[s[-1]] if s in marked else known[s] for s in segments}
        found: dict[str, bytes] = {}
        plain = [s for s in segments if _SENTINEL not in s] if self.mark is not None else []
        if plain:
            ids = self._encode(f" {_SENTINEL}{'' if self.lead else ' '}".join(map(self._led, plain)))
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(plain) - 1:
                raw, size = ids.tobytes(), ids.itemsize
                ends = (ends * size).tolist()
                found = {s: raw[i:j] for s, i, j in zip(plain, [0, *(e + size for e in ends)], [*ends, len(raw)])}
        for s in segments:
            if s not in found:
                found[s] = self._encode(self._led(s)).tobytes()
        for s, b in found.items():
            if len(self.later) >= self.limit:
                break
            if len(s) <= 64:
                self.later[s] = b
        return found

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, as an array of the vocabulary's width."""
        if not text:
            return np.empty(0, dtype=self.width)
        rare, edge = _RARE_SPACE.search(text), text[0] + text[-1]
        if not self.lead and not rare:  # white space leaves nothing behind, and nor does case
            parts = (text.lower() if text.isascii() and self.lowers else text).split() or [""]
        elif rare or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or " " in edge or "\n" in edge:
            parts = _BREAK.split(text)
        else:  # single spaces and single line ends only: a line's first segment keeps its line end
            parts = text.replace("\n", " \n").split(" ")
        head = self.first.get(parts[0])
        if head is None:
            head = self._encode(parts[0]).tobytes()
            if len(self.first) < self.limit // 10 and len(parts[0]) <= 64:
                self.first[parts[0]] = head
        rest = parts[1:]
        got = list(map(self.later.get, rest))
        if None in got:
            gaps = [i for i, b in enumerate(got) if b is None]
            new = self._learn(list(dict.fromkeys(rest[i] for i in gaps)))
            for i in gaps:
                got[i] = new[rest[i]]
        return np.frombuffer(b"".join([head, *got]), dtype=self.width)


_loaded: dict[tuple[str, str], SegmentTokenizer] = {}


def worker_tokenizer(path: str, lead: str) -> SegmentTokenizer:
    """The tokenizer of this Python worker, loaded once."""
    key = (path, lead)
    if key not in _loaded:
        _loaded[key] = SegmentTokenizer(path, lead)
    return _loaded[key]
