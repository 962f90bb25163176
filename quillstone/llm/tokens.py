"""Token ids of whole texts, the same as Tokenizer.encode gives, with a cache of words beside the tokenizer.

Both vocabularies split a text before a single space that other characters surround, and no merge crosses such
a split; so the ids of a text are those of its parts, one after the other. A newline between two characters that
aren't white space is a piece of its own in one vocabulary, so that parts are cut there as well; in the other all white
space only parts words and leaves no id, so that a newline is as good as a space. Parts recur, and their ids are kept.
Arrow splits the texts, so that Python sees each different part of a batch once. Where white space has ids, texts with
other runs of it beside a space go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

_BESIDE = re.compile(r"\s (?:\s|\Z)")
_TAIL = re.compile(r"([^\W\d_]+)([.,;:!?]+)")
_WORD = re.compile(r"\S+")
_LINES = re.compile(r"\S+(?:\n\S+)+")


class Ids:
    """Of texts, ids as little-endian unsigned 32-bit integers in bytes. path: a file of the tokenizers library."""

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before known was full; words that come again move back
        self.bare: dict[str, bytes] = {}  # parts without a space before them: the first of a text or of a line
        self.ends: dict[str, bytes] = {}
        self.keep = keep
        #: A newline's ids: one, or none where white space leaves none; then a space before a part makes no difference.
        self.newline = self.encode("\n")
        #: What is put between parts to encode many at once: one id that no part without its character has.
        self.between = "\n" if len(self.newline) == 4 else " !"
        self.mark = np.frombuffer(self.encode(self.between), "<u4")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: set[str], known: dict[str, bytes], space: str) -> None:
        """parts with `space` before them."""
        cut = {p: p.split("\n") for p in parts if "\n" in p and _LINES.fullmatch(p)} if len(self.newline) == 4 else {}
        if cut:
            if lines := {x for c in cut.values() for x in c[1:]}.difference(self.bare):
                self._learn(lines, self.bare, "")
            parts = parts.difference(cut).union({c[0] for c in cut.values()}.difference(known))
        whole, halves = [], []
        for p in parts:
            if p and p[-1] in ".,;:!?" and (m := _TAIL.fullmatch(p)) and (p.isascii() or unicodedata.normalize("NFC", m[1].lower()).isalpha()):
                halves.append((p, m[1], m[2]))
            else:
                whole.append(p)
        fresh = {w for _, w, _ in halves}.difference(known).union(whole)
        mark = self.between[-1]
        many = [p for p in fresh if p and mark not in p and (p.isalnum() or not self.newline or _WORD.fullmatch(p))] if len(self.mark) == 1 else []
        for p in fresh.difference(many):
            known[p] = self.encode(space + p)
        if many:
            before = " " if self.between[0] == " " else space
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join([before + p for p in many])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)) * 4
            raw, at = ids.tobytes(), 0
            for p, end in zip(many, ends.tolist(), strict=True):
                known[p], at = raw[at:end], end + 4
        for p, w, tail in halves:
            if tail not in self.ends:
                self.ends[tail] = self.encode(tail)
            known[p] = known[w] + self.ends[tail]
        for p, (head, *lines) in cut.items():
            known[p] = known[head] + b"".join([self.newline + self.bare[x] for x in lines])

    def _after_spaces(self, words: list[str]) -> list[bytes]:
        known, older = self.known, self.older
        found = list(map(known.get, words))
        lacks = [i for i, b in enumerate(found) if b is None]
        missing = {words[i] for i in lacks}
        again = {p: older[p] for p in missing if p in older}
        known.update(again)
        if missing := missing.difference(again):
            self._learn(missing, known, " ")
        for i in lacks:
            found[i] = known[words[i]]
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        if len(self.bare) > self.keep // 4:
            self.bare = {}
        if len(self.ends) > self.keep:
            self.ends = {}
        if self.newline:
            whole = [_BESIDE.search(t) is not None for t in texts]
        else:  # white space only parts words, whatever it is
            whole, texts = [False] * len(texts), [t.replace("\n", " ") for t in texts]
        cut = [("", "", "") if w else t.partition(" ") for t, w in zip(texts, whole, strict=True)]
        if firsts := {first for first, _, _ in cut}.difference(self.bare):
            self._learn(firsts, self.bare, "")
        parts = pc.split_pattern(pa.array([rest if sep else None for _, sep, rest in cut], pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        ids = pa.array(self._after_spaces(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        places = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        ends = np.concatenate([[0], places])[np.concatenate([[0], pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).cumsum()]).astype(np.int64)].tolist()
        raw = memoryview(ids.buffers()[2]) if len(ids) else b""
        return [self.encode(t) if w else self.bare[c[0]] + raw[x:y] for t, w, c, x, y in zip(texts, whole, cut, ends[:-1], ends[1:], strict=True)]


def ids_of(path: str, keep: int = 500_000) -> Ids:
    """One for each Python worker. keep: words in the cache, and as many older ones; each takes some 250 bytes."""
    return held(("ids", path, keep), lambda: Ids(path, keep))
