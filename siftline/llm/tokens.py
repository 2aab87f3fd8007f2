"""Exact bulk encoding with the tokenizers library.

Byte-pair encoding never merges across pre-token borders, so a text is cut at blanks where
such a border is certain, each distinct chunk goes through the library once per worker, and
the ids of a text are those of its chunks in order. Chunks that would make the cut uncertain
(white space follows the blank) send the whole text through the library instead, as do the
tokenizer's own added strings, which the library finds anywhere in a text.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from itertools import chain

import numpy as np

#: Entries and ids that a worker keeps; beyond either it starts afresh, which changes no result.
MAX_CHUNKS, MAX_IDS = 500_000, 8_000_000


class Chunks(dict):
    """Chunk -> entry. A chunk that isn't there gets the next entry and is put on the list of those to fill."""

    def __init__(self, leads: bool):
        self.leads, self.next, self.new, self.odd = leads, 0, [], False

    def __missing__(self, chunk: str) -> int:
        if self.leads and (not chunk or chunk[0].isspace()):
            self.odd = True
            return -1
        self[chunk] = at = self.next
        self.next += 1
        self.new.append(chunk)
        return at


class ChunkEncoder:
    """Encoder for one tokenizer file.

    ``blank``: what the tokenizer does at a blank that a non-space follows:
    "leads" (it starts the next pre-token, as in byte-level BPE), "drops" (white space
    only separates) or "unknown" (no cutting: each text goes to the library whole).
    """

    def __init__(self, path: str, blank: str = "unknown", max_chunks: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        self.lead = re.match(r"[\W\d]*", os.path.commonprefix(added))[0]  # of all added strings, in any case of letters
        self.tok.model._resize_cache(0)  # chunks are kept here
        if blank == "drops":  # the same model for words that need neither normalising nor splitting
            self.plain = Tokenizer.from_file(path)
            self.plain.model._resize_cache(0)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.blank, self.max_chunks = blank, max_chunks
        self.mark = np.zeros(self.tok.get_vocab_size(), bool)
        if blank == "leads":
            self.mark[[i for t, i in self.tok.get_vocab().items() if t.startswith("Ġ")]] = True
        elif blank == "drops":
            self.mark[self._library(["~"])[0]] = True
        self.marks = {c: ids[0] for c, ids in zip(",.;:!?", self._library(list(",.;:!?")), strict=True) if len(ids) == 1} if blank in ("leads", "drops") else {}
        self._reset()

    def _reset(self) -> None:
        self.head: dict[str, int] = {}
        self.body = Chunks(self.blank == "leads")
        self.again = np.zeros(1024, bool)  # entries met in a later batch too
        self.starts, self.lens, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint32)
        self.used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _grow(self, n: int, used: int) -> None:
        while n > len(self.starts):
            self.starts, self.lens, self.again = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lens, self.again))
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])

    def _put(self, at: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """Gives the entries ``at`` their ids, which stand one after the other."""
        used = self.used + len(ids)
        self._grow(0, used)
        self.starts[at] = self.used + np.cumsum(lens) - lens
        self.lens[at] = lens
        self.flat[self.used : used] = ids
        self.used = used

    def _reserve(self, n: int) -> np.ndarray:
        """The next n entries, empty."""
        first = self.body.next
        self.body.next += n
        self._grow(self.body.next, 0)
        self.again[first : self.body.next] = False
        return np.arange(first, self.body.next)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text through the library by itself: ids, and the number of each."""
        ids = self._library(texts)
        return np.array(list(chain.from_iterable(ids)), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, keys: list[str], tok) -> tuple[np.ndarray, np.ndarray]:
        """Body chunks, many in one call: their borders are seen in the ids.

        Where blanks lead, a chunk starts at each id whose token starts with one; where they
        drop, a lone ``~`` stands between two chunks, or each word ends with its own ending token.
        """
        if self.blank == "leads":
            ids = np.array(tok.encode_batch_fast(["".join(" " + k for k in keys)], add_special_tokens=False)[0].ids, np.uint32)
            lens = np.diff(np.append(np.flatnonzero(self.mark[ids]), len(ids)))
        else:
            ids = np.array(tok.encode_batch_fast([" ~ ".join([*keys, ""])], add_special_tokens=False)[0].ids, np.uint32)
            is_mark = self.mark[ids]
            lens = np.diff(np.concatenate([[0], np.cumsum(~is_mark)[is_mark]]))
            ids = ids[~is_mark]
        return (ids, lens) if len(lens) == len(keys) else self._each([(" " if self.blank == "leads" else "") + k for k in keys])

    def _make_room(self) -> None:
        """Keeps the entries that were met again, or none if those are too many."""
        old = (self.head, self.body, self.again, *self._gather(np.flatnonzero(self.again[: self.body.next])))
        self._reset()
        if len(old[4]) > (self.max_chunks or MAX_CHUNKS) // 2 or len(old[3]) > MAX_IDS // 2:
            return
        at = self._reserve(len(old[4]))
        place = np.cumsum(old[2]) - 1
        for now, before in ((self.head, old[0]), (self.body, old[1])):
            now.update((k, int(place[x])) for k, x in before.items() if old[2][x])
        self._put(at, old[3], old[4])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries one after the other, and the number of each."""
        lens = self.lens[at]
        ends = np.cumsum(lens)
        pick = np.repeat(self.starts[at] - (ends - lens), lens)
        pick += np.arange(len(pick))
        return self.flat[pick], lens

    def _fill(self) -> None:
        """Ids for the new body chunks; one that ends in a letter and a mark has its word's ids and the mark's.

        A pre-token ends between a letter and the mark, so the word is looked up without it.
        """
        body, first = self.body, self.body.next - len(self.body.new)
        words, simple, single, marked = [], [], [], []
        for k, p in enumerate(body.new):  # grows as words are looked up
            if p[-1:] in self.marks and p[-2:-1].isalpha():
                marked.append((first + k, body[p[:-1]], self.marks[p[-1]]))
            elif self.blank == "drops" and "~" in p:
                single.append(k)
            elif self.blank == "drops" and p.isalpha() and p.islower() and unicodedata.is_normalized("NFC", p):
                simple.append(k)
            else:
                words.append(k)
        new, body.new = body.new, []
        self._grow(body.next, 0)
        self.again[first : body.next] = False
        for part, tok in ((simple, self.plain if simple else None), (words, self.tok)):
            for i in range(0, len(part), 2000):
                own = part[i : i + 2000]
                self._put(first + np.array(own), *self._joined([new[k] for k in own], tok))
        if single:
            self._put(first + np.array(single), *self._each([new[k] for k in single]))
        if marked:
            at, word, mark = (np.array(x) for x in zip(*marked, strict=True))
            ids, lens = self._gather(word)
            self._put(at, np.insert(ids, np.cumsum(lens), mark), lens + 1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        if self.body.next > (self.max_chunks or MAX_CHUNKS) or self.used > MAX_IDS:
            self._make_room()
        leads, known, body = self.blank == "leads", self.body.next, self.body
        found: list[list] = []
        heads, whole = [], []
        for k, text in enumerate(texts):
            if self.blank == "unknown" or self.lead in text and self.added.search(text):
                if leads:
                    heads.append("")
                found.append([])
                whole.append(k)
                continue
            if leads:
                start, *parts = text.split(" ")
                heads.append(start)
            else:  # capitals are lowered by the tokenizer anyway; fewer chunks differ this way
                parts = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass").replace("\n", " ").split(" ")
            at = list(map(body.__getitem__, parts))
            if body.odd:
                body.odd, at = False, []
                whole.append(k)
            found.append(at)
        self._fill()
        if new := [h for h in dict.fromkeys(heads) if h not in self.head]:
            at = self._reserve(len(new))
            self._put(at, *self._each(new))
            self.head.update(zip(new, at.tolist(), strict=True))
        if whole:
            at = self._reserve(len(whole))
            self._put(at, *self._each([texts[k] for k in whole]))
        if leads:
            found = [[self.head[h], *f] for h, f in zip(heads, found, strict=True)]
        for k, x in zip(whole, at.tolist() if whole else (), strict=True):
            found[k] = [x]
        if not found:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        n_parts = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(chain.from_iterable(found), np.int64, int(n_parts.sum()))
        self.again[at[at < known]] = True
        ids, lens = self._gather(at)
        edges = np.concatenate([[0], np.cumsum(n_parts)])
        upto = np.concatenate([[0], np.cumsum(lens)])
        return ids, upto[edges[1:]] - upto[edges[:-1]]


@functools.lru_cache(maxsize=4)
def encoder(path: str, blank: str, max_chunks: int | None = None) -> ChunkEncoder:
    """The encoder of this worker; its entries last from task to task. ``max_chunks`` bounds its memory only."""
    return ChunkEncoder(path, blank, max_chunks)


def batches(texts: list[str], limit: int = 2_000_000):
    """(first, end) of runs of texts with about ``limit`` characters, each at least one text."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)
