"""Token ids of whole texts by the tokenizers library, each distinct stretch of text encoded once per worker.

A byte pair encoder of these files never merges across the step from a non-space to a space character, so a text's
ids are the ids of its stretches (a word with the space before it) in order. Stretches repeat, so their ids are
kept in a table of bounded size; texts with unusual white space or a special token's string are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from itertools import repeat

import numpy as np

from . import common

#: Characters besides space and LF that a pre-tokenizer may take for white space, and control separators.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Marks that, after a letter, begin a pre-token of their own in these files; an apostrophe does not.
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_{|}~"
_START = "\x01"
#: Words that are encoded as one text.
TOGETHER = 256


class Encoder:
    """ids(texts) for one tokenizer file, as the file alone has it: a special token's string in a text is that token.

    With plain, such strings are ordinary text (a text cannot then name a control id). cache_entries bounds the table of stretches; when it is full it is emptied and filled anew, which costs time
    and changes no id.
    """

    def __init__(self, path: str, cache_entries: int = 1_000_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.folds = "Lowercase" in str(self.tokenizer.normalizer)
        added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a stretch is folded before it is encoded, so strings that fold to a special one are held apart, too
        self.special = re.compile("|".join(map(re.escape, added)), re.IGNORECASE if self.folds else 0) if added else None
        self.special_heads = {a[0] for a in added}
        self.cache_entries = cache_entries
        # the mark of a word in its tokens: a space before the first, or an end at the last
        names = {i: t for t, i in self.tokenizer.get_vocab().items()}
        starts, ends = (np.array([f(names.get(i, "")) for i in range(max(names) + 1)]) for f in (lambda t: t.startswith("\u0120"), lambda t: t.endswith("</w>")))
        self.at_start = bool(starts.sum() > ends.sum())
        self.edge = starts if self.at_start else ends if ends.any() else None
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.begin = np.zeros(1, np.int64)  # of each entry in flat, with one end more
        self.flat = np.zeros(0, np.uint16)
        self.used = 0

    def _whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _encode(self, fresh: list[str]) -> None:
        """Words of letters alone are encoded many to a text: where each begins or ends is told by its tokens."""
        plain = [s for s in fresh if s.isalpha()] if self.edge is not None else []
        if plain:
            groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
            for group, ids in zip(groups, self._whole([" " + " ".join(g) for g in groups]), strict=True):
                marked = np.flatnonzero(self.edge[ids])
                if len(marked) != len(group):  # not one mark for each word; none is known of
                    self._one_by_one(group)
                    continue
                cuts = np.r_[marked, len(ids)] if self.at_start else np.r_[0, marked + 1]
                self._append(group, np.diff(cuts), ids)
            alone = set(plain)
            fresh = [s for s in fresh if s not in alone]
        if fresh:
            self._one_by_one(fresh)

    def _one_by_one(self, fresh: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast([s[1:] if s[0] == _START else s if s[0] == "\n" else " " + s for s in fresh], add_special_tokens=False)
        ids = [e.ids for e in encoded]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._append(fresh, sizes, np.fromiter((x for e in ids for x in e), np.uint16, int(sizes.sum())))

    def _append(self, keys: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.place)
        self.place.update(zip(keys, range(n, n + len(keys)), strict=True))
        if len(self.begin) < n + len(keys) + 1:
            self.begin = np.resize(self.begin, 2 * (n + len(keys)) + 1)
        self.begin[n + 1 : n + len(keys) + 1] = self.used + np.cumsum(sizes)
        if len(self.flat) < self.used + len(flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(flat)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        first = self.begin[at]
        size = self.begin[at + 1] - first
        ends = np.cumsum(size)
        return self.flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def _add(self, fresh: list[str]) -> None:
        """A word with marks after its last letter is the word and the marks, each encoded once."""
        whole, joined = [], []
        for s in fresh:
            if s[-1] not in _MARKS:
                whole.append(s)
                continue
            core = s.rstrip(_MARKS)
            if core and core[-1].isalpha():
                joined.append((s, core, _START + s[len(core) :]))
            else:
                whole.append(s)
        have = set(whole)
        place = self.place
        whole += [x for x in dict.fromkeys(x for j in joined for x in j[1:]) if x not in place and x not in have]
        if whole:
            self._encode(whole)
        if joined:
            at = np.array([(place[core], place[marks]) for _, core, marks in joined], np.int64)
            sizes = (self.begin[at + 1] - self.begin[at]).sum(axis=1)
            self._append([s for s, _, _ in joined], sizes, self._gather(at.ravel()))

    def _special(self, text: str) -> bool:
        return any(c in text for c in self.special_heads) and self.special.search(text) is not None

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """A uint16 array of ids for each text (these vocabularies have fewer than 65,536 ids)."""
        out: list[np.ndarray | None] = [None] * len(texts)
        odd, cut = [], []
        for i, t in enumerate(texts):
            if "  " in t or "\n\n" in t or "\n " in t or " \n" in t or "\x01" in t or _ODD.search(t) or self._special(t):
                odd.append(i)
            else:
                parts = (t.lower() if self.folds and t.isascii() else t).replace("\n", " \n").split(" ")
                parts[0] = _START + parts[0]
                cut.append((i, [p or _START + " " for p in parts] if t.endswith(" ") else parts))
        if odd:
            for i, x in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
                out[i] = x
        if len(self.place) > self.cache_entries:
            self._reset()
        flat = [p for _, parts in cut for p in parts]
        at = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        missed = np.flatnonzero(at < 0).tolist()
        if missed:
            self._add(list(dict.fromkeys([flat[i] for i in missed])))
            place = self.place
            at[missed] = [place[flat[i]] for i in missed]
        # the ids of all texts in one gathering, cut where each text's stretches end
        many = self.begin[at + 1] - self.begin[at]
        ends = np.cumsum(many)[np.cumsum([len(parts) for _, parts in cut]) - 1] if cut else []
        for (i, _), ids in zip(cut, np.split(self._gather(at), ends[:-1]) if cut else [], strict=True):
            out[i] = ids
        return out


#: The name of the workers' cache of encoders, for map_batches.
CACHE = "tokens"


def encoder(path: str, cache_entries: int = 2_000_000) -> Encoder:
    """The worker's encoder of a file; workers are reused across tasks, and so is its table (about 0.1 GB a million)."""
    held = common.worker_caches.setdefault(CACHE, {})
    if path not in held:
        held[path] = Encoder(path)
    held[path].cache_entries = cache_entries
    return held[path]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; the package is a parameter of the queries, not of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)
