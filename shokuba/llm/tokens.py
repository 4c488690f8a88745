"""Token ids of a BPE tokenizer whose words never cross white space, with each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import regex

#: Words of these characters are lower-cased and split here as the tokenizer's own rules do; all others go to it whole.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-įı-ɏ]+\Z")
_BUNCH = 256  # units in one text
#: White space on which Python and the tokenizer may differ; texts with it are encoded whole.
_ODD = re.compile(r"[\x1c-\x1f\x85᠎]")
_GROUP = 60_000  # characters of texts whose words are learnt together


class WordEncoder:
    """Encodes texts word by word from bounded caches; the ids equal those of the tokenizer on the whole text.

    A word is what lies between white space. The pre-tokenizer's pattern, read from the file, cuts a word into units,
    and only units never met are sent to the tokenizer, many in one text; the token with the word end closes a unit.
    """

    def __init__(self, path: str, words: int = 300_000, units: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # units are lower-case, composed and free of white space already
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.last = np.zeros(1 + max(self.vocab.values()), bool)
        self.last[[i for t, i in self.vocab.items() if t.endswith("</w>")]] = True
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(rf"\n|{split['pattern']['Regex']}")
        # two generations: a full cache becomes the old one, and what is met again moves back
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}
        self.most_words, self.most_units = words, units

    def sentence_ends(self) -> np.ndarray:
        """Ids of tokens that end a sentence: the end marks alone or repeated, with or without the word end."""
        return np.array(sorted(i for t, i in self.vocab.items() if re.fullmatch(r"[.!?]+(</w>)?", t)), np.uint32)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _encode_units(self, missing: list[str]) -> None:
        found = self.bare.encode_batch_fast([" ".join(missing[i : i + _BUNCH]) for i in range(0, len(missing), _BUNCH)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32)
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        every, units = ids.tobytes(), self.units
        at = 0
        for unit, end in zip(missing, ends.tolist(), strict=True):
            units[unit] = every[at:end]
            at = end

    def _learn(self, missing: set[str]) -> None:
        if len(self.units) > self.most_units:
            self.old_units, self.units = self.units, {}
        known = self.old_words.keys() & missing
        self.words.update((w, self.old_words[w]) for w in known)
        missing = missing - known
        plain = list(missing) if _PLAIN.match("".join(missing)) else list(filter(_PLAIN.match, missing))
        cut = self.pattern.findall("\n".join(plain).lower())
        new = set(cut).difference(self.units)
        known = self.old_units.keys() & new
        self.units.update((u, self.old_units[u]) for u in known)
        new -= known
        new.discard("\n")
        if new:
            self._encode_units(list(new))
        get, at, learnt = self.units.__getitem__, 0, []
        for i, unit in enumerate(cut):
            if unit == "\n":
                learnt.append(get(cut[at]) if i - at == 1 else b"".join(map(get, cut[at:i])))
                at = i + 1
        learnt.append(b"".join(map(get, cut[at:])))
        self.words.update(zip(plain, learnt))
        for w in missing.difference(plain):
            self.words[w] = self._whole(w)

    def encode_many(self, texts: Iterable[str], end: bytes = b"") -> Iterator[np.ndarray]:
        """Ids (uint32) of each text and of `end`, in order; words that no text before has are learnt for several texts at once."""
        waiting: list[str | list[str]] = []  # texts whose words are still to be learnt, cut into words
        missing: set[str] = set()
        size = 0
        for text in texts:
            if _ODD.search(text) or any(s in text for s in self.special):
                waiting.append(text)
            else:
                words = text.split()
                waiting.append(words)
                missing.update(set(words).difference(self.words))
            size += len(text)
            if not missing or size >= _GROUP:
                yield from self._answer(waiting, missing, end)
                waiting, missing, size = [], set(), 0
        yield from self._answer(waiting, missing, end)

    def _answer(self, texts: list[str | list[str]], missing: set[str], end: bytes) -> Iterator[np.ndarray]:
        if len(self.words) > self.most_words:
            self.old_words, self.words = self.words, {}
            missing = set().union(*(x for x in texts if isinstance(x, list)))
        if missing:
            self._learn(missing)
        get = self.words.__getitem__
        for x in texts:
            ids = b"".join(map(get, x)) if isinstance(x, list) else self._whole(x)
            yield np.frombuffer(ids + end, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Ids (uint32) of one text."""
        return next(self.encode_many([text]))
