"""SentencePiece BPE ids by vectorised merge rounds, and texts from ids."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import text_or_empty

_SPACE = "▁"
_NEVER = np.int32(2**31 - 1)  # rank of two neighbours that form no piece
_SHIFT = 21  # bits of a symbol: a piece's id, or the pieces' number plus the code point of a character that is no piece
_GROUP = 1_000_000  # characters of texts whose new units are merged together


class PieceModel:
    """The vocabulary of a model as arrays, with a bounded cache of units; ids equal those of the library.

    A unit is a stretch that no piece can reach across: blanks and the word behind them, split at control characters.
    New units of many texts lie one after the other in one flat array of symbols. They are cut again where no piece
    holds the two neighbouring characters; these stretches are the words below. Each round finds the smallest rank of
    two neighbours in every word, merges the leftmost of them that don't overlap, and closes the gaps, until no word
    has a pair. Where a merge could make room for a pair of smaller or equal rank, one merge after the other is made,
    as the library does: only occurrences far enough apart not to meet are merged in one round.
    """

    def __init__(self, path: str, units: int = 150_000):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        if lib.normalize("  a  ﬁ ") != "▁▁▁a▁▁ﬁ▁" or lib.normalize("") != "":
            raise ValueError(f"{path}: only models that keep texts as they are and put one blank before are read")
        self.size = n = lib.get_piece_size()
        texts = [lib.id_to_piece(i) for i in range(n)]
        plain = [not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)) or not any(lib.is_byte(i) for i in range(n)):
            raise ValueError(f"{path}: only models with bytes for unknown characters and without unused pieces are read")
        self.end_id = lib.eos_id()
        ids = {t: i for i, (t, p) in enumerate(zip(texts, plain)) if p}
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self.silent = np.array([lib.is_control(i) for i in range(n)])
        self.out = [t.replace(_SPACE, " ").encode() if p else b"" for t, p in zip(texts, plain)]
        self.unknown = [i for i in range(n) if lib.is_unknown(i)]
        for i in self.unknown:
            self.out[i] = lib.decode([i]).encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            self.out[i] = bytes([b])

        scores = np.array([lib.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        inside = set("".join(ids))
        self.char = np.arange(n, n + 0x110000, dtype=np.int32)
        self.char[:128] = self.byte_ids[:128]  # what is in no piece is one byte already
        for c in inside:
            self.char[ord(c)] = ids.get(c, n + ord(c))

        def symbol(t: str) -> int | None:
            return int(self.char[ord(t)]) if len(t) == 1 else ids.get(t)

        pairs, unsafe = {}, set()
        for t, i in ids.items():
            for k in range(1, len(t)):
                left, right = symbol(t[:k]), symbol(t[k:])
                if left is None or right is None:
                    continue
                pairs[left << _SHIFT | right] = i
                unsafe.update(int(self.rank[m]) for m, part in ((left, t[:k]), (right, t[k:])) if len(part) > 1 and self.rank[m] >= self.rank[i])
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.unsafe = np.zeros(self.rank.max() + 2, bool)
        self.unsafe[list(unsafe)] = True
        self.longest = max(map(len, ids))
        self.joined = np.unique(np.array([ord(a) << _SHIFT | ord(b) for t in ids for a, b in zip(t, t[1:])], np.int64))

        several = set("".join(t for t in ids if len(t) > 1))
        apart = "".join(c for c in map(chr, range(32)) if c not in several)
        self.unit = re.compile(rf"{_SPACE}*[^{_SPACE}{re.escape(apart)}]+|{_SPACE}+|[{re.escape(apart)}]")
        self.most, self.cache, self.old = units, {}, {}
        if blanks := self._long_blanks(ids):  # else a long stretch of blanks would take a round for each of them
            self.unit = re.compile(rf"{_SPACE}{{{blanks}}}(?={_SPACE})|{self.unit.pattern}")

    def _long_blanks(self, ids: dict[str, int]) -> int:
        """Blanks at the start of a long stretch of them that form a piece whatever follows; 0 if that can't be said."""
        k = max((len(t) for t in ids if set(t) == {_SPACE}), default=0)
        last = max(self.rank[i] for i in ids.values())
        mixed = any(_SPACE * 2 in t and set(t) != {_SPACE} for t in ids)
        if k < 2 or mixed or any(self.rank[ids[t]] < last for t in ids if len(t) > 1 and set(t) == {_SPACE}):
            return 0
        flat, ends = self.merge([_SPACE * n for n in range(1, 4 * k)])
        starts = [0, *ends[:-1].tolist()]
        got = [flat[a:b].tolist() for a, b in zip(starts, ends.tolist())]
        whole = ids[_SPACE * k]
        return k if all(got[n - 1] == [whole, *got[n - k - 1]] for n in range(k + 1, 4 * k)) else 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of neighbours."""
        key = left.astype(np.int64) << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = self.made[at]
        return np.where(self.keys[at] == key, self.rank[piece], _NEVER), piece

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other (int32), and where each unit ends in them."""
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        stops = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        n, sym, at = len(code), self.char[code], np.arange(len(code))
        first = np.zeros(n, bool)
        first[0] = True
        first[stops[:-1]] = True
        key = code[:-1] << _SHIFT | code[1:]
        first[1:] |= self.joined[np.minimum(np.searchsorted(self.joined, key), len(self.joined) - 1)] != key
        rank, made = np.full(n, _NEVER), np.zeros(n, np.int32)
        rank[:-1], made[:-1] = self._ranks(sym[:-1], sym[1:])
        rank[:-1][first[1:]] = _NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(first)
            low, count = np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym)))
            if (over := low == _NEVER).any():
                gone = np.repeat(over, count)
                done.append((at[gone], sym[gone]))
                sym, at, rank, made, first = (x[~gone] for x in (sym, at, rank, made, first))
                low, count = low[~over], count[~over]
                if not len(sym):
                    break
            word = np.repeat(np.arange(len(low)), count)
            hit = np.flatnonzero(rank == low[word])
            # the last symbol of a word has no pair, so hits in a row lie in one word; every second of them overlaps
            fresh = np.diff(hit, prepend=-2) != 1
            take = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))) % 2 == 0]
            if (slow := self.unsafe[rank[take]]).any():
                alone = np.ones(len(take), bool)
                alone[1:] = (word[take[1:]] != word[take[:-1]]) | (at[take[1:]] - at[take[:-1]] > 4 * self.longest)
                take = take[~slow | alone]
            sym[take] = made[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            rank[take] = _NEVER
            sym, at, rank, made, first = (x[keep] for x in (sym, at, rank, made, first))
            now = take - np.arange(len(take))
            for i in (now, now[~first[now]] - 1):  # the pair that begins with a new symbol, and the one that ends with it
                i = i[i + 1 < len(sym)]
                r, m = self._ranks(sym[i], sym[i + 1])
                r[first[i + 1]] = _NEVER
                rank[i], made[i] = r, m
        at, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at, kind="stable")
        at, sym = at[order], sym[order]
        ends = np.searchsorted(at, stops)
        if (other := np.flatnonzero(sym >= self.size)).size:  # characters of several bytes that are in no piece
            spelt = [np.frombuffer(chr(c).encode(), np.uint8) for c in (sym[other] - self.size).tolist()]
            sizes = np.ones(len(sym), np.int64)
            sizes[other] = list(map(len, spelt))
            before = np.concatenate([[0], np.cumsum(sizes)])
            sym = np.repeat(sym, sizes)
            for i, b in zip(before[other].tolist(), spelt):
                sym[i : i + len(b)] = self.byte_ids[b]
            ends = before[ends]
        return sym, ends

    def _learn(self, units: set[str]) -> None:
        if len(self.cache) > self.most:  # two generations: what is met again moves back
            self.old, self.cache = self.cache, {}
        known = self.old.keys() & units
        self.cache.update((u, self.old[u]) for u in known)
        if new := list(units - known):
            flat, ends = self.merge(new)
            raw, at = flat.tobytes(), 0
            for u, end in zip(new, (ends * 4).tolist()):
                self.cache[u] = raw[at:end]
                at = end

    def encode_many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids (int32) of each text, with the end id."""
        end, waiting, size = np.int32(self.end_id).tobytes(), [], 0

        def answer() -> Iterator[np.ndarray]:
            needed = set().union(*waiting)
            # what the cache drops on growing must be learnt again for these texts
            self._learn(needed if len(self.cache) > self.most else needed.difference(self.cache))
            for units in waiting:
                yield np.frombuffer(b"".join(map(self.cache.__getitem__, units)) + end, np.int32)

        for text in texts:
            waiting.append(self.unit.findall(_SPACE + text.replace(" ", _SPACE)) if text else [])
            size += len(text)
            if size >= _GROUP:
                yield from answer()
                waiting, size = [], 0
        yield from answer()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: blanks for their sign, without the one put before; bytes as UTF-8, each byte that is none as U+FFFD.
        Control ids say nothing, but bytes don't join across them."""
        names = ids.tolist()
        if (said := ~self.silent[ids]).all():
            first = names[0] if names else None
        else:
            first = names[said.argmax()] if said.any() else None
        try:
            # a control id at the end, as encode puts it, is between no bytes
            text = b"".join(map(self.out.__getitem__, names)).decode() if said[:-1].all() else self._decode_spoilt(names)
        except UnicodeDecodeError:
            text = self._decode_spoilt(names)
        marked = first is not None and not self.is_byte[first] and first not in self.unknown
        return text[1:] if marked and text.startswith(" ") else text

    def _decode_spoilt(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.out[i]
                continue
            while run:
                for k in range(1, min(4, len(run)) + 1):
                    try:
                        out.append(run[:k].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    k = 1
                    out.append("�")
                del run[:k]
            if i is not None:
                out.append(self.out[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def _slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit` bytes of `column` at most, or one row."""
    for b in batches:
        values = b.column(column)
        length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        size = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield b.slice(at, stop - at)
            at = stop


def encode(docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """doc_id, ids: the piece ids of every whole text, then the end id, exactly as the library gives them without sampling.

    Null and empty texts are the end id alone. Rows are encoded one by one where they lie, without a shuffle: repeated
    rows and ids, and null ids, stay as many rows; an empty table gives an empty result; only doc_id and text are read.
    A text of any length is one row; its work is linear but for stretches of one word, whose rounds follow its ranks.
    """

    def run(batches):
        m = _model(model)
        for b in _slices(batches, "text", 4 * _GROUP):
            found = list(m.encode_many(x.as_py() for x in b.column("text")))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(key), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty().alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(coded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """doc_id, ids, text: the text of each row's ids as the library's decode gives it; null ids give an empty text."""

    def run(batches):
        m = _model(model)
        for b in _slices(batches, "ids", 2 * _GROUP):
            column, none = b.column("ids"), np.zeros(0, np.int32)
            texts = [m.decode(x.values.to_numpy() if x.is_valid else none) for x in column]
            yield pa.RecordBatch.from_arrays([b.column(key), column, pa.array(texts, pa.string())], names=[key, "ids", "text"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>, text string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text encoded and decoded again."""
    back = decode(encode(docs, model), model)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
