"""Byte-pair encoding of whole texts with a public SentencePiece vocabulary, and its decoding.

A prefix of a text has exactly one last piece in its encoding.  The table of these last pieces is filled from left
to right: an automaton names every piece that ends at a position, and the one that may stand behind the last piece
of the prefix before it is the entry.  The ids are then read backwards from the end of the table.

Two pieces may stand side by side if merging both at once, in order of score, never joins them across their border.
Every encoding is a run of such pairs, and every run of such pairs is the encoding of its text.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from sys import getsizeof

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

SPACE = "▁"
NEVER = 1 << 60
MEMO_BYTES = 60 << 20
ENTRY_BYTES = 110  # of the table itself, at its least filling
MEMO_LENGTH = 64
LOCKSTEP_LENGTH = 96
_CHUNK = re.compile(r" *[^ ]+| +")


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file's content; it travels with the task, so workers need no file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def weight(value) -> int:
    """Bytes that a remembered value takes."""
    return getsizeof(value) + (sum(map(getsizeof, value)) if isinstance(value, (list, tuple)) else 0)


class WordMemo(dict):
    """Values by word, in bounded memory.

    ``learn`` fills in the new words of a batch together.  Where they would take the memo beyond ``most`` bytes all older
    ones are forgotten, and words that still do not fit are worked out when they are met.
    """

    def __init__(self, coder: PrefixTable, value=lambda ids: ids, most: int = MEMO_BYTES):
        super().__init__()
        self.coder, self.value, self.most, self.held = coder, value, most, 0

    def __missing__(self, word: str):
        return self.value(self.coder.ids_of(word))

    def learn(self, lists: list[list[str]]) -> None:
        every = set().union(*lists)
        self.add([w for w in every.difference(self) if len(w) <= MEMO_LENGTH])
        if self.held > self.most:
            self.clear()
            self.held = 0
            self.add([w for w in every if len(w) <= MEMO_LENGTH])

    def add(self, new: list[str]) -> None:
        for k in range(0, len(new), 8192):
            words = new[k:k + 8192]
            values = list(map(self.value, self.coder.ids_of_many(words)))
            self.held += sum(map(getsizeof, words)) + sum(map(weight, values)) + ENTRY_BYTES * len(words)
            self.update(zip(words, values))
            if self.held > self.most:
                return


class PrefixTable:
    """Encoder and decoder of one vocabulary: byte-pair merges by score, byte fallback, a space before the text."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.end_id = sp.eos_id()
        ids = range(sp.get_piece_size())
        self.piece = [sp.id_to_piece(i) for i in ids]
        self.silent = {i for i in ids if sp.is_control(i)}
        self.unknown = {i for i in ids if sp.is_unknown(i)}
        byte_ids = [i for i in ids if sp.is_byte(i)]
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in byte_ids}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.is_byte = frozenset(self.byte_of)
        plain = [i for i in ids if i not in self.silent and i not in self.unknown and i not in self.byte_of and not sp.is_unused(i)]
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {self.piece[i]: order[sp.get_score(i)] for i in plain}
        self.known = frozenset(p for p in self.rank if len(p) == 1)
        if len(self.byte_id) != 256 or any(SPACE in p.lstrip(SPACE) or not self.known.issuperset(p) for p in self.rank):
            raise ValueError("the vocabulary is not byte-pair pieces with byte fallback and leading spaces")
        self.inside = frozenset(p[k:k + 2] for p in self.rank for k in range(len(p) - 1))
        self.found = ahocorasick.Automaton()
        for i in plain:
            self.found.add_word(self.piece[i], (len(self.piece[i]), i))
        self.found.make_automaton()
        self.states: dict[int, tuple | None] = {}
        self.pairs = PairMemo(self._may_follow)
        self._arrays()

    def _arrays(self) -> None:
        """The same automaton and tests as arrays, to fill the tables of many words in step."""
        self.class_of = np.zeros(0x110000, np.int32)
        for k, c in enumerate(sorted(self.known), 1):
            self.class_of[ord(c)] = k
        self.width = len(self.known) + 1
        self.side_by_side = np.zeros(self.width * self.width, bool)
        for a, b in self.inside:
            self.side_by_side[self.class_of[ord(a)] * self.width + self.class_of[ord(b)]] = True
        step: dict[int, int] = {}
        named = [-1]
        ids = {p: i for i, p in enumerate(self.piece) if p in self.rank and i not in self.byte_of and self._states(i)}
        for piece, i in ids.items():
            node = 0
            for c in piece:
                key = node * self.width + int(self.class_of[ord(c)])
                if key not in step:
                    step[key] = len(named)
                    named.append(-1)
                node = step[key]
            named[node] = i
        self.steps = Slots(18)
        self.steps.put(list(step), list(step.values()))
        self.named = np.array(named, np.int32)

    def _states(self, i: int) -> tuple | None:
        """Merges of one piece alone: (score rank of the next merge, first symbol, last symbol) before each; None if
        merging its characters ends elsewhere."""
        if i in self.states:
            return self.states[i]
        row, seen = list(self.piece[i]), []
        while True:
            best, at = min(((self.rank.get(row[k] + row[k + 1], NEVER), k) for k in range(len(row) - 1)), default=(NEVER, 0))
            seen.append((best, row[0], row[-1]))
            if best == NEVER:
                break
            row[at:at + 2] = [row[at] + row[at + 1]]
        self.states[i] = tuple(seen) if len(row) == 1 else None
        return self.states[i]

    def _may_follow(self, left: int, right: int) -> bool:
        a, b = self._states(left), self._states(right)
        i = j = 0
        while True:
            (ra, _, x), (rb, y, _) = a[i], b[j]
            c = self.rank.get(x + y, NEVER)
            if c < ra and c <= rb:
                return False
            if ra == NEVER and rb == NEVER:
                return True
            if ra <= rb:
                i += 1
            else:
                j += 1

    def _part(self, text: str) -> tuple[int, ...]:
        """Ids of a run of known characters."""
        n = len(text)
        last: list = [None] * (n + 1)
        size = [0] * (n + 1)
        pairs = self.pairs
        for end, (length, i) in self.found.iter(text):
            end += 1
            if last[end] is None:
                start = end - length
                if start == 0:
                    good = self._states(i) is not None
                else:
                    before = last[start]
                    good = before is not None and self._states(i) is not None and pairs[before << 24 | i]
                if good:
                    last[end], size[end] = i, length
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return tuple(reversed(out))

    def ids_of(self, word: str) -> tuple[int, ...]:
        """Ids of one space and the word behind it.  Characters that no piece holds side by side are cut apart."""
        text = SPACE + word.replace(" ", SPACE)
        out: list[int] = []
        start = 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1:k + 1] not in self.inside:
                part = text[start:k]
                if len(part) > 1 or part in self.known:
                    out.extend(self._part(part))
                else:
                    out.extend(self.byte_id[b] for b in part.encode("utf-8", "replace"))
                start = k
        return tuple(out)

    def ids_of_many(self, words: list[str]) -> list[tuple[int, ...]]:
        """``ids_of`` for many words, one position of all of them at a time."""
        if not words:
            return []
        texts = [SPACE + w.replace(" ", SPACE) for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        kind = self.class_of[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        n = len(kind)
        ends = np.cumsum(sizes)
        first = np.ones(n, bool)
        first[1:] = ~self.side_by_side[kind[:-1] * self.width + kind[1:]]
        first[ends[:-1]] = True
        begins = np.flatnonzero(first)
        part = np.cumsum(first) - 1
        stop = np.append(begins[1:], n)
        slow = np.zeros(len(words), bool)
        slow[np.searchsorted(ends, begins[stop - begins > LOCKSTEP_LENGTH], "right")] = True
        # every piece that starts at each position
        starts, found_end, found_id = [], [], []
        at = np.flatnonzero((kind > 0) & ~np.repeat(slow, sizes))
        node = np.zeros(len(at), np.int64)
        limit = stop[part[at]]
        depth = 0
        while len(at):
            node = self.steps.get(node * self.width + kind[at + depth])
            good = node >= 0
            at, limit, node = at[good], limit[good], node[good].astype(np.int64)
            depth += 1
            i = self.named[node]
            hit = i >= 0
            starts.append(at[hit])
            found_end.append(at[hit] + depth)
            found_id.append(i[hit])
            go = at + depth < limit
            at, limit, node = at[go], limit[go], node[go]
        start, end, ident = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, found_end, found_id))
        where = end - begins[part[end - 1]]
        order = np.argsort(where.astype(np.int16), kind="stable")
        start, end, ident, where = start[order], end[order], ident[order].astype(np.int64), where[order]
        last = np.full(n + 1, -1, np.int64)  # the last piece of the prefix that ends before this position
        length = np.ones(n + 1, np.int64)
        cuts = np.searchsorted(where, np.arange(1, (where[-1] if len(where) else 0) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            s, e, i = start[lo:hi], end[lo:hi], ident[lo:hi]
            alone = first[s]
            before = last[s]
            ok = alone.copy()
            ask = np.flatnonzero(~alone & (before >= 0))
            ok[ask] = self.pairs.many(before[ask] << 24 | i[ask])
            last[e[ok]], length[e[ok]] = i[ok], e[ok] - s[ok]
        # ids backwards from the end of each part
        final = np.zeros(n + 1, bool)
        cursor, floor = stop.copy(), begins.copy()
        while len(cursor):
            final[cursor] = True
            cursor = cursor - length[cursor]
            go = cursor > floor
            cursor, floor = cursor[go], floor[go]
        spots = np.flatnonzero(final)
        ids = last[spots].tolist()
        bounds = np.searchsorted(spots, ends, "right").tolist()
        out, lo = [], 0
        unknown = np.zeros(len(words), bool)
        unknown[np.searchsorted(ends, np.flatnonzero(kind == 0), "right")] = True
        hard, unknown, spots = slow.tolist(), unknown.tolist(), spots if unknown.any() else None
        base = 0
        for w, hi in enumerate(bounds):
            if hard[w]:
                out.append(self.ids_of(words[w]))
            elif unknown[w]:
                row = []
                for k in range(lo, hi):
                    row.extend((ids[k],) if ids[k] >= 0 else [self.byte_id[b] for b in texts[w][spots[k] - 1 - base].encode("utf-8", "replace")])
                out.append(tuple(row))
            else:
                out.append(tuple(ids[lo:hi]))
            lo, base = hi, base + len(texts[w])
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """The text cut before spaces, the first of each cut's spaces left out; the text has a space put before it."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(" " + text)]

    def encode(self, text: str | None) -> list[int]:
        return [*chain.from_iterable(map(self.ids_of, self.words(text or ""))), self.end_id]

    def decode(self, ids) -> str:
        """Text of ids: control ids are silent, byte ids join to characters, one leading space goes."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i in self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.piece[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out).removeprefix(SPACE).replace(SPACE, " ")


class Slots:
    """Numbers by number, asked for in bulk: open addressing in arrays."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, 0
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.values = np.zeros((1 << bits) + 64, np.int32)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: list[int], values: list[int]) -> None:
        for key, spot, value in zip(keys, self._spot(np.array(keys, np.int64)).tolist(), values):
            while self.keys[spot] not in (-1, key):
                spot += 1
            self.count += self.keys[spot] == -1
            self.keys[spot], self.values[spot] = key, value

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1 for keys that are not there."""
        spot = self._spot(keys)
        there = self.keys[spot]
        out = np.where(there == keys, self.values[spot], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            spot[left] += 1
            there = self.keys[spot[left]]
            good = there == keys[left]
            out[left[good]] = self.values[spot[left[good]]]
            left = left[~good & (there != -1)]
        return out


class PairMemo(dict):
    """Verdicts by pair of ids; forgotten all at once when there are too many."""

    def __init__(self, make, bits: int = 21):
        super().__init__()
        self.make, self.slots = make, Slots(bits)

    def __missing__(self, key: int) -> bool:
        return self.make(key >> 24, key & 0xFFFFFF)

    def many(self, keys: np.ndarray) -> np.ndarray:
        said = self.slots.get(keys)
        if (said < 0).any():
            new = np.unique(keys[said < 0]).tolist()
            if self.slots.count + len(new) > 1 << (self.slots.bits - 1):
                self.slots = Slots(self.slots.bits)
            for k in range(0, len(new), 1 << (self.slots.bits - 2)):
                some = new[k:k + (1 << (self.slots.bits - 2))]
                self.slots.put(some, [self.make(x >> 24, x & 0xFFFFFF) for x in some])
            missing = said < 0
            said[missing] = self.slots.get(keys[missing])
            for k in np.flatnonzero(said < 0).tolist():
                said[k] = self[int(keys[k])]
        return said > 0


_tables: dict[bytes, PrefixTable] = {}


def table(proto: bytes) -> PrefixTable:
    """The worker's encoder, built once."""
    key = hashlib.sha256(proto).digest()
    if key not in _tables:
        _tables[key] = PrefixTable(proto)
    return _tables[key]


def encode(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array, end id last), decoded: every whole text and what its ids stand for.

    A null or empty text has the end id alone and decodes to the empty text.  Repeated rows each get their row.
    """
    proto = model_bytes(model)

    def make():
        coder = table(proto)
        memo = WordMemo(coder)

        def many(texts):
            lists = [coder.words(t or "") for t in texts]
            memo.learn(lists)
            for words in lists:
                ids = [*chain.from_iterable(map(memo.__getitem__, words)), coder.end_id]
                yield ids, coder.decode(ids)
        return many

    return map_texts(df, "ids array<long>, decoded string", make)


def digests(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the ids and the decoded text do not leave the task."""
    proto = model_bytes(model)

    def make():
        coder = table(proto)
        shield = coder.byte_id[ord("x")]  # keeps the word's own leading space

        def value(ids):
            return " ".join(map(str, ids)), len(ids), coder.decode((shield, *ids))[1:]
        memo = WordMemo(coder, value)

        def many(texts):
            lists = [coder.words(t or "") for t in texts]
            memo.learn(lists)
            for words in lists:
                found = list(map(memo.__getitem__, words))
                ids = " ".join([*[f[0] for f in found], str(coder.end_id)])
                plain = "".join([f[2] for f in found])[1:]
                yield sum([f[1] for f in found]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()
        return many

    return map_texts(df, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def token_counts(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens without an end id; only the number is wanted, so the tokenizer library counts and nothing is kept."""
    proto = model_bytes(model)

    def make():
        coder = sentencepiece.SentencePieceProcessor(model_proto=proto)
        return lambda texts: ((len(coder.encode((t or "").encode("utf-8", "replace").decode("utf-8"))),) for t in texts)

    return map_texts(df, "n_tokens long", make)
