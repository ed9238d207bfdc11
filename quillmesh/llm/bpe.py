"""Byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of each new word. A proposal is right if and
only if each token is its own encoding and every two neighbours are compatible: merging
the two side by side would never cross their border. That is tested for all distinct
neighbours of a batch at once. Only words that fail are merged exactly. Proposals and
merges, too, advance in all words of a batch at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies of this kind part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only are parted by the equal, faster pattern of the standard library.
PLAIN, _ALPHA = r"[^\x00-\x1b\x20-\x7f\u00c0-\u024f]", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_ALPHA}]+| ?[0-9]+| ?[^\s0-9{_ALPHA}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers before it starts afresh; longer words are not kept.
CACHE_WORDS, CACHE_LENGTH = 100_000, 64
#: Words that are encoded at once, and the bytes beyond which a word is merged by itself.
BATCH_WORDS, MERGE_BYTES = 1 << 14, 64
#: A rank beyond all; a rank and a place share a number while words are merged.
_NEVER, _PLACE_BITS = np.int64(1) << 30, 32
_OVER, _PLACE = _NEVER << _PLACE_BITS, (np.int64(1) << _PLACE_BITS) - 1


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names = {chr(b): b for b in plain}
    names.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    return names


class _Table:
    """Hash table of arrays: looks up many keys of 0 or more at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = (4 * len(keys)).bit_length() + 1
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self._keys[at] < 0
            self._keys[at[free]] = keys[free]
            put = self._keys[at] == keys
            self._values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        seen, out = self._keys[at], self._values[at]
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            at[open_] = slot = (at[open_] + 1) & self._mask
            seen, out[open_] = self._keys[slot], self._values[slot]
            open_ = open_[(seen != keys[open_]) & (seen >= 0)]
        return out


class Bpe:
    """Encoder and decoder of one tokenizer file (JSON of byte-level BPE)."""

    def __init__(self, spec: str | dict):
        spec = json.loads(spec) if isinstance(spec, str) else spec
        model, names = spec["model"], _byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max(*self.ids.values(), *self.added.values(), 0) + 1
        self.bytes = [b""] * size
        for t, i in self.ids.items():
            self.bytes[i] = t
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.ids[raw(a)] for a, _ in pairs], np.int64)
        right = np.array([self.ids[raw(b)] for _, b in pairs], np.int64)
        made = np.array([self.ids[raw(a + b)] for a, b in pairs], np.int64)
        self.size = size
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        at, first = np.unique(made, return_index=True)
        self.rank[at], self.left[at], self.right[at] = first, left[first], right[first]
        self.merges = dict(zip((left * size + right).tolist(), range(len(made))))
        self._rank_of = _Table(*(np.fromiter(v, np.int64, len(self.merges)) for v in (self.merges, self.merges.values())), _NEVER)
        self._made, self.made = made, made.tolist()
        self._single = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        # a node for each beginning of a token; node 0 is the empty one, the last stands for none
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for t, i in self.ids.items():
            node = 0
            for b in t:
                node = steps.setdefault(node << 8 | b, len(steps) + 1)
            ends[node] = i
        self._step = _Table(*(np.fromiter(v, np.int64, len(steps)) for v in (steps, steps.values())), -1)
        self._token = np.full(len(steps) + 2, -1, np.int64)
        for node, i in ends.items():
            self._token[node] = i
        # a token can be proposed if a merge tree makes it and its parts are compatible
        tokens = np.flatnonzero(self.rank >= 0)
        self.sound = np.zeros(size, bool)
        self.sound[[i for t, i in self.ids.items() if len(t) == 1]] = True
        self.sound[tokens] = (np.maximum(self.rank[self.left[tokens]], self.rank[self.right[tokens]]) < self.rank[tokens]) & (len(at) == len(made))
        self.sound[tokens] &= self.compatible(self.left[tokens], self.right[tokens], self.rank[tokens])
        for t in tokens[np.argsort(self.rank[tokens])]:
            self.sound[t] &= self.sound[self.left[t]] and self.sound[self.right[t]]
        self._pattern, self._plain, self._odd = regex.compile(PATTERN), re.compile(PLAIN_PATTERN), re.compile(PLAIN)
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._cache: dict[str | int, tuple[int, ...]] = {i: (i,) for i in self.added.values()}
        self._older: dict[str | int, tuple[int, ...]] = {}
        self.checked = self.failed = 0

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._rank_of(a * self.size + b)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE leaves the border between tokens ``a`` and ``b`` alone, for arrays of pairs.

        Walks back in time along the border: of the two pieces that touch it, the one
        made last is undone, until both are bytes. If at some time the touching
        pieces have a merge that comes before the merge that consumes either piece
        (the left neighbour's own merge goes first at equal rank), the border falls.
        ``until``: the rank of the merge that then joins the pair, which is allowed.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        px = np.full(len(a), _NEVER) if until is None else until.astype(np.int64)
        py = px.copy()
        while len(live):
            r = self._pair_rank(x, y)
            falls = (r < px) & (r <= py) & (r < _NEVER)
            ok[live[falls]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~falls & ((rx >= 0) | (ry >= 0))
            live, x, y, px, py, rx, ry = (v[go] for v in (live, x, y, px, py, rx, ry))
            back_y = ry >= rx
            px, py = np.where(back_y, px, rx), np.where(back_y, ry, py)
            x, y = np.where(back_y, x, self.right[x]), np.where(back_y, self.left[y], y)
        return ok

    def propose(self, text: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over the vocabulary, in words of a byte or more that lie in a row.

        ``ends``: where the word of each byte ends; ``starts``: where the words begin. Returns
        the token that begins at each byte (-1: none) and the places where no token fits.
        """
        longest, jump = np.full(len(text), -1, np.int64), np.arange(len(text))
        begin, node, deep = jump.copy(), np.zeros(len(text), np.int64), 0
        while len(begin):
            node = self._step(node << 8 | text[begin + deep])
            deep += 1
            token = self._token[node]
            found = begin[token >= 0]
            longest[found], jump[found] = token[token >= 0], found + deep
            go = (node >= 0) & (begin + deep < ends[begin])
            begin, node = begin[go], node[go]
        # the places that a word's first byte leads to, jumping twice as far each time
        met, jump = np.zeros(len(text) + 1, bool), np.append(jump, len(text))
        met[starts] = True
        while True:
            there = jump[np.flatnonzero(met)]
            if met[there].all():
                break
            met[there] = True
            jump = jump[jump]
        met = met[:-1]
        return np.where(met, longest, -1), np.flatnonzero(met & (longest < 0))

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, the lowest rank first and leftmost first; bytes without a token are left out."""
        ids, merges, made, size, never = self.ids, self.merges, self.made, self.size, len(self.made)
        parts = [t for t in map(ids.get, [word[i : i + 1] for i in range(len(word))]) if t is not None]
        if len(parts) > 256:
            return self._merge_long(parts)
        ranks = [merges.get(a * size + b, never) for a, b in zip(parts, parts[1:])]
        while ranks:
            r = min(ranks)
            if r == never:
                break
            i = ranks.index(r)
            parts[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get(parts[i - 1] * size + parts[i], never)
            if i < len(ranks):
                ranks[i] = merges.get(parts[i] * size + parts[i + 1], never)
        return parts

    def _merge_long(self, parts: list) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        merges, made, size, n = self.merges, self.made, self.size, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := merges.get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := merges.get(parts[left] * size + parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def merge_all(self, text: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """``merge`` of words that lie in a row: a round joins the lowest pair of every word, the leftmost first.

        ``owner``: the word of each byte. Returns the token that begins at each byte, -1 where none does.
        """
        out = self._single[text]
        place = np.flatnonzero(out >= 0)
        n = len(place)
        if not n:
            return out
        parts, owner = np.append(out[place], 0), np.append(owner[place], -1)
        starts = np.flatnonzero(np.diff(owner[:-1], prepend=-1))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        low = np.full(n + 1, _OVER)

        def rate(left: np.ndarray, right: np.ndarray) -> None:
            rank = np.where(owner[left] == owner[right], self._pair_rank(parts[left], parts[right]), _NEVER)
            low[left] = rank << _PLACE_BITS | np.maximum(left, 0)

        rate(np.arange(n), after[:-1])
        while True:
            pair = np.minimum.reduceat(low[:-1], starts)
            pair = pair[pair < _OVER]
            if not len(pair):
                break
            i = pair & _PLACE
            j = after[i]
            parts[i], parts[j], low[j] = self._made[pair >> _PLACE_BITS], -1, _OVER
            after[i] = beyond = after[j]
            before[beyond] = i
            rate(np.concatenate([before[i], i]), np.concatenate([i, beyond]))
        out[place] = parts[:-1]
        return out

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word: proposals where every neighbour pair is verified, exact merging elsewhere."""
        return [ids for low in range(0, len(words), BATCH_WORDS) for ids in self._encode_words(words[low : low + BATCH_WORDS])]

    def _encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        text, end = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.cumsum(length)
        owner = np.repeat(np.arange(len(raw)), length)
        got, stuck = self.propose(text, end[owner], (end - length)[length > 0])
        bad = np.zeros(len(raw), bool)
        bad[owner[stuck]] = True
        at = np.flatnonzero(got >= 0)
        flat, of = got[at], owner[at]
        bad[of[~self.sound[flat]]] = True
        inner = np.flatnonzero((of[1:] == of[:-1]) & ~bad[of[1:]])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad[of[inner[~self.compatible(pairs // self.size, pairs % self.size)[back]]]] = True
        again = np.flatnonzero((bad & (length <= MERGE_BYTES))[owner])
        got[again] = self.merge_all(text[again], owner[again])
        ids = got >= 0
        many, flat = np.bincount(owner[ids], minlength=len(raw)), tuple(got[ids].tolist())
        ends = np.cumsum(many)
        out = [flat[a:b] for a, b in zip((ends - many).tolist(), ends.tolist())]
        for i in np.flatnonzero(bad & (length > MERGE_BYTES)).tolist():
            out[i] = tuple(self.merge(raw[i]))
        self.checked, self.failed = self.checked + len(raw), self.failed + int(bad.sum())
        return out

    def _find(self, text: str) -> list[str]:
        return (self._pattern if self._odd.search(text) else self._plain).findall(text)

    def parts(self, text: str) -> list:
        """The words of a text; ids of added tokens stand as ints."""
        if self._added is None or not self._added.search(text):
            return self._find(text)
        out, at = [], 0
        for m in self._added.finditer(text):
            out += [*self._find(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return out + self._find(text[at:])

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; null encodes as the empty text."""
        parted = [self.parts(t or "") for t in texts]
        if len(self._cache) > CACHE_WORDS:
            self._older, self._cache = self._cache, {i: (i,) for i in self.added.values()}
        known, older = self._cache, self._older
        met = set().union(*parted).difference(known)
        again = {w: older[w] for w in met if w in older}
        known.update(again)
        new = list(met.difference(again))
        fresh = dict(zip(new, self.encode_words(new)))
        long = {w: ids for w, ids in fresh.items() if len(w) > CACHE_LENGTH}
        known.update(fresh)
        out = [list(chain.from_iterable(map(known.__getitem__, words))) for words in parted]
        for w in long:
            del known[w]
        return out

    def decode(self, ids) -> str:
        """Text of token ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(spec: str) -> Bpe:
    """The encoder of a tokenizer file's content; one for each worker process."""
    return Bpe(spec)


def read_spec(path: str) -> str:
    """Content of the tokenizer file, read once on the driver and sent with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _slices(texts: pa.Array, rows: int = 64):
    for low in range(0, len(texts), rows):
        yield texts.slice(low, rows).to_pylist()


def encode_column(spec, text: Column) -> Column:
    """``array<int>`` of token ids of each whole text; ``spec``: a Spark broadcast of ``read_spec``."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        bpe = load(spec.value)
        return pa.array([ids for block in _slices(texts) for ids in bpe.encode_batch(block)], pa.list_(pa.int32()))

    return of(text)


def decode_column(spec, ids: Column) -> Column:
    """Text of each array of token ids; a null array gives null."""

    @F.arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        bpe = load(spec.value)
        return pa.array([None if r is None else bpe.decode(r) for block in _slices(rows) for r in block], pa.string())

    return of(ids)


def digest_column(spec, text: Column, ids: bool = False) -> Column:
    """Struct ``n_tokens, ids_sha256, decoded_sha256`` of each whole text, and ``ids`` if asked for: encoded, then decoded from its ids, in one pass.

    A null text is encoded as the empty one, which has no tokens; an empty table gives no rows.
    """
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    @F.arrow_udf(fields)
    def of(texts: pa.Array) -> pa.Array:
        bpe = load(spec.value)
        names = _id_names(bpe.size)
        counts, ids_sha, text_sha, lists = [], [], [], [pa.array([], pa.list_(pa.int32()))]
        for block in _slices(texts):
            encoded = bpe.encode_batch(block)
            for row in encoded:
                counts.append(len(row))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, row)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(row).encode("utf-8", "surrogatepass")).hexdigest())
            if ids:
                lists.append(pa.array(encoded, pa.list_(pa.int32())))
        arrays = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())] + [pa.concat_arrays(lists)] * ids
        return pa.StructArray.from_arrays(arrays, names=["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])

    return of(text)


@lru_cache(maxsize=4)
def _id_names(size: int) -> list[str]:
    return list(map(str, range(size)))
