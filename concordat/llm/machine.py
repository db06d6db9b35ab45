"""A byte-pair tokenizer compiled into a deterministic machine that reads bytes.

Of the tokens of a word's prefix only the last ones matter for what follows: a sequence of tokens is
the one that the merges make if no merge crosses the border of any two neighbours, which is a
matter of these two alone. The token that ends at a byte is therefore the one token that is a suffix of
the prefix and does not merge with the token before its start. A state of the machine holds what
this needs: the longest suffix that some token begins with, and for each place where a token may
still begin, the token that ends there and how many tokens lie behind it. A transition is annotated
with the change in the number of tokens; along a word these changes add up to its count, and the
states' own tokens, read backwards, are its ids. The last byte of a word is a symbol of its own,
since merges treat it so.

States and transitions are compiled from the merge table when they are first reached and kept in one
table of bounded size; when that is full, everything is forgotten and compiled anew, which costs time
and never a result. All words of many texts go through the machine side by side, one byte of each in
a step.

Before that, texts are normalised (NFC, lower case) and cut into words: contractions, runs of letters,
single digits, runs of other marks. White space separates and is dropped. Strings of special tokens are
tokens of their own.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Classes of characters.
SPACE, LETTER, DIGIT, OTHER, SPECIAL = range(5)
#: White space of the tokenizer's patterns (fixed values).
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters, digits and capitals that Unicode has had for less long than Python's tables (fixed values).
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_DIGITS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LATER_CASES = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)
LATER_CAPITALS = re.compile("[" + "".join(map(chr, LATER_CASES)) + "]")
#: The pre-tokenizer's pattern that is compiled here (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level merges spell a byte that prints as itself, any other as the next free character.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in _PRINTS} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PRINTS)}
#: Added to the last byte of a word.
LAST = 256
#: Bytes that no UTF-8 text has stand for special tokens.
STAND_INS = (0xFF, 0xFE, 0xFD, 0xFC)
BIAS = 1 << 15
FREE = np.uint64((1 << 64) - 1)
SPREAD = 0x9E3779B97F4A7C15
#: Fewer words than this are cheaper byte by byte.
FEW = 24
GROUP_BYTES = 1 << 19


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": DIGIT}
    found = np.frombuffer(bytes(kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8).copy()
    for kind, ranges in ((LETTER, LATER_LETTERS), (DIGIT, LATER_DIGITS)):
        for first, last in ranges:
            found[first : last + 1] = kind
    found[WHITE_SPACE] = SPACE
    return found


@lru_cache(maxsize=1)
def byte_classes() -> np.ndarray:
    found = np.full(256, OTHER, dtype=np.uint8)
    found[:128] = classes()[:128]
    found[list(STAND_INS)] = SPECIAL
    return found


def lower_case(text: str) -> str:
    """Each character for itself: the sigma that ends a word is no exception."""
    if LATER_CAPITALS.search(text):
        text = text.translate(LATER_CASES)
    return text.replace("Σ", "σ").lower()


def supported(spec: dict) -> bool:
    """Whether a tokenizer file is of the family this module compiles."""
    normal = [(n.get("type"), (n.get("pattern") or {}).get("Regex"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] or len(steps) != 2:
        return False
    split, level, model = steps[0], steps[1], spec.get("model") or {}
    words = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and (split.get("pattern") or {}).get("Regex") == PATTERN
    raw = level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex")
    merges = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    added = spec.get("added_tokens") or []
    plain = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) and not re.search(r"\s", t["content"]) for t in added)
    return bool(words and raw and merges and plain and len(added) <= len(STAND_INS))


class Merges:
    """The merge table: how tokens come about, and whether two of them stay apart."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not supported(spec):
            raise ValueError(f"{os.path.basename(path)}: only lower-casing tokenizers that drop white space are compiled")
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.special = {t["content"].encode("utf-8"): (bytes([b]), t["id"]) for b, t in zip(STAND_INS, spec.get("added_tokens") or [])}
        #: Symbols of each token, its two parts and the turn at which the merge of these comes.
        size = max([*vocab.values(), *(i for _, i in self.special.values())]) + 1
        self.symbols: dict[int, tuple[int, ...]] = {}
        self.first, self.second, self.turn = (array("i", [0]) * size for _ in range(3))
        self.merged: dict[int, int] = {}
        for b, c in SPELLED.items():
            for token, symbol in ((vocab[c], b), (vocab[c + end], b + LAST)):
                self.symbols[token] = (symbol,)
        for turn, (a, b) in enumerate(pairs, 1):
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            if whole in self.symbols:
                raise ValueError(f"{os.path.basename(path)}: a token that two merges make is not compiled")
            self.symbols[whole] = self.symbols[a] + self.symbols[b]
            self.first[whole], self.second[whole], self.turn[whole], self.merged[a << 32 | b] = a, b, turn, turn
        self.lengths = np.zeros(size, dtype=np.int64)
        for token, symbols in self.symbols.items():
            self.lengths[token] = len(symbols)
        self._sound: dict[int, bool] = {}

    def _meet(self, a: int, b: int, until: int) -> bool:
        """Whether some merge joins the end of ``a`` to the begin of ``b`` before turn ``until``. The pieces at
        the border are followed back in time, the younger one being taken apart first. Of two merges
        of one kind the left one comes first, so a merge in ``b`` also gives way at its own turn."""
        left_wins = False
        while True:
            at = self.merged.get(a << 32 | b)
            if at is not None and (at < until or (left_wins and at == until)):
                return True
            if self.turn[a] > self.turn[b]:
                until, a, left_wins = self.turn[a], self.second[a], False
            elif self.turn[b]:
                until, b, left_wins = self.turn[b], self.first[b], True
            else:
                return False

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens that follow each other stay as they are."""
        return not self._meet(a, b, len(self.merged) + 1)

    def sound(self, token: int) -> bool:
        """Whether the merges make this token of its own symbols."""
        found = self._sound.get(token)
        if found is None:
            a, b, turn = self.first[token], self.second[token], self.turn[token]
            found = self._sound[token] = not turn or (self.sound(a) and self.sound(b) and not self._meet(a, b, turn))
        return found


class Prefixes:
    """The tree of the tokens' symbols with links to the longest proper suffix that is in it too."""

    def __init__(self, merges: Merges):
        self.child: dict[int, int] = {}
        self.depth, self.token, below = [0], [-1], [[]]
        for token, symbols in merges.symbols.items():
            if not merges.sound(token):
                continue
            node = 0
            for s in symbols:
                key = node << 9 | s
                found = self.child.get(key)
                if found is None:
                    found = self.child[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                    below[node].append((s, found))
                    below.append([])
                node = found
            self.token[node] = token
        self.link = [0] * len(self.depth)
        level = [n for _, n in below[0]]
        while level:
            following = []
            for node in level:
                for s, n in below[node]:
                    self.link[n] = self.go(self.link[node], s)
                    following.append(n)
            level = following
        self._chain: dict[int, tuple] = {}

    def go(self, node: int, symbol: int) -> int:
        while True:
            found = self.child.get(node << 9 | symbol)
            if found is not None:
                return found
            if not node:
                return 0
            node = self.link[node]

    def chain(self, node: int) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...]]:
        """The lengths of all suffixes in the tree, the longest first, and the tokens among them with the
        place, counted back from before the last symbol, where each begins."""
        found = self._chain.get(node)
        if found is None:
            depths, ends, n = [], [], node
            while n:
                depths.append(self.depth[n])
                if self.token[n] >= 0:
                    ends.append((self.token[n], self.depth[n] - 1))
                n = self.link[n]
            found = self._chain[node] = (tuple(depths), tuple(ends))
        return found


class Machine:
    """``most_states`` bounds the table: a state and its transitions take some 400 bytes together.

    A state is kept as one flat tuple: its node, the token that ends there, and for each of the node's
    suffixes, the longest first, the token that ends before it and the change in the number of tokens
    from here back to there."""

    def __init__(self, path: str, most_states: int = 200_000):
        self.merges = Merges(path)
        self.tree = Prefixes(self.merges)
        self.most_states = most_states
        self.merges.symbols, self.merges._sound = {}, {}  # only the tree needs them
        self.lengths = self.merges.lengths
        self.alone = {b[0] + LAST: token for b, token in self.merges.special.values()}
        self.lengths[list(self.alone.values())] = 1
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + b")") if self.merges.special else None
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.ends = np.full(1 << 12, -1, dtype=np.int32)  # the token that ends at each state
        self.used, self.bits = 0, 14
        self.keys, self.values = np.full(1 << self.bits, FREE), np.zeros(1 << self.bits, dtype=np.int64)
        self._state((0, -1))

    def _state(self, key: tuple[int, ...]) -> int:
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.known)
            self.known.append(key)
            if found >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.full(len(self.ends), -1, dtype=np.int32)])
            self.ends[found] = key[1]
        return found

    # --- compiling ------------------------------------------------------------------------

    def _transition(self, state: int, symbol: int) -> int:
        """The value of a transition: the state it leads to, or the complement of the word's last token,
        and the change in the number of tokens."""
        if not state and symbol in self.alone:
            return (~self.alone[symbol] << 16) + BIAS + 1
        key = self.known[state]
        at = {0: (key[1], 0)}
        for k, back in enumerate(self.tree.chain(key[0])[0], 1):
            at[back] = (key[2 * k], key[2 * k + 1])
        node = self.tree.go(key[0], symbol)
        depths, ends = self.tree.chain(node)
        for token, back in ends:
            before, n = at[back]
            if before < 0 or self.merges.apart(before, token):
                break
        else:
            raise AssertionError("a symbol is a token, and one that stays apart from any other")
        change = n + 1
        if symbol >= LAST:
            return (~token << 16) + BIAS + change
        flat = [node, token]
        for depth in depths:
            before, n = at[depth - 1]
            flat += (before, n - change)
        return (self._state(tuple(flat)) << 16) + BIAS + change

    def _place(self, key: int) -> int:
        """The slot of a key, or the free one where it belongs."""
        mask = (1 << self.bits) - 1
        slot = ((key * SPREAD) & ((1 << 64) - 1)) >> (64 - self.bits)
        while (found := int(self.keys[slot])) != key and found != int(FREE):
            slot = (slot + 1) & mask
        return slot

    def _add(self, key: int) -> None:
        if 5 * self.used > 2 << self.bits:
            kept = np.flatnonzero(self.keys != FREE)
            keys, values = self.keys[kept], self.values[kept]
            self.bits += 1
            self.keys, self.values = np.full(1 << self.bits, FREE), np.zeros(1 << self.bits, dtype=np.int64)
            for k, v in zip(keys.tolist(), values.tolist()):
                slot = self._place(k)
                self.keys[slot], self.values[slot] = k, v
        slot = self._place(key)
        if self.keys[slot] == FREE:
            self.keys[slot], self.values[slot] = key, self._transition(key >> 9, key & 511)
            self.used += 1

    # --- running --------------------------------------------------------------------------

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(SPREAD)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        values = self.values[slots]
        other = np.flatnonzero(self.keys[slots] != keys)
        if len(other):
            values[other] = self._probe(keys[other])
        return values

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        while True:
            left, slots, missing = np.arange(len(keys)), self._slots(keys), []
            while len(left):
                found = self.keys[slots]
                hit, free = found == keys[left], found == FREE
                out[left[hit]] = self.values[slots[hit]]
                if free.any():
                    missing.append(keys[left[free]])
                going = ~(hit | free)
                left, slots = left[going], (slots[going] + 1) & ((1 << self.bits) - 1)
            if not missing:
                return out
            for key in np.unique(np.concatenate(missing)).tolist():
                self._add(key)

    def _value(self, key: int) -> int:
        slot = self._place(key)
        if self.keys[slot] == FREE:
            self._add(key)
            slot = self._place(key)
        return int(self.values[slot])

    def run(self, text: np.ndarray, first: np.ndarray, length: np.ndarray, states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each word and its last token. ``states`` takes the state after each byte
        that does not end a word."""
        if len(self.known) > self.most_states:
            self.reset()
        n = len(first)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        longest = int(length.max())
        order = np.argsort((longest - length).astype(np.uint16 if longest < 65_536 else np.int64), kind="stable")
        alive = n - np.cumsum(np.bincount(length, minlength=longest + 2))  # words of more than k bytes
        at, total, state = first[order], np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        k = 0
        while k < longest and (m := int(alive[k])) >= FEW:
            on = int(alive[k + 1])
            place = at[:m] + k
            key = text[place].astype(np.uint64)
            key[on:] += np.uint64(LAST)
            key |= state[:m].view(np.uint64) << np.uint64(9)
            value = self._look_up(key)
            total[:m] += (value & 0xFFFF) - BIAS
            state[:m] = value >> 16
            if states is not None and on:
                states[place[:on]] = state[:on]
            k += 1
        for j in range(int(alive[k]) if k < longest else 0):
            begin, size, now, sum_ = int(at[j]), int(length[order[j]]), int(state[j]), int(total[j])
            for i, byte in enumerate(text[begin + k : begin + size].tolist(), k + 1):
                value = self._value(now << 9 | byte + LAST * (i == size))
                now, sum_ = value >> 16, sum_ + (value & 0xFFFF) - BIAS
                if states is not None and i < size:
                    states[begin + i - 1] = now
            state[j], total[j] = now, sum_
        counts, last = np.empty(n, np.int64), np.empty(n, np.int64)
        counts[order], last[order] = total, ~state
        return counts, last

    # --- texts ----------------------------------------------------------------------------

    def normal(self, text: bytes) -> bytes:
        if self.specials is not None and b"<" in text and self.specials.search(text):
            parts = self.specials.split(text)
            return b"".join(b" " + self.merges.special[p][0] + b" " if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    @staticmethod
    def _plain(text: bytes) -> bytes:
        if text.isascii():
            return text.lower()
        chars = text.decode("utf-8")
        if not unicodedata.is_normalized("NFC", chars):
            chars = unicodedata.normalize("NFC", chars)
        return lower_case(chars).encode("utf-8")

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts as one row of bytes, begins and lengths of the words, and the number of words before
        each text, with their total at the end."""
        normal = [self.normal(t) for t in texts]
        text = np.frombuffer(b"\n".join(normal) + b"\n", dtype=np.uint8)
        kind = byte_classes()[text]
        self._mark_wide(text, kind)
        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        change = kind != before
        change |= (kind == DIGIT) & ((text < 0x80) | (text >= 0xC0))
        change |= kind == SPECIAL
        self._contract(text, kind, change)
        border = np.flatnonzero(change)
        begins = kind[border] != SPACE
        begins[-1:] = False
        first = border[begins]
        length = border[np.flatnonzero(begins) + 1] - first
        starts = np.cumsum([0, *(len(x) + 1 for x in normal)])
        return text, first, length, np.searchsorted(first, starts)

    @staticmethod
    def _mark_wide(text: np.ndarray, kind: np.ndarray) -> None:
        """Classes of characters of several bytes, at each of these."""
        lead = np.flatnonzero((text >= 0xC0) & (text < 0xF8))
        if not len(lead):
            return
        size = 2 + (text[lead] >= 0xE0) + (text[lead] >= 0xF0)
        for n in (2, 3, 4):
            at = lead[size == n]
            if len(at):
                code = (text[at] & (0xFF >> (n + 1))).astype(np.int64)
                for k in range(1, n):
                    code = code << 6 | (text[at + k] & 0x3F)
                found = classes()[code]
                for k in range(n):
                    kind[at + k] = found

    @staticmethod
    def _contract(text: np.ndarray, kind: np.ndarray, change: np.ndarray) -> None:
        """An apostrophe that begins a run of marks and the letters of a contraction after it are one word."""
        at = np.flatnonzero((text == ord("'")) & change)
        one, two = text[np.minimum(at + 1, len(text) - 1)], text[np.minimum(at + 2, len(text) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, n in ((at[short], 1), (at[long], 2)):
            change[found + 1] = False
            rest = found + 1 + n
            change[rest[kind[rest] == LETTER]] = True

    def count(self, texts: list[bytes]) -> list[int]:
        """The number of tokens of each text."""
        out: list[int] = []
        for group in grouped(texts):
            text, first, length, bounds = self.words(group)
            sums = np.concatenate([[0], np.cumsum(self.run(text, first, length)[0])])[bounds]
            out += np.diff(sums).tolist()
        return out

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        out: list[np.ndarray] = []
        for group in grouped(texts):
            text, first, length, bounds = self.words(group)
            states = np.zeros(len(text), dtype=np.int32)
            counts, token = self.run(text, first, length, states)
            ends = np.cumsum(counts)
            found = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<u4")
            place, at = ends - 1, first + length  # where the next token, from the back, goes and ends
            while len(place):
                found[place] = token
                at = at - self.lengths[token]
                more = at > first
                if not more.any():
                    break
                place, at, first = place[more] - 1, at[more], first[more]
                token = self.ends[states[at - 1]].astype(np.int64)
            cuts = np.concatenate([[0], ends])[bounds].tolist()
            out += [found[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


def grouped(texts: list[bytes]):
    """Texts that go through the machine together."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


@lru_cache(maxsize=2)
def machine(path: str, most_states: int) -> Machine:
    """One per worker process, so that later tasks find the table filled."""
    return Machine(path, most_states)
