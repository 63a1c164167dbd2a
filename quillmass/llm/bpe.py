"""Byte-pair vocabularies: pre-splitting, heap merging (token counts) and the tokenization automaton.

Both encoders work on *chunks* (what stands between single blanks). A blank can only begin a new pre-split
word, so a chunk's words do not depend on its neighbours, except where a blank stands between white space;
such texts go through the whole pattern at once. Chunk results are cached per Python worker.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import regex

from .common import BoundedCache

#: The published pre-splitting pattern of byte-level BPE, white space by Unicode property.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The published pattern of the lower-casing vocabulary with word ends.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: A blank or line end between white space, after white space at the end, or a line end before other white space:
#: chunks are not independent there.
_JOINED = re.compile(r"\s[ \n]\s|\s[ \n]\Z|\n[^\S \n]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = {b: chr(b) for b in plain}
    return [shown[b] if b in shown else chr(next(spare)) for b in range(256)]


def style(data: dict) -> str:
    """``byte`` or ``word``: how a tokenizer file splits and normalizes; an error if it is none that this module reads."""
    model, split, normal = data["model"], data.get("pre_tokenizer") or {}, data.get("normalizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    tokens = not any(t.get(k) for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if plain and tokens and not data.get("post_processor"):
        if not normal and not model.get("end_of_word_suffix") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
            return "byte"
        steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
        parts = split.get("pretokenizers", [])
        if (
            steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["pattern"] == {"Regex": WORD_PATTERN.replace(r"\p{White_Space}", r"\s")}
            and (parts[0]["behavior"], parts[0]["invert"]) == ("Removed", True)
            and not parts[1].get("use_regex")
            and not parts[1].get("add_prefix_space")
            and model.get("end_of_word_suffix")
            and not data.get("decoder")
        ):
            return "word"
    raise ValueError("a tokenizer file of another kind: it would be counted or encoded wrongly")


class Vocabulary:
    """The model, merges and added tokens of a tokenizer file of one of the two kinds that are supported."""

    def __init__(self, content: str):
        data = json.loads(content)
        self.style = style(data)
        self.key = hashlib.sha256(content.encode()).hexdigest()
        self.ids: dict[str, int] = data["model"]["vocab"]
        self.word_end: str = data["model"].get("end_of_word_suffix") or ""
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = {t[:2] for t in self.special}
        self.alphabet = byte_alphabet()

    def symbols(self, word: str) -> list[int]:
        """Ids of the initial symbols of a pre-split word."""
        shown = [self.alphabet[b] for b in word.encode("utf-8", "replace")]
        if self.word_end and shown:
            shown[-1] += self.word_end
        return [self.ids[s] for s in shown]

    def parts(self, text: str) -> list[str]:
        """The text cut at the strings of added tokens; these stand at odd places."""
        if self.split_special is None or not any(m in text for m in self.marks):
            return [text]
        return self.split_special.split(text)


class MergeCounter:
    """Counts tokens by heap-and-linked-list merging: initial symbols minus merges, without emitting ids."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.style != "byte":
            raise ValueError("only byte-level vocabularies are counted")
        self.vocabulary = vocabulary
        ids = vocabulary.ids
        self.symbol_of = [ids[c] for c in vocabulary.alphabet]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(vocabulary.merges):
            self.rank.setdefault(ids[left] << 20 | ids[right], rank)
            self.merged.append(ids[left + right])
        self.words = BoundedCache(self.count_word, 100_000)
        self.first = BoundedCache(self.count_words, 50_000)
        self.later = BoundedCache(self.count_later)
        self.pattern = regex.compile(BYTE_PATTERN)

    def count_word(self, word: str) -> int:
        """Tokens of one pre-split word. A heap entry is the pair's rank and its left symbol's place."""
        of = self.symbol_of
        symbol = [of[b] for b in word.encode("utf-8", "replace")]
        n = len(symbol)
        if n < 2:
            return n
        rank, merged = self.rank, self.merged
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbol[i] << 20 | symbol[i + 1])) is not None]
        if not heap:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        merges = 0
        while heap:
            entry = heapq.heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j >= n or symbol[i] < 0 or rank.get(symbol[i] << 20 | symbol[j]) != r:
                continue  # one of the two has been merged meanwhile
            merges += 1
            new = symbol[i] = merged[r]
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(new << 20 | symbol[k])
                if r is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(symbol[h] << 20 | new)
                if r is not None:
                    heapq.heappush(heap, r << 32 | h)
        return n - merges

    def count_words(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.pattern.findall(text)))

    def count_later(self, chunk: str) -> int:
        """Tokens of a chunk with the blank before it; letters alone are one word."""
        return self.count_word(" " + chunk) if chunk.isalpha() else self.count_words(" " + chunk)

    def count(self, text: str) -> int:
        total = 0
        for k, part in enumerate(self.vocabulary.parts(text)):
            if k % 2:
                total += 1
            elif _JOINED.search(part):
                total += self.count_words(part)
            else:
                lines = part.split("\n")
                total += (len(lines) - 1) * self.words["\n"]
                for line in lines:
                    chunks = line.split(" ")
                    total += self.first[chunks[0]] + sum(map(self.later.__getitem__, chunks[1:]))
        return total


class ChunkEncoder:
    """Ids of byte-level BPE: chunks that were met before come from a cache, new ones from a compiled encoder.

    ``encode_ordinary`` gives the ids of a text without added tokens.
    """

    def __init__(self, vocabulary: Vocabulary, encode_ordinary):
        self.vocabulary, self.encode_ordinary = vocabulary, encode_ordinary
        self.newline = self._packed("\n")
        # some 400 bytes for an entry and the one before it; a worker of a pipeline has other stages' memory as well
        self.first = BoundedCache(self._packed, 20_000)
        self.later = BoundedCache(lambda chunk: self._packed(" " + chunk), 60_000)

    def _packed(self, text: str) -> bytes:
        return array("i", self.encode_ordinary(text)).tobytes() if text else b""

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        for k, part in enumerate(self.vocabulary.parts(text)):
            if k % 2:
                out.append(array("i", [self.vocabulary.special[part]]).tobytes())
            elif _JOINED.search(part):
                out.append(self._packed(part))
            else:
                for n, line in enumerate(part.split("\n")):
                    if n:
                        out.append(self.newline)
                    chunks = line.split(" ")
                    out.append(self.first[chunks[0]])
                    out.extend(map(self.later.__getitem__, chunks[1:]))
        return b"".join(out)


def compiled_encoder(vocabulary: Vocabulary):
    """tiktoken over the ranks of a byte-level tokenizer file: the same ids as the file's own library."""
    import tiktoken

    back = {c: b for b, c in enumerate(vocabulary.alphabet)}
    ranks = {bytes(back[c] for c in s): i for s, i in vocabulary.ids.items()}
    return tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Automaton:
    """A deterministic automaton over tokens that accepts exactly the canonical tokenizations.

    It starts as one state with a loop for every initial symbol. The merge gadget of (u, v), in rank order:
    u gets a state of its own (a copy of the state that its arcs led to), the arc v goes from that state, and
    wherever an arc u leaves there is now also an arc uv, to the state behind v. As an arc's label decides its
    target, ``target[label]`` holds the arcs' ends.

    Transitions are tables. Labels are numbered so that uv follows u, with all that was built on u between them
    (a walk of the tree in which u is the parent of uv, children by rank). What one gadget takes from a state is then a
    run of numbers: v, and the children of v that are built later, with theirs. So a state's table is one bit for each
    label, with runs cleared, and states with equal tables share one.

    A word is read once, from left to right. Every prefix has one accepted path, so each place of the word gets one
    state; from it, the labels that spell what follows are looked up in the state's table, and those that have an arc
    give the states of the places behind them.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        ids = vocabulary.ids
        target: dict[int, int] = {}
        built: dict[int, int] = {}  # the step of each label that a merge makes
        children: dict[int, list[int]] = {}
        gone: list[dict[int, int]] = [{}]
        sharing = {0: 1 << 60}
        for step, (left, right) in enumerate(vocabulary.merges):
            u, v, w = ids[left], ids[right], ids[left + right]
            old = target.get(u, 0)
            behind = target.get(v, 0)
            if sharing[old] > 1 or u == v:
                gone.append(dict(gone[old]))
                sharing[old] -= 1
                target[u] = len(gone) - 1
                sharing[target[u]] = 1
            gone[target[u]].setdefault(v, step)
            if w not in built:
                built[w] = step
                children.setdefault(u, []).append(w)
                target[w] = behind
                sharing[behind] += 1
        self.n_states = len(gone)
        code = {c: b for b, c in enumerate(vocabulary.alphabet)}
        end = vocabulary.word_end
        spelled: dict[int, list[int]] = {}  # bytes, plus 256 for the last at a word's end
        for token, number in ids.items():
            closed = bool(end) and token.endswith(end) and len(token) > len(end)
            codes = [code[c] for c in (token[: -len(end)] if closed else token)]
            if closed:
                codes[-1] += 256
            if number in built or len(codes) == 1:  # else no merge makes it
                spelled[number] = codes
        number_of, behind_all = self._numbered([n for n in spelled if n not in built], children)
        self.tables = self._tables(gone, built, children, number_of, behind_all)
        # a trie over the labels: where a label ends, its number in the tables
        self.step: dict[int, int] = {}
        self.label_at: list[int] = [-1]
        for number, codes in spelled.items():
            node = 0
            for symbol in codes:
                node = self.step.setdefault(node << 9 | symbol, len(self.label_at))
                if node == len(self.label_at):
                    self.label_at.append(-1)
            self.label_at[node] = number
        self.number_at = [number_of[label] if label >= 0 else -1 for label in self.label_at]
        self.behind = [self.tables[target.get(label, 0)] if label >= 0 else b"" for label in self.label_at]
        self.pattern = regex.compile(WORD_PATTERN if vocabulary.style == "word" else BYTE_PATTERN)
        self.words = BoundedCache(self.encode_word, 150_000)
        self.chunks = BoundedCache(self._encode_chunk, 200_000)

    @staticmethod
    def _numbered(first: list[int], children: dict[int, list[int]]) -> tuple[dict[int, int], dict[int, int]]:
        """Each label's number, and the number behind all that was built on it."""
        number_of: dict[int, int] = {}
        behind: dict[int, int] = {}
        todo = [(label, False) for label in reversed(first)]
        while todo:
            label, left = todo.pop()
            if left:
                behind[label] = len(number_of)
                continue
            number_of[label] = len(number_of)
            todo.append((label, True))
            todo.extend((c, False) for c in reversed(children.get(label, ())))
        return number_of, behind

    @staticmethod
    def _tables(gone: list[dict[int, int]], built: dict[int, int], children: dict[int, list[int]], number_of: dict[int, int], behind: dict[int, int]) -> list[bytes]:
        """One bit for each label, for each state: whether the arc leaves it."""
        import numpy as np

        steps = {u: [built[w] for w in ws] for u, ws in children.items()}
        shared: dict[bytes, bytes] = {}
        out = []
        for removed in gone:
            there = np.ones(len(number_of), bool)
            for label, step in removed.items():
                there[number_of[label]] = False
                later = bisect.bisect_left(steps.get(label, ()), step)  # by the same gadget, too, for a doubled label
                if later < len(children.get(label, ())):
                    there[number_of[children[label][later]] : behind[label]] = False
            row = np.packbits(there, bitorder="little").tobytes()
            out.append(shared.setdefault(row, row))
        return out

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The labels of the one accepted path that spells a pre-split word."""
        codes = list(word.encode("utf-8", "replace"))
        n = len(codes)
        if not n:
            return ()
        if self.vocabulary.word_end:
            codes[-1] += 256
        step, number_at, label_at, behind = self.step.get, self.number_at, self.label_at, self.behind
        table: list = [None] * (n + 1)
        table[0] = self.tables[0]
        since, label_to = [0] * (n + 1), [0] * (n + 1)
        for at in range(n):
            arcs = table[at]
            node, j = 0, at
            while j < n:
                node = step(node << 9 | codes[j])
                if node is None:
                    break
                j += 1
                number = number_at[node]
                if number >= 0 and arcs[number >> 3] >> (number & 7) & 1:
                    table[j], since[j], label_to[j] = behind[node], at, label_at[node]
            if table[n] is not None:
                break
        out: list[int] = []
        while n:
            out.append(label_to[n])
            n = since[n]
        return tuple(out[::-1])

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _encode_chunk(self, chunk: str) -> tuple[bytes, str]:
        text = self.normalize(chunk)
        if text.isascii() and text.isalpha():
            ids = self.words[text]  # the word of other chunks, too: with a comma, or a capital
        else:
            found = self.pattern.findall(text)
            ids = self.words[found[0]] if len(found) == 1 else tuple([i for w in found for i in self.words[w]])
        return array("i", ids).tobytes(), self.decode(ids)

    def encode_both(self, text: str) -> tuple[bytes, str]:
        """Ids (little-endian 32-bit) of a whole text, and what they decode to. Added tokens give their own ids.

        Only for vocabularies that drop white space: line ends and blanks bound chunks.
        """
        found: list[tuple[bytes, str]] = []
        for k, part in enumerate(self.vocabulary.parts(text)):
            if k % 2:
                ids = [self.vocabulary.special[part]]
                found.append((array("i", ids).tobytes(), self.decode(ids)))
            else:
                found += map(self.chunks.__getitem__, part.replace("\n", " ").split(" "))
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return array("i", self.encode_both(text)[0]).tolist()

    def decode(self, ids) -> str:
        """The arc labels, joined as the library joins tokens where a file names no decoder."""
        names = per_label(self)
        return " ".join([names[i] for i in ids if i in names])


def per_label(automaton: Automaton) -> dict[int, str]:
    names = automaton.__dict__.get("_names")
    if names is None:
        names = automaton._names = {i: s for s, i in (automaton.vocabulary.ids | automaton.vocabulary.special).items()}
    return names
