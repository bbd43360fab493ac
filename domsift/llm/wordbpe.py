"""Per-task helpers around a word-level BPE tokenizer file (``tokenizers`` JSON).

The file's pre-tokenizer cuts a text into words that are encoded one by one, so
ids and counts of a text are those of its words. Both helpers remember words in
a bounded dictionary; texts with special strings or characters beyond Latin
Extended-A are cut by the library's own normaliser and pre-tokenizer instead.
All this holds for one way of normalising and cutting, which is looked up in the
file: ids of any other file come from the library, counts are refused.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

#: Words remembered by one Python worker since the dictionary was last full, besides as many from before.
CACHE_WORDS = 150_000

# Among these characters lower-casing maps one character to one, composing
# changes nothing, and Python's white space is the library's.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-įı-ſ]")

# what the tokenizer counts as white space, turned round
_BLACK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# the tokenizer's word pattern, spelled out for the characters of ``plain`` texts
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾"
_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
# fixed values: the normaliser and the word pattern that this module knows
_NORMALISER = ["NFC", "Replace \\s+  ", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# byte-level alphabet (fixed by the format): visible bytes stand for themselves, the rest follow from U+0100
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_NO_RANK = 1 << 60
#: Longer words are encoded each time they come and are not remembered.
_KEEP_CHARS = 64

_LOADED: dict = {}


def load(path: str):
    """The library's tokenizer, read once per Python worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


def _byte_letters(word: str) -> str:
    if word.isascii() and word.isprintable():
        return word
    return word.encode().decode("latin-1").translate(_BYTE_LETTERS)


class _Bounded(dict):
    """A dictionary that computes what it misses and never outgrows twice its limit.

    When it is full it becomes the older one; what is asked for again comes back
    from there, so frequent words are never worked out twice.
    """

    def __init__(self, compute, limit: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if not isinstance(key, str) or len(key) <= _KEEP_CHARS:
            self[key] = value
        return value


def _known_cut(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    steps = (given.get("normalizer") or {}).get("normalizers", [])
    names = [" ".join([n["type"], *([n["pattern"].get("Regex", ""), n["content"]] if "pattern" in n else [])]) for n in steps]
    cuts = (given.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": _SPLIT} and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed"
    return bool(names == _NORMALISER and split and cuts[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False})


class _Chunks:
    """Cuts a text at white space and around special strings.

    Neither the normaliser nor the pre-tokenizer looks across white space, so
    each chunk is encoded alone.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = frozenset(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known = _known_cut(path)

    def plain(self, text: str) -> bool:
        return not (_UNUSUAL.search(text) or any(s in text for s in self.special) or any(s in text.lower() for s in self.special))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each chunk, in code points."""
        out = []
        pieces = self.specials.split(text) if self.specials else [text]
        at = 0
        for piece in pieces:
            if piece in self.special:
                out.append((at, at + len(piece)))
            else:
                out += [(at + m.start(), at + m.end()) for m in _BLACK.finditer(piece)]
            at += len(piece)
        return out

    def words(self, chunk: str) -> list[tuple[str, int, int]]:
        """(word in byte letters, start, end) as the library cuts the chunk."""
        if self.plain(chunk) and chunk == chunk.lower():
            return [(_byte_letters(m[0]), *m.span()) for m in _LATIN_WORDS.finditer(chunk)]
        from tokenizers import PreTokenizedString

        cut = PreTokenizedString(chunk)
        cut.normalize(self.tokenizer.normalizer.normalize)
        self.tokenizer.pre_tokenizer.pre_tokenize(cut)
        return [(w, a, b) for w, (a, b), _ in cut.get_splits(offset_referential="original", offset_type="char")]


class WordIds(_Chunks):
    """Ids of whole texts, as the library gives them, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.packed = [struct.pack("<I", i) for i in range(max(self.tokenizer.get_vocab(True).values()) + 1)]
        self.of_word = _Bounded(self._word)
        self.of_chunk = _Bounded(self._chunk)

    def _word(self, word: str) -> bytes:
        """Ids of a word of a plain text."""
        return self._letters(_byte_letters(word))

    def _letters(self, letters: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(letters)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk in self.special:
            return self.packed[self.tokenizer.token_to_id(chunk)]
        return b"".join([self._letters(w) for w, _, _ in self.words(chunk)])

    def ids(self, text: str) -> bytes:
        if not self.known:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.plain(text):
            return b"".join(map(self.of_word.__getitem__, _LATIN_WORDS.findall(text.lower())))
        return b"".join([self.of_chunk[text[a:b]] for a, b in self.spans(text)])


class PrefixCounts(_Chunks):
    """Exact token counts of every prefix of a text.

    Inside a word the counts come from dynamic programming over its bytes: the
    last token of a prefix's encoding is the one vocabulary entry that ends
    there and forms a valid pair with the last token of what stands before it
    (tokens are what byte-pair encoding gives exactly if every neighbouring pair
    of them is). Prefixes are tabulated open, and closed by the end-of-word
    suffix. Across words the counts add up, so the store of a text is the
    running sum at its words' ends plus the table of the word that is asked for.
    """

    def __init__(self, path: str):
        super().__init__(path)
        if not self.known:
            raise ValueError(f"{path} normalises or cuts texts in a way that prefix counts are not known for")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab = frozenset(model["vocab"])
        # lengths of the entries that end in some two letters (or are one), longest first, by whether they close a word
        self.lengths: dict[tuple[bool, str], list[int]] = {}
        for entry in self.vocab:
            closed = entry.endswith(self.suffix)
            letters = entry.removesuffix(self.suffix)
            found = self.lengths.setdefault((closed, letters[-2:]), [])
            if len(letters) not in found:
                found.append(len(letters))
        for found in self.lengths.values():
            found.sort(reverse=True)
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.valid = _Bounded(self._pair_is_valid)
        self.open = _Bounded(lambda w: self._step(w, closed=False))
        self.of_word = _Bounded(lambda word: self._whole(_byte_letters(word)))
        self.of_chunk = _Bounded(self._chunk)

    # -- inside a word; words are in the model's byte letters -----------------
    def _merge(self, text: str, closed: bool) -> list[str]:
        """Byte-pair encoding of a short string by its definition."""
        parts = list(text)
        if closed:
            parts[-1] += self.suffix
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, _NO_RANK), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == _NO_RANK:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair_is_valid(self, pair: tuple[str, str, bool]) -> bool:
        left, right, closed = pair
        end = right + self.suffix if closed else right
        return self._merge(left + right, closed) == ([left, end] if left else [end])

    def _step(self, word: str, closed: bool) -> tuple[str, int]:
        """Last token and token count of a word, from those of its open prefixes."""
        if not word:
            return "", 0
        end = self.suffix if closed else ""
        for j in self._begins(word, len(word), closed):
            token = word[j:]
            if token + end in self.vocab:
                last, count = self.open[word[:j]]
                if self.valid[(last, token, closed)]:
                    return token, count + 1
        raise ValueError(f"no encoding of {word!r}")

    def _begins(self, word: str, i: int, closed: bool) -> list[int]:
        """Where an entry that ends at ``i`` may begin, the longest first."""
        lengths = [*self.lengths.get((closed, word[i - 2 : i]), ()), 1] if i > 1 else [1]
        return [i - n for n in lengths if n <= i]

    def _word(self, word: str, ends: list[int]) -> list[int]:
        """Token counts of the word's prefixes that end at ``ends`` (ascending)."""
        if len(word) <= _KEEP_CHARS:  # prefixes are shared with other words
            return [self._step(word[:i], closed=True)[1] for i in ends]
        last, count, out = [""], [0], []
        for i in range(1, ends[-1]):
            j = self._begin(word, i, last, closed=False)
            last.append(word[j:i])
            count.append(count[j] + 1)
        for i in ends:
            out.append(count[self._begin(word, i, last, closed=True)] + 1)
        return out

    def _begin(self, word: str, i: int, last: list[str], closed: bool) -> int:
        """Where the last token of ``word[:i]`` begins, by a table of this word alone."""
        end = self.suffix if closed else ""
        for j in self._begins(word, i, closed):
            if word[j:i] + end in self.vocab and self.valid[(last[j], word[j:i], closed)]:
                return j
        raise ValueError(f"no encoding of {word[:i]!r}")

    def _whole(self, letters: str) -> int:
        return self._word(letters, [len(letters)])[0]

    def _whole(self, letters: str) -> int:
        return self._word(letters, [len(letters)])[0]

    # -- inside a chunk --------------------------------------------------------
    def _chunk(self, chunk: str) -> list[tuple[int, int, int]]:
        """(start, end, tokens) of each word of a chunk; words that share a character are one.

        A character that joined the one before it is part of the word before.
        """
        if chunk in self.special:
            return [(0, len(chunk), 1)]
        out: list[tuple[int, int, int]] = []
        for word, a, b in [*self.words(chunk), ("", len(chunk), len(chunk))]:
            n = self._whole(word) if word else 0
            if out and (a < out[-1][1] or not word):
                out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] + n)
            elif word:
                if out:
                    out[-1] = (out[-1][0], a, out[-1][2])
                out.append((a if out else 0, b, n))
        return out

    def _recount(self, piece: str) -> int:
        return sum(n for _, _, n in self._chunk(piece))

    def inside(self, piece: str) -> list[int]:
        """Token counts of ``piece[:m]`` for m = 0 .. len(piece), of one word of a text.

        Where each character is normalised by itself, so are the word's prefixes,
        and one table gives them all. What is left are special strings, cuts of
        contractions and words with characters that join.
        """
        if self.plain(piece) and piece == piece.lower():
            parts, single = list(piece), not (len(piece) > 2 and piece[0] == "'")
        else:
            normal = self.tokenizer.normalizer.normalize_str
            parts = [normal(c) for c in piece]
            single = piece not in self.special and [w for w, _, _ in self.words(piece)] == [_byte_letters("".join(parts))]
        if not single:
            return [0, *[self._recount(piece[:m]) for m in range(1, len(piece) + 1)]]
        return [0, *self._word(_byte_letters("".join(parts)), np.cumsum([len(p.encode()) for p in parts]).tolist())]

    # -- the whole text --------------------------------------------------------
    def store(self, text: str) -> np.ndarray:
        """Token counts at the end of each word."""
        if self.plain(text):
            counts = np.fromiter(map(self.of_word.__getitem__, _LATIN_WORDS.findall(text.lower())), dtype=np.int64)
        else:
            counts = np.array([n for a, b in self.spans(text) for _, _, n in self.of_chunk[text[a:b]]], dtype=np.int64)
        return np.cumsum(counts)

    def word_spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each word that the store counts."""
        if self.plain(text):
            return [m.span() for m in _LATIN_WORDS.finditer(text.lower())]
        return [(a + i, a + j) for a, b in self.spans(text) for i, j, _ in self.of_chunk[text[a:b]]]

    def at(self, text: str, store: np.ndarray, end: int) -> int:
        """Token count of ``text[:end]``."""
        spans = self.word_spans(text)
        k = sum(b <= end for _, b in spans)
        before = int(store[k - 1]) if k else 0
        if k < len(spans) and spans[k][0] < end:
            a, b = spans[k]
            return before + self.inside(text[a:b])[end - a]
        return before

    def longest(self, text: str, store: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix of no more than ``budget`` tokens."""
        if not len(store) or store[-1] <= budget:
            return len(text)
        k = int(np.searchsorted(store, budget, side="right"))
        a, b = self.word_spans(text)[k]
        left = budget - (int(store[k - 1]) if k else 0)
        return a + max(m for m, n in enumerate(self.inside(text[a:b])) if n <= left)
