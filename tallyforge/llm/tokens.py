"""Token ids from the public tokenizer files, a batch of texts at a time.

Both vocabularies split a text into words before their merges run, so the ids of a text are
the ids of its words in order. A batch is cut at white space with numpy, only at places where
the split cannot depend on what lies beyond; Arrow finds the distinct pieces; the
``tokenizers`` library encodes those not met before, many in one call; and the ids of whole
texts are gathered from the pieces' ids by offsets.

The ids are those of the library's plain call without added special tokens: a special token's
string in a text becomes that token. Texts that may hold one are given to the library whole.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: Pieces, and ids of pieces, that a worker holds before it drops those that came once.
CACHE_PIECES, CACHE_IDS = 700_000, 12_000_000
#: Bytes of text cut at once, and bytes of odd pieces given to the library in one call.
PART, CALL = 6 << 20, 1 << 12
#: What the strings of special tokens start with.
SPECIAL = "<|"
WORD_END = "</w>"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Pieces whose words are split here; others are split by the library.
_PLAIN = re.compile(" ?[!-~À-ÖØ-öø-ÿ]+")
_SPACED_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+")
_BARE_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that start a character which is no white space, and those whose next bytes decide.
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False
#: ASCII letters, and signs that part words where a letter stands before them.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b'!"#$%&()*+,-./:;<=>?@[]^_`{|}~')] = True
_OPEN = np.zeros(256, dtype=bool)
_OPEN[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself where
    printable, else the next free code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _wide_blank(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Whether three bytes may be white space outside ASCII. May say so of another sign, which
    costs a place to cut, never the other way round."""
    general = np.isin(second, (0x80, 0x81)) & ((third <= 0x8F) | (third == 0x9F) | (third >= 0xA8) & (third <= 0xAF))
    return (
        (first == 0xC2) & np.isin(second, (0x85, 0xA0)) | (first == 0xE1) & np.isin(second, (0x9A, 0xA0))
        | (first == 0xE2) & general | (first == 0xE3) & (second == 0x80) & (third == 0x80)
    )


def _solid_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character after each place is surely no white space; ``data`` has three
    spare bytes at its end."""
    first = data[at + 1]
    return _SOLID[first] | _OPEN[first] & ~_wide_blank(first, data[at + 2], data[at + 3])


def _signs(data: np.ndarray) -> np.ndarray:
    """Places of signs right after a letter of ASCII or Latin-1, where a new word starts."""
    at = np.flatnonzero(_SIGN[data[:-3]])
    at = at[at > 1]
    one, two = data[at - 1], data[at - 2]
    return at[_LETTER[one] | (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)]


class Encoder:
    """Ids of whole texts as unsigned 32-bit integers."""

    def __init__(self, path: str, words: bool):
        """``words``: the vocabulary drops white space and marks the ends of words; else it
        keeps white space, and a word takes the space before it along."""
        from tokenizers import Tokenizer

        self.whole, self.words = Tokenizer.from_file(path), words
        vocabulary = self.whole.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes that a token stands for
        for token, number in vocabulary.items():
            self.size[number] = len(token.removesuffix(WORD_END)) if words else len(token)
        self.model, self.letters = self.whole.model, dict(enumerate(_byte_letters()))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # number of each piece
        self.merged: dict[str, list[int]] = {}  # ids of words that are parts of pieces
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        self.uses = np.zeros(1 << 14, dtype=np.int32)  # parts of texts that each piece was in
        self.held = 0

    def _shrink(self) -> None:
        """Drop pieces that came once; all, if the others are most."""
        stay = np.flatnonzero(self.uses[: self.held] > 1)
        old, ids, ends, uses = self.known, self.ids, self.ends, self.uses
        self._forget()
        if len(stay) > CACHE_PIECES // 2:
            return
        lengths = np.diff(ends, prepend=0)[stay]
        at = np.cumsum(lengths)
        now = np.full(len(uses), -1, dtype=np.int64)
        now[stay] = np.arange(len(stay))
        self.known = {piece: k for piece, n in old.items() if (k := int(now[n])) >= 0}
        self._keep(ids[np.repeat(ends[stay] - at, lengths) + np.arange(int(at[-1]))], lengths)
        self.uses[: self.held] = 1

    def _keep(self, piece_ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append the ids of pieces that ``known`` numbers next."""
        at = int(self.ends[self.held - 1]) if self.held else 0
        while at + len(piece_ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.held + len(lengths) > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
            self.uses = np.concatenate((self.uses, np.zeros_like(self.uses)))
        self.ids[at : at + len(piece_ids)] = piece_ids
        self.ends[self.held : self.held + len(lengths)] = at + np.cumsum(lengths)
        self.held += len(lengths)

    def _plain(self, text: str) -> np.ndarray:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._plain(p) for p in pieces]
        return np.concatenate([np.empty(0, dtype=np.uint32), *found]), np.array([len(f) for f in found], dtype=np.int64)

    def _together(self, pieces: list[str], sizes: list[int], between: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that take ``sizes`` bytes of tokens each, encoded as one text with
        ``between`` between them. Tokens must end where pieces do; else each is encoded alone."""
        found = self._plain(between.join(pieces))
        gap = 0 if self.words else len(between)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64) + gap)
        reached = np.cumsum(self.size[found])
        last = np.searchsorted(reached, ends - gap, side="left")  # the token that ends each piece
        total = int(reached[-1]) if len(found) else 0
        if total != int(ends[-1]) - gap or (reached[last] != ends - gap).any():
            return self._one_by_one(pieces)
        lengths = np.diff(last, prepend=-1)
        if gap:
            lengths[1:] -= 1  # the sign between
            found = np.delete(found, last[:-1] + 1)
        return found, lengths

    def _merge(self, word: str) -> list[int]:
        units = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(units)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Number new pieces and keep their ids: words are split here where they are plain and
        merged by the library's model; other pieces go through the whole library."""
        gc.disable()  # many lists are made and dropped, none in cycles
        try:
            odd = self._learn_plain(pieces)
        finally:
            gc.enable()
        self._learn_odd(odd)

    def _learn_plain(self, pieces: list[bytes]) -> list[tuple[bytes, str]]:
        """Learns what is plain and returns the rest."""
        plain, split = _PLAIN.fullmatch, _BARE_WORDS.findall if self.words else _SPACED_WORDS.findall
        flat, lengths, known, number, odd = array("I"), [], self.known, self.held, []
        tokenize, spaced = self.model.tokenize, not self.words
        if len(self.merged) > CACHE_PIECES // 4:
            self.merged.clear()
        for raw in pieces:
            text = raw.decode("utf-8", "surrogatepass")
            if raw.isalpha():  # ASCII letters
                found = [t.id for t in tokenize(text.lower() if self.words else text)]
            elif spaced and raw[1:].isalpha() and raw[0] == 32:
                found = [t.id for t in tokenize(self.letters[32] + text[1:])]
            elif (text[1:] if spaced and text[0] == " " else text).isalpha() and max(text) <= "ÿ":  # one word of Latin letters
                found = self._merge(text.lower() if self.words else text)
            elif not plain(text) or SPECIAL in text:
                odd.append((raw, text))
                continue
            else:
                found = []
                for word in split(text.lower() if self.words else text):
                    of = self.merged.get(word)
                    if of is None:
                        of = self.merged[word] = self._merge(word)
                    found += of
            flat.extend(found)
            lengths.append(len(found))
            known[raw] = number
            number += 1
        self._keep(np.frombuffer(flat, dtype=np.uint32) if flat else np.empty(0, dtype=np.uint32), np.asarray(lengths, dtype=np.int64))
        return odd

    def _learn_odd(self, pieces: list[tuple[bytes, str]]) -> None:
        groups: dict[str, list[tuple[bytes, str, int]]] = {"": [], "\n": [], " ": [], "alone": []}
        normal = self.whole.normalizer
        for raw, text in pieces:
            if SPECIAL in text:
                groups["alone"].append((raw, text, 0))
            elif self.words:
                made = normal.normalize_str(text)
                one = len(made.split()) == 1 and not made[0].isspace() and not made[-1].isspace()
                groups[" " if one else "alone"].append((raw, text, len(made.encode())))
            elif text[0] == " " and len(text) > 1 and not text[1].isspace():
                groups[""].append((raw, text, len(raw)))
            elif text[0].isspace() or text[-1].isspace():
                groups["alone"].append((raw, text, 0))
            else:
                groups["\n"].append((raw, text, len(raw)))
        for between, members in groups.items():
            at = 0
            while at < len(members):
                end, size = at, 0
                while end < len(members) and (size < CALL or end == at):
                    size += len(members[end][0]) + 1
                    end += 1
                texts, sizes = [t for _, t, _ in members[at:end]], [n for _, _, n in members[at:end]]
                made = self._one_by_one(texts) if between == "alone" else self._together(texts, sizes, between)
                for k, (raw, _, _) in enumerate(members[at:end]):
                    self.known[raw] = self.held + k
                self._keep(*made)
                at = end

    def _cut(self, data: np.ndarray, edges: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Offsets in ``data`` (with three spare bytes) that cut texts into pieces; the texts
        are parted by ``edges``, and those in ``whole`` are not cut."""
        n = int(edges[-1])
        filled = np.flatnonzero(edges[1:] > edges[:-1])
        first, last = edges[filled], edges[filled + 1] - 1
        if self.words:
            solid = ~_BLANK[data[:n]]
            cut = np.zeros(n + 1, dtype=bool)
            cut[1:n] = solid[1:] != solid[:-1]
            cut[_signs(data)] = True
        else:
            cut = np.zeros(n + 1, dtype=bool)
            cut[_signs(data)] = True
            spaces = np.flatnonzero(data[:n] == 0x20)
            cut[spaces[_solid_after(data, spaces)]] = True
            cut[last] = False
            # A line end between two signs is a token of its own.
            lines = np.flatnonzero(data[:n] == 0x0A)
            lines = lines[~np.isin(lines, first) & ~np.isin(lines, last)]
            one, two, three = (data[np.maximum(lines - k, 0)] for k in (1, 2, 3))
            before = (one > 0x20) & (one < 0x7F) | (one >= 0x80) & ~_wide_blank(two, one, one) & ~_wide_blank(three, two, one)
            lines = lines[before & _solid_after(data, lines)]
            cut[lines] = cut[lines + 1] = True
        for i in whole:
            cut[edges[i] : edges[i + 1]] = False
        cut[first] = cut[n] = True
        return np.flatnonzero(cut)

    def _part(self, data: np.ndarray, edges: np.ndarray, whole: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        places = self._cut(data, edges, whole)
        if self.held > CACHE_PIECES or self.held and self.ends[self.held - 1] > CACHE_IDS:
            self._shrink()
        if not self.held:
            self.known[b""] = 0
            self._keep(np.array([end_id], dtype=np.uint32), np.array([1]))
        pieces = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        values = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, values, repeat(-1)), dtype=np.int64, count=len(values))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            self._learn([values[n] for n in new])
            number[new] = [self.known[values[n]] for n in new]
        self.uses[number] += 1
        self.uses[0] = 2  # the end of a text stays
        of = number[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.empty(0, dtype=np.int64)
        # Each text's pieces, then its end.
        ends = np.searchsorted(places[:-1], edges[1:])
        of = np.insert(of, ends, 0)
        piece_ends = self.ends[of]
        piece_starts = np.where(of > 0, self.ends[of - 1], 0)
        lengths = piece_ends - piece_starts
        reached = np.cumsum(lengths)
        total = int(reached[-1]) if len(reached) else 0
        at = np.repeat((piece_starts - reached + lengths).astype(np.int32), lengths)  # a part's ids are few
        at += np.arange(total, dtype=np.int32)
        return self.ids[at], reached[ends + np.arange(len(ends))]

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of ``texts`` (null as empty) of about PART bytes: the place of the run's
        first text, the ids of its texts one after the other, each with ``end_id`` behind it, and
        the places where each text's ids end."""
        if not len(texts):
            return
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = np.flatnonzero(pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False))
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        values = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, dtype=np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, side="right")) - 1)
            data = np.concatenate((values[offsets[at] : offsets[end]], np.full(3, 0x20, dtype=np.uint8)))
            whole = marked[(marked >= at) & (marked < end)] - at
            yield at, *self._part(data, offsets[at : end + 1] - offsets[at], whole, end_id)
            at = end


@lru_cache(maxsize=4)
def encoder(path: str, words: bool) -> Encoder:
    """One encoder per worker process; Python workers are reused between tasks."""
    return Encoder(path, words)
