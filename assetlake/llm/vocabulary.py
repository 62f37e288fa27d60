"""Token ids of whole texts from the ``tokenizers`` library, with repeated words encoded once per worker.

Both vocabularies cut a text into words before merging, and neither ever merges across a single white-space
character between two visible ones: the byte vocabulary gives such a space to the word on its right, the word
vocabulary drops it. A text is therefore cut at those places and each distinct piece is given to the library
once. Every other white space (runs, the ends of the text) stays inside a piece, so the library sees it as it
stands. Two further cuts save encodings of rare words: a run of ASCII punctuation
between a letter and the end of a piece is a word of its own in both vocabularies, and the word vocabulary lower-cases
letters (used for Latin ones without combining marks). A new piece of Latin letters alone is one word in both
vocabularies and goes to the library's model as it is; other new pieces of plain ASCII go to the
library many at once, as one text with a mark between them whose id no such piece can hold.

Arrow cuts the texts of a batch and numbers their distinct pieces, so Python sees a piece once per batch, and numpy
lays the ids of all occurrences out.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

assert sys.byteorder == "little" and array("I").itemsize == 4  # the byte form of ids

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept per generation; a worker holds two generations at most (about 70 MB).
KEPT = 200_000
#: Occurrences of pieces whose ids are laid out at once.
LAID_OUT = 1 << 18

_LOADED: dict[tuple[str, bool], Encoder] = {}
#: Pieces that are given to the library as one text, the mark between them, and what such a piece may be.
TOGETHER, MARK = 500, " ~ "
_PLAIN = re.compile(r"[!-}]+")
#: Punctuation that can end a piece as a word of its own: no quotation marks of contractions, no parts of ``<|...|>``.
_TAIL = "!\"#$%&()*+,-./:;=?@[]^`{}"
_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _shown_bytes() -> dict[int, str]:
    """The visible characters that byte vocabularies write bytes as (given as Latin-1 characters)."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_SHOWN = _shown_bytes()


def _shown(word: str) -> str:
    return word.encode().decode("latin-1").translate(_SHOWN)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _latin_case(text: str) -> bool:
    """Lower case is Python's, character by character."""
    return "<|" not in text and max(text) < "\u0250" and "\u0130" not in text


def _latin(word: str) -> bool:
    """Latin letters alone, none of which needs normalizing; lower case is up to the caller."""
    return word.isalpha() and (word.isascii() or _latin_case(word))


def _stays_letter(char: str) -> bool:
    """A letter that is still one, without a mark after it, when normalized and lower-cased."""
    return char.isalpha() and unicodedata.normalize("NFC", char).lower().isalpha()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; its kept pieces serve all tasks of the worker."""
    key = (path, True)
    if key not in _LOADED:
        _LOADED[key] = Encoder(path)
    return _LOADED[key]


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """``ids(texts)``: per text its ids as little-endian unsigned 32-bit integers, without added tokens."""

    def __init__(self, path: str, kept: int = KEPT):
        self.library = load(path)
        self.kept = kept
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        lowers = self._raw(["Ab ab"])[0] == self._raw(["ab ab"])[0]
        drops = self._raw(["ab ab"])[0] == self._raw([" ab\tab "])[0]
        self.lowers = lowers and drops
        self.ends: dict[str, bytes] = {"": b""}
        one, two, marked = (array("I", x) for x in self._raw([" ab", " cd", f" ab{MARK}cd"]))
        alone = len(marked) == len(one) + len(two) + 1 and marked[: len(one)] == one and marked[len(one) + 1 :] == two
        self.mark = marked[len(one)] if alone else None
        self.letters: dict[str, bool] = {}
        self.heads: dict[str, bytes] = {"": b""}
        self.model = self.library.model
        #: What the model sees of the space before a word; None if it can't be given words by themselves.
        self.space: str | None = None
        tried = ["ab", "strengthening", "\u00e9t\u00e9", "stra\u00dfe", "w\u00f6rterb\u00fccher", "zzqxv"]
        for space in ("", "\u0120"):
            if self._raw([" " + x for x in tried]) == [self._word(space + _shown(x)) for x in tried]:
                self.space = space

    def _word(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _spaced(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces behind a space (of those with a line feed, of themselves)."""
        plain, others, found = [], [], {}
        space, lowers, tokenize = self.space, self.lowers, self.model.tokenize
        for piece in pieces:
            if space is not None and _latin(piece) and not (lowers and piece != piece.lower()):
                shown = space + (piece if piece.isascii() else _shown(piece))
                found[piece] = array("I", [t.id for t in tokenize(shown)]).tobytes()
            elif self.mark is not None and _PLAIN.fullmatch(piece) and "<|" not in piece:
                plain.append(piece)
            else:
                others.append(piece)
        chunks = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        for chunk, raw in zip(chunks, self._raw([" " + MARK.join(c) for c in chunks]), strict=True):
            at = (4 * np.flatnonzero(np.frombuffer(raw, np.uint32) == self.mark)).tolist()
            if len(at) != len(chunk) - 1:
                others += chunk
                continue
            found.update((p, raw[a:b]) for p, a, b in zip(chunk, [0, *[x + 4 for x in at]], [*at, len(raw)], strict=True))
        found.update(zip(others, self._raw([x if x[0] == "\n" else " " + x for x in others]), strict=True))
        return found

    @staticmethod
    def cut(text: str) -> tuple[str, str | list[str] | None]:
        """The first piece of the text, and the others: as a text to be cut at its spaces where that gives them, else
        as a list. All others stand for a space and the piece, those that start with a line feed for themselves."""
        if not text:
            return "", None
        flat = text.replace("\n", " \n")
        # Without other white space (none of which is printable) runs show as these pairs; else they are looked for.
        runs = "  " in flat or "\n " in flat or (not flat.replace("\n", "").isprintable() and _RUN.search(text))
        if runs or text[0].isspace() or text[-1].isspace():
            head, *rest = _CUT.split(text)
            return head, [x[1:] for x in rest]
        head, _, rest = flat.partition(" ")
        return head, rest or None

    def _bases(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Distinct pieces without the punctuation at their ends, where that is a word of its own, and that end (else
        empty). Where case doesn't count and a base is plain it is in lower case."""
        bases = pc.utf8_rtrim(pieces, _TAIL)
        last = pc.utf8_slice_codeunits(bases, -1).dictionary_encode()
        for char in (chars := last.dictionary.to_pylist()):
            if char not in self.letters:
                self.letters[char] = _stays_letter(char) if char else False
        letter = pa.array([self.letters[c] for c in chars], pa.bool_()).take(last.indices)
        bases = pc.if_else(letter, bases, pieces)
        begins = pc.binary_length(bases).to_numpy(zero_copy_only=False)
        ends = [""] * len(pieces)
        cut = np.flatnonzero(begins < pc.binary_length(pieces).to_numpy(zero_copy_only=False))
        whole, chars = pieces.take(pa.array(cut)), pc.utf8_length(bases.take(pa.array(cut))).to_numpy(zero_copy_only=False).tolist()
        for n, piece, at in zip(cut.tolist(), _strings(whole), chars, strict=True):
            ends[n] = piece[at:]
        if self.lowers:
            plain = pc.and_(pc.string_is_ascii(bases), pc.invert(pc.match_substring(bases, "<|")))
            bases = pc.if_else(plain, pc.ascii_lower(bases), bases)
        return bases, pa.array(ends, pa.large_string())

    def _learn(self, wanted: list[str]) -> None:
        """Keeps the ids of distinct bases that are not kept yet, or only by the generation before."""
        known, before = self.new, list(map(self.old.get, wanted))
        known.update((base, ids) for base, ids in zip(wanted, before, strict=True) if ids is not None)
        todo = [base for base, ids in zip(wanted, before, strict=True) if ids is None]
        if self.lowers:
            # Those of plain ASCII are in lower case already.
            low = {x: x.lower() for x in todo if not x.isascii() and _latin_case(x)}
            known.update(self._spaced(list({low.get(x, x) for x in todo})))
            known.update((x, known[y]) for x, y in low.items() if x != y)
        else:
            known.update(self._spaced(todo))

    def _heads(self, pieces: list[str]) -> list[bytes]:
        """Ids of the pieces that begin a text, where no space stands before them."""
        if len(self.heads) > self.kept:
            self.heads = {"": b""}
        todo = list({p for p in pieces if p not in self.heads})
        self.heads.update(zip(todo, self._raw(todo), strict=True))
        return [self.heads[p] for p in pieces]

    def _ends(self, ends: list[str]) -> list[bytes]:
        if len(self.ends) > self.kept:
            self.ends = {"": b""}
        new = [end for end in ends if end not in self.ends]
        self.ends.update(zip(new, self._raw(new), strict=True))
        return [self.ends[end] for end in ends]

    def _found(self, pieces: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of the parts of distinct pieces that are not first ones, and for each piece the places of its base and
        of its end among them."""
        bases, ends = (x.dictionary_encode() for x in self._bases(pieces))
        names = _strings(bases.dictionary)
        found = list(map(self.new.get, names))
        missing = [n for n, ids in enumerate(found) if ids is None]
        if missing:
            self._learn([names[n] for n in missing])
            for n in missing:
                found[n] = self.new[names[n]]
        base, end = (x.indices.to_numpy(zero_copy_only=False) for x in (bases, ends))
        return [*found, *self._ends(ends.dictionary.to_pylist())], base, len(found) + end

    def encoded(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all texts, each followed by ``end``, and where each begins, the last place being
        the end of all."""
        if len(self.new) > self.kept:
            self.old, self.new = self.new, {}
        cut = [self.cut(t) for t in texts]
        listed = [n for n, (_, rest) in enumerate(cut) if isinstance(rest, list)]
        lists = pc.split_pattern(pa.array([None if isinstance(r, list) else r for _, r in cut], pa.large_string()), " ")
        words = lists.flatten()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if listed:
            starts = np.cumsum(counts) - counts
            more = [x for n in listed for x in cut[n][1]]
            sizes = np.array([len(cut[n][1]) for n in listed], np.int64)
            starts[listed] = len(words) + np.cumsum(sizes) - sizes
            counts[listed] = sizes
            words = pa.concat_arrays([words, pa.array(more, pa.large_string())])
        words = words.dictionary_encode()
        kind = words.indices.to_numpy(zero_copy_only=False)
        if listed:
            kind = kind[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(len(kind))]
        parts, base, tail = self._found(words.dictionary)
        found, places = _laid_out(*_joined(parts), np.column_stack([base, tail]).reshape(-1), 2 * np.arange(1, len(base) + 1))
        others, begins = _joined([*self._heads([head for head, _ in cut]), end])
        values, begins = np.concatenate([found, others]), np.concatenate([places, len(found) + begins[1:]])
        # A text is its first piece, the others and the end: the number of the entry of each, in order.
        upto = np.cumsum(counts + 2)
        order = np.full(len(kind) + 2 * len(cut), len(begins) - 2, np.int32)
        inner = np.ones(len(order), bool)
        inner[upto - 1] = False
        inner[upto - counts - 2] = False
        order[upto - counts - 2] = len(places) - 1 + np.arange(len(cut))
        order[inner] = kind
        return _laid_out(values, begins, order, upto)

    def ids(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.encoded(texts)
        raw, bounds = ids.tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _joined(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all entries, and where each begins, the last place being the end of all."""
    ends = np.cumsum(np.fromiter(map(len, entries), np.int64, len(entries)) // 4)
    return np.frombuffer(b"".join(entries), np.uint32), np.concatenate([[0], ends])


def _laid_out(
    values: np.ndarray, begins: np.ndarray, order: np.ndarray, upto: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The entries of ``values`` in the given order, and where the order's ranges that end at ``upto`` begin in it."""
    sizes = np.diff(begins)
    ends = np.cumsum(sizes[order])
    ids = np.empty(ends[-1] if len(ends) else 0, np.uint32)
    done = 0
    for lo in range(0, len(order), LAID_OUT):
        part = order[lo : lo + LAID_OUT]
        size, end = sizes[part], ends[lo : lo + LAID_OUT]
        at = np.repeat(begins[part] - (end - size), size)
        at += np.arange(done, done + len(at))
        ids[done : done + len(at)] = values[at]
        done += len(at)
    return ids, np.concatenate([[0], ends[upto - 1]])


def batches(texts: list[str], most_chars: int = 4_000_000, most_rows: int = 2_000):
    """Index ranges of ``texts`` of a bounded size; a longer single text is a range of its own."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and (chars + len(t) > most_chars or i - start >= most_rows):
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_batches(
    column: pa.Array, most_bytes: int = 2_000_000, most_rows: int = 2_000
) -> Iterator[tuple[int, int, list[str]]]:
    """Index ranges of a column of texts and the texts, of a bounded size; a longer single text is a range of its own.
    Only one range's texts are Python's at a time."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = done = 0
    while lo < len(column):
        hi = int(np.searchsorted(upto, done + most_bytes, "right"))
        hi = min(max(hi, lo + 1), lo + most_rows, len(column))
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()
        lo, done = hi, int(upto[hi - 1])
