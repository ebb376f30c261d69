"""Work on the pieces of texts, so that a tokenizer meets each distinct piece once in a task.

A text is cut before every white-space run that follows a visible character. Neither kind of
tokenizer file (byte-level BPE, BPE with word ends) normalises, matches or merges across such a place,
so what holds for the ids of a text is the sum or the sequence of what holds for its pieces.

The tables of a task are bounded by the ``CACHE_`` numbers of entries, of which the older half goes (of Arrow tables:
what the run of texts at hand doesn't hold) when they are full: that changes speed and never results. Pieces longer than ``MAX_CACHED_CHARS`` are not kept.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES, CACHE_WORDS, CACHE_SIGNS, CACHE_IDS = 1_000_000, 800_000, 50_000, 600_000
MAX_CACHED_CHARS = 100
# White space apart from the blank and the line break, as Python sees it; a superset of what the
# tokenizers count as white space, and not cutting is always right.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_PIECE = re.compile(r"\s*\S+|\s+")
# Letters that both kinds of file take as one word, and signs that they take as another behind it; both lower-case these letters one by one.
# The apostrophe isn't one of the signs (contractions), nor is what special strings begin with.
_LETTERS = "".join(c for c in map(chr, range(0x100)) if re.match("[A-Za-zÀ-ÖØ-öø-ÿ]", c))
_SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_PLAIN_KEY = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{re.escape(_SIGNS)}]*\\z"
# Letters, digits and signs on which all Unicode versions agree.
_PLAIN = re.compile("[\x00-ɏ]*\\Z")


def piece_keys(text: str) -> list[str]:
    """Keys of the pieces of ``text``: a piece after one blank is named by the rest, a piece that begins
    with a line break by itself, any other piece by itself after a tab. The empty text has no piece."""
    spaced = text.replace("\n", " \n")
    if ("  " in spaced or "\n " in spaced or spaced.startswith(" ") or spaced.endswith(" ")
            or _OTHER_SPACE.search(text)):
        return [_key(p) for p in _PIECE.findall(text)]
    if not text:
        return []
    keys = spaced.split(" ")
    keys[0] = "\t" + keys[0]
    return keys


def _key(piece: str) -> str:
    if piece[0] == " " and len(piece) > 1 and not piece[1].isspace():
        return piece[1:]
    return piece if piece[0] == "\n" else "\t" + piece


def piece_text(key: str) -> str:
    if key[0] == "\n":
        return key
    return key[1:] if key[0] == "\t" else " " + key


class Generations(dict):
    """Key -> its value, computed when first met. Half of ``most`` entries are new at most; when these are full they become the
    old ones and the old ones go, so what is met often stays. Long keys are not kept."""

    def __init__(self, value: Callable[[str], object], most: int):
        super().__init__()
        self.value, self.half = value, most // 2
        self.old: dict[str, object] = {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.value(key)
        if len(key) <= MAX_CACHED_CHARS:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class PieceTable(Generations):
    """Key of a piece -> its value, computed from the piece's text."""

    def __init__(self, value: Callable[[str], object]):
        super().__init__(lambda key: value(piece_text(key)), CACHE_PIECES)

    def of(self, text: str) -> list:
        return list(map(self.__getitem__, piece_keys(text)))


class WordTable(Generations):
    """Word -> its value."""

    def __init__(self, value: Callable[[str], object]):
        super().__init__(value, CACHE_WORDS)


class TokenizerFile:
    """What a tokenizers JSON file says about splitting: pattern, special strings, normaliser."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in self.spec["added_tokens"]]
        self.pattern = self._pattern()
        self.find = self.pattern.findall if self.pattern is not None and all("<" in s for s in self.special) else None
        self.letters = byte_letters()
        self.blank = self.letters[0x20]
        #: The normaliser of a file with word ends does nothing but lower-case a text of ASCII
        #: letters (its white space is dropped afterwards).
        self.folds = self.library.normalizer is not None
        self.suffix = self.spec["model"]["end_of_word_suffix"] or ""
        #: What a word of letters keeps of the blank before it.
        self.lead = self.words(" a")[0][:-1] if self.pattern is not None else None

    def _pattern(self):
        """Compiled pattern of the words inside a text; None if the file splits in another way."""
        import regex
        from public_tokenizers import PATTERN

        steps = self.spec["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        if [s.get("type") for s in steps] == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]:
            return regex.compile(PATTERN)
        if [s.get("type") for s in steps] == ["Split", "ByteLevel"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            if steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
                return regex.compile(steps[0]["pattern"]["Regex"])
        return None

    def plain(self, text: str) -> bool:
        """True if this module's own splitting of ``text`` is certain to be the library's."""
        return self.pattern is not None and (text.isascii() or bool(_PLAIN.match(text))) and not any(
            s in text for s in self.special)

    def words(self, text: str) -> list[str]:
        """Words of a plain text."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return self.pattern.findall(text)

    def symbols(self, word: str) -> str:
        """One letter for each byte of ``word``."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.blank)
        return word.encode("utf-8").decode("latin-1").translate(self.letters)


def byte_letters() -> dict[int, str]:
    """Byte -> the visible letter that stands for it in byte-level vocabularies: visible Latin-1
    characters stand for themselves, the others for the letters from U+0100 on, in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class IdTable:
    """Key of a piece -> its ids as little-endian bytes.

    What is kept stands in two Arrow arrays, about 30 bytes a piece, which a run of texts looks all its distinct pieces up in
    at once. When they are full, only the pieces of that run stay.
    """

    def __init__(self, path: str, code: str, most: int = CACHE_IDS):
        file = TokenizerFile(path)
        tokenize, encode, findall, fold = file.library.model.tokenize, file.library.encode, file.find, file.folds
        self.lead, self.most = None if findall is None else file.lead, most
        lead_symbols = file.symbols(self.lead or "")

        def ids_of(symbols: str) -> bytes:
            return array(code, [t.id for t in tokenize(symbols)]).tobytes()

        def plain_ids(word: str) -> bytes:
            # Visible ASCII characters stand for themselves.
            word = word.lower() if fold else word
            return ids_of(lead_symbols + (word if word.isascii() else file.symbols(word)))
        self.plain_ids, self.words = plain_ids, Generations(lambda word: ids_of(file.symbols(word)), CACHE_SIGNS)
        word_ids = self.words.__getitem__

        def text_bytes(text: str) -> bytes:
            if text.isascii() and "<" not in text and findall is not None:
                return b"".join(map(word_ids, findall(text.lower() if fold else text)))
            if file.plain(text):
                return b"".join(map(word_ids, file.words(text)))
            return array(code, encode(text, add_special_tokens=False).ids).tobytes()
        self.text_bytes = text_bytes
        self.keys, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def of(self, keys: pa.Array) -> pa.Array:
        """Ids of each of ``keys``, which are distinct."""
        at = pc.index_in(keys, value_set=self.keys)
        missed = pc.is_null(at)
        new = keys.filter(missed)
        fresh = self._computed(new)
        out = _woven(self.values.take(at.filter(pc.invert(missed))), fresh, missed)
        if len(self.keys) + len(new) > self.most:  # begin again with what this run holds
            self.keys, self.values, new, fresh = self.keys[:0], self.values[:0], keys[:self.most], out[:self.most]
        short = pc.less_equal(pc.utf8_length(new), MAX_CACHED_CHARS)
        self.keys, self.values = pa.concat_arrays([self.keys, new.filter(short)]), pa.concat_arrays([self.values, fresh.filter(short)])
        return out

    def _computed(self, keys: pa.Array) -> pa.Array:
        """Ids of keys that aren't kept. Plain words may be, without the signs behind them."""
        plain = pc.fill_null(pc.match_substring_regex(keys, _PLAIN_KEY), False) if self.lead is not None else pa.array(np.zeros(len(keys), bool))
        words = keys.filter(plain)
        bodies, tails = pc.utf8_rtrim(words, _SIGNS).dictionary_encode(), pc.utf8_ltrim(words, _LETTERS).dictionary_encode()
        at = pc.index_in(bodies.dictionary, value_set=self.keys)
        new = pc.is_null(at)
        fresh = pa.array(list(map(self.plain_ids, bodies.dictionary.filter(new).to_pylist())), pa.large_binary())
        body_ids = _woven(self.values.take(at.filter(pc.invert(new))), fresh, new).take(bodies.indices)
        tail_ids = pa.array([self.words[t] if t else b"" for t in tails.dictionary.to_pylist()], pa.large_binary()).take(tails.indices)
        joined = pc.binary_join_element_wise(body_ids, tail_ids, pa.scalar(b"", pa.large_binary()))
        others = pa.array([self.text_bytes(piece_text(k)) for k in keys.filter(pc.invert(plain)).to_pylist()], pa.large_binary())
        return _woven(others, joined, plain)


def _woven(rest: pa.Array, chosen: pa.Array, where: pa.Array) -> pa.Array:
    """The next of ``chosen`` where ``where`` holds, the next of ``rest`` elsewhere."""
    held = where.to_numpy(zero_copy_only=False)
    places = np.empty(len(held), np.int64)
    places[~held], places[held] = np.arange(len(rest)), len(rest) + np.arange(len(chosen))
    return pa.concat_arrays([rest, chosen]).take(pa.array(places))


@lru_cache(maxsize=4)
def id_table(path: str, code: str = "I") -> IdTable:
    """Table for the tokenizers library's file (``code``: array type).

    One for each worker process: a later task goes on with what an earlier one has found.
    """
    return IdTable(path, code)


@lru_cache(maxsize=1)
def _uneven() -> str:
    """Pattern of texts whose pieces don't begin at each single blank or line break."""
    spaces = "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
    return f"  |\n |^ | $|[{spaces}]"


def chunks(texts: pa.Array, most: int = 14_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``most`` bytes together, each with the place of its first text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def encoded(texts: pa.Array, table: IdTable, code: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has, with ``end_id`` after each. Null counts as empty.

    The texts are cut together, and each distinct piece of theirs is looked up once.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    spaced = pc.replace_substring(texts, "\n", " \n")
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    uneven = pc.match_substring_regex(spaced, _uneven()).to_numpy(zero_copy_only=False) & ~empty
    even, alone = np.flatnonzero(~uneven & ~empty), np.flatnonzero(uneven)
    parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\t", pa.large_string()), spaced.take(pa.array(even)), pa.scalar("", pa.large_string())), " ")
    del spaced
    counts = np.zeros(len(texts), np.int64)
    counts[even] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    keys = [piece_keys(t) for t in texts.take(pa.array(alone)).to_pylist()]
    counts[alone] = list(map(len, keys))
    pieces = pa.concat_arrays([parts.flatten(), pa.array(chain.from_iterable(keys), pa.large_string())]).dictionary_encode()
    del parts, keys
    end = b"" if end_id is None else array(code, [end_id]).tobytes()
    found = pa.concat_arrays([table.of(pieces.dictionary), pa.array([end], pa.large_binary())])
    # The pieces of all texts in order, and the end after each text.
    order = np.full(len(pieces) + len(texts), len(found) - 1, np.int32)
    first = np.cumsum(counts + 1) - counts - 1
    held = np.concatenate([even, alone])
    order[np.repeat(first[held] - np.cumsum(counts[held]) + counts[held], counts[held]) + np.arange(len(pieces))] = pieces.indices.to_numpy()
    taken = found.take(pa.array(order))
    upto = np.frombuffer(taken.buffers()[1], np.int64, len(order) + 1, 8 * taken.offset)
    ids = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[upto[0]:upto[-1]].view(code)
    return ids, np.diff(upto[first + counts + 1] - upto[0], prepend=0) // ids.itemsize


def text_ids(texts: Iterable[str], table: PieceTable) -> Iterable[bytes]:
    """Ids of each text as bytes."""
    for text in texts:
        yield b"".join(table.of(text))
