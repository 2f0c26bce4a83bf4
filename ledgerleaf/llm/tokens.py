"""Exact, cached encoding of whole texts with the tokenizers library.

A text is cut only where the tokenizer itself always cuts (white space, or a
single space between two non-spaces), each distinct cut piece is encoded once,
and the ids of a text are the joined ids of its pieces.  Texts with anything
unusual (special-token strings, control or non-breaking spaces) go to the
library whole, pieces with letters outside Latin go to it piece by piece, and
plain Latin pieces reach its BPE model as ready pre-tokens.  Memory is bounded:
two generations of cached pieces, each of at most `cap` entries of KEPT_CHARS
characters; longer pieces are encoded where they occur.

Columns of texts of a byte-level vocabulary are cut, told apart and joined again by
Arrow, without a Python object a piece: only the distinct pre-tokens of a column go to
the library, and nothing is kept for the next one.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_L = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼-¾"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Pre-tokens of lower-cased pieces of the word vocabulary, one piece a line.
_WORD = re.compile(f"\n|{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
#: Pre-tokens of pieces of the byte-level vocabulary, after each a zero character.
_BYTE = re.compile(f"\0|{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^\\s\0{_L}{_N}]+|\\s+(?!\\S)|\\s+")
#: Pieces made of these only are split here (İ is lower-cased to two characters);
#: white space at the end of a piece would see what comes next.
_PLAIN_WORD = re.compile("[!-~¡-įı-ſ]*")
_PLAIN_BYTE = re.compile("(?:[\n -~¡-ſ]*[!-~¡-ſ])?")
_PLAIN_TEXT = re.compile("[\t\n\r -~¡-įı-ſ]*")
_WORDS = re.compile(f"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
_PLAIN_WORDS, _PLAIN_BYTES = re.compile("[\n!-~¡-įı-ſ]*"), re.compile("[\0\n -~¡-ſ]*")
_TAILS = (",", ".")
#: Spaces that not every library takes for spaces, and the end of pieces here.
_ODD = re.compile("[\0\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PAIRS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Characters of a cached piece at most.
KEPT_CHARS = 64
#: For Arrow, in columns without odd spaces: texts with white space in a row, pieces to
#: split here, and their pre-tokens; white space ends a piece or is a single character.
_RUN, _PLAIN_PIECE = "[ \t\n\r]{2}", "^[\t\n\r -~¡-ſ]*$"
_PRE_TOKEN = f"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^ \t\n\r{_L}{_N}]+|[ \t\n\r]+"
#: Bytes of a column that Arrow takes at once; a longer text goes to encode().
COLUMN_BYTES = 64 << 20
#: Distinct pre-tokens of a column that the library gets at once.
COLUMN_WORDS = 1024


def _binary(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Binary values that lie one after another; ends begins with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])


def _joined(lists: pa.Array, values: pa.Array) -> pa.Array:
    """The joined binary values of each list; values has one for each list element."""
    ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1)
    return _binary(ends[lists.offsets.to_numpy()], values.buffers()[2])


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


class TextEncoder:
    """Ids of whole texts as little-endian bytes of `dtype` (the narrowest that
    holds the vocabulary), equal to the library's without added special tokens."""

    def __init__(self, path: str, cap: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "Sequence"
        if not self.by_word and not (pre.get("type") == "ByteLevel" and pre.get("use_regex")):
            raise ValueError("only word-split or byte-level BPE files are supported")
        spec |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        small = self.whole.get_vocab_size(True) <= 0xFF00
        self.dtype = np.dtype("<u2" if small else "<u4")
        self.end = b"\xff" * self.dtype.itemsize
        self.letters = _byte_letters()
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.lengths = np.zeros(self.whole.get_vocab_size(True), np.int64)
        for token, i in spec["model"]["vocab"].items():
            self.lengths[i] = len(token.removesuffix(suffix) if suffix else token)
        self.cap, self.young, self.old = cap, {}, {}
        self.words = None if self.by_word else Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))

    def _cut(self, text: str) -> list[str]:
        if self.by_word:
            return text.split()
        if text[:1] == " " or text[-1:] == " " or any(p in text for p in _PAIRS):
            return _CUT.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def _learn(self, fresh: set[str]) -> None:
        if len(self.young) + len(fresh) > self.cap:
            self.old, self.young = self.young, {}
        # a letter or digit before a last comma or stop always ends a pre-token there
        ends = [p for p in fresh if p[-1:] in _TAILS and p[-2:-1].lower().isalnum()]
        if ends:
            bases = {p[:-1] for p in ends}
            unknown = bases.difference(self.young)
            again = unknown.intersection(self.old)
            self.young.update({p: self.old[p] for p in again})
            self._learn_pieces(fresh.difference(ends).union(unknown.difference(again)))
            tails = {t: self.tail(t) for t in _TAILS}
            self.young.update({p: self.young[p[:-1]] + tails[p[-1]] for p in ends})
        else:
            self._learn_pieces(fresh)

    def tail(self, mark: str) -> bytes:
        """The ids of a comma or stop that follows a letter or digit."""
        return np.array(self.whole.encode(mark, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn_pieces(self, fresh: set[str]) -> None:
        pattern, mark = (_WORD, "\n") if self.by_word else (_BYTE, "\0")
        simple, other = list(fresh), []
        text = mark.join(simple) + mark
        if not (_PLAIN_WORDS.fullmatch(text) if self.by_word else _PLAIN_BYTES.fullmatch(text) and " \0" not in text and "\n\0" not in text):
            plain = _PLAIN_WORD if self.by_word else _PLAIN_BYTE
            simple = [p for p in fresh if plain.fullmatch(p)]
            other = list(fresh.difference(simple))
        if other:
            for p, e in zip(other, self.whole.encode_batch(other, add_special_tokens=False)):
                self.young[p] = np.array(e.ids, self.dtype).tobytes()
        if not simple:
            return
        text = mark.join(simple)
        flat = pattern.findall(text.lower() if self.by_word else text)
        distinct = dict.fromkeys(flat)
        distinct.pop(mark, None)
        ids: dict[str, bytes] = {mark: self.end}
        if distinct:
            shown = "\0".join(distinct).encode().decode("latin-1").translate(self.letters).split(self.letters[0])
            got = np.array(self.pieces.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
            # tokens cover their pre-token letter by letter, so lengths tell where each ends
            spans, lengths = np.cumsum(self.lengths[got]), np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)))
            if not len(got) or spans[-1] != lengths[-1]:
                raise RuntimeError("the vocabulary does not cover all bytes")
            marked = np.insert(got, np.searchsorted(spans, lengths[:-1]) + 1, np.iinfo(self.dtype).max)
            ids.update(zip(distinct, marked.tobytes().split(self.end)))
        # the end mark's bytes are in no id, so the joined ids can be cut at it
        self.young.update(zip(simple, b"".join(map(ids.__getitem__, flat)).split(self.end)))

    def looked_up(self, texts: list[str]) -> list[list | None]:
        """What is kept for each piece of each text; None for texts that go to
        the library whole."""
        cuts = [None if "<|" in t or _ODD.search(t) else self._cut(t) for t in texts]
        fresh = set().union(*(c for c in cuts if c is not None)).difference(self.young)
        if fresh:
            again = fresh.intersection(self.old)
            self.young.update({p: self.old[p] for p in again})
            kept = self.young
            if fresh := fresh.difference(again):
                self._learn(fresh)
            if kept is not self.young:  # a new generation: what these texts use is in either
                found = [None if c is None else [self.young[p] if p in self.young else kept[p] for p in c] for c in cuts]
            else:
                found = [None if c is None else list(map(self.young.__getitem__, c)) for c in cuts]
            for p in fresh:
                if len(p) > KEPT_CHARS:
                    self.young.pop(p, None)
                    self.young.pop(p[:-1], None)
            return found
        return [None if c is None else list(map(self.young.__getitem__, c)) for c in cuts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of self.dtype."""
        return [
            b"".join(vals) if vals is not None else np.array(self.whole.encode(t, add_special_tokens=False).ids, self.dtype).tobytes()
            for t, vals in zip(texts, self.looked_up(texts))
        ]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """As encode, for strings none of which is missing."""
        large = texts.nbytes > COLUMN_BYTES
        if self.by_word or large and len(texts) == 1:
            return self.encode(texts.to_pylist())
        if large:
            half = len(texts) // 2
            return self.encode_column(texts[:half]) + self.encode_column(texts[half:])
        alone = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _ODD.pattern))
        if not pc.any(alone).as_py():
            return self._encode_plain(texts).to_pylist()
        rest = iter(self._encode_plain(texts.filter(pc.invert(alone))).to_pylist())
        return [self.encode([t.as_py()])[0] if a else next(rest) for t, a in zip(texts, alone.to_pylist())]

    def _encode_plain(self, texts: pa.Array) -> pa.Array:
        # the last white space before another character begins a pre-token, or is one if it is no space
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        runs = pc.match_substring_regex(texts, _RUN)
        if pc.any(runs).as_py():
            found = pc.replace_substring_regex(texts.filter(runs), " ([^ \t\n\r])", "\0 \\1")
            found = pc.replace_substring_regex(found, "([\t\n\r])([^ \t\n\r\0])", "\0\\1\0\\2")
            cut = pc.replace_with_mask(cut, runs, found)
        cut = pc.split_pattern(cut, "\0")
        pieces = cut.values.dictionary_encode()
        plain, at = pc.match_substring_regex(pieces.dictionary, _PLAIN_PIECE), pieces.indices
        ids = self._encode_pieces(pieces.dictionary.filter(plain))
        if not pc.all(plain).as_py():
            other = pieces.dictionary.filter(pc.invert(plain))
            ids = pa.concat_arrays([ids, pa.array([np.array(self.whole.encode_batch_fast([p.as_py()], add_special_tokens=False)[0].ids, self.dtype).tobytes() for p in other], pa.binary())])
            at = pa.array(np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"))).take(at)
        return _joined(cut, ids.take(at))

    def _encode_pieces(self, pieces: pa.Array) -> pa.Array:
        split = pc.split_pattern(pc.replace_substring_regex(pieces, _PRE_TOKEN, "\\0\0"), "\0")
        words = split.values.dictionary_encode()
        ids, sizes = [], []
        for a in range(0, len(words.dictionary), COLUMN_WORDS):
            shown = "\0".join(words.dictionary[a : a + COLUMN_WORDS].to_pylist()).encode().decode("latin-1").translate(self.letters).split(self.letters[0])
            got = np.array(self.words.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, self.dtype)
            # tokens cover their pre-token letter by letter, so lengths tell where each ends
            spans, lengths = np.cumsum(self.lengths[got]), np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)))
            if (spans[-1] if len(got) else 0) != lengths[-1]:
                raise RuntimeError("the vocabulary does not cover all bytes")
            ids.append(got.tobytes())
            sizes.append(np.diff(np.searchsorted(spans, lengths, "right"), prepend=0))
        ends = np.cumsum(np.concatenate(([0], *sizes))) * self.dtype.itemsize
        return _joined(split, _binary(ends, pa.py_buffer(b"".join(ids))).take(words.indices))


class PreTokens:
    """The pre-tokens of texts of a word-split vocabulary, and how many tokens each has."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("pre_tokenizer") or {}).get("type") != "Sequence":
            raise ValueError("only word-split BPE files are supported")
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        spec |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        self.pieces.no_truncation()
        self.pieces.no_padding()
        self.letters = _byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}

    def of(self, text: str) -> list[str]:
        """All pre-tokens of a text, normalized; special strings of the vocabulary stay
        as they are."""
        if self.cut is not None and "<|" in text and self.cut.search(text):
            out: list[str] = []
            for part in self.cut.split(text):
                out += [part] if part in self.special else self.of(part) if part else []
            return out
        if _PLAIN_TEXT.fullmatch(text):
            return _WORDS.findall(text.lower())
        if _ODD.search(text):
            return self._by_library(text)
        out = []
        for piece in text.split():
            out += _WORDS.findall(piece.lower()) if _PLAIN_WORD.fullmatch(piece) else self._by_library(piece)
        return out

    def _by_library(self, text: str) -> list[str]:
        found = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, p)).decode("utf-8", "surrogatepass") for p, _ in found]

    def counts(self, words: list[str]) -> list[int]:
        """The number of tokens of each pre-token."""
        shown = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for w in words]
        found = [len(e) for e in self.pieces.encode_batch_fast([[s] for s in shown], is_pretokenized=True, add_special_tokens=False)]
        return [1 if w in self.special else n for w, n in zip(words, found)]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)
