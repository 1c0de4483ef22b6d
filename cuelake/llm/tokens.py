"""Token ids of whole texts by a public tokenizer, word by word through a cache.

The tokenizer drops white space and never joins what white space separates, so a text's ids are its words' ids in a row;
each distinct word is encoded once a worker. (Its normal form, NFC, composes nothing across ASCII white space.) It takes
lower case and ends a token between a letter and ASCII punctuation, so that "Word" and "word," share the ids of "word".
Texts are split, and their words made distinct, as Arrow arrays; only distinct words of a batch reach Python.

Words not seen before are encoded together. Words of ASCII letters are one piece each, whose last token is known by its
end mark. Between others stands a digit: a digit is always a piece of its own, so its id tells where a word's ids end.
Words that hold the digit, or a special token's "<|", are encoded alone.

Whether a vocabulary file behaves so is tried on probe texts when it is loaded; texts of one that doesn't are encoded whole.
"""

from __future__ import annotations

import os
import threading
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import tidy

#: Words whose ids a process remembers at most: two generations of half as many. When the young one is full it becomes the
#: old one; words of the old one that come again are young again. With LONG_WORD this bounds the bytes, to 140 MB at most and 60 MB as a rule.
MOST_WORDS = 500_000
#: Words longer than this many bytes are not remembered.
LONG_WORD = 64
#: Seconds without a text after which a process lets its tokenizer go.
IDLE = 4.0
#: Words that are encoded together, and bytes of text whose words are made distinct together.
TOGETHER = 8192
TOGETHER_CHARS = 6_000_000
_END = "</w>"
_PUNCTUATION = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
#: Texts on which a vocabulary's ids word by word are compared with those of the whole text.
PROBES = ("Word word, WORD; \"quoted\" it's don't IT'S", "a0b 10,000.00 x0 0", "  leading\ttabs\nlines  ", "naïve Éa, xé. İstanbul 한국", "<|a|> b<|c", "snake_case camelCase a/b #tag ***", "")


def _gather(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat, which lie there in order with these sizes, in the order of ``at``, and their sizes."""
    own = sizes[at]
    ends = np.cumsum(own)
    starts = np.cumsum(sizes) - sizes
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    places = np.repeat((starts[at] - ends + own).astype(kind), own)
    places += np.arange(total, dtype=kind)
    return flat[places], own


def _tails(words: pa.Array, runs: pa.Array) -> pa.Array:
    """What stands in each word behind its run, by the arrays' buffers."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(bounds) - pc.binary_length(runs).to_numpy(zero_copy_only=False)
    tails, _ = _gather(np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(np.concatenate([[0], np.column_stack([bounds[1:] - sizes, bounds[1:]]).ravel()])), np.arange(1, 2 * len(words), 2))
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(tails))


class WordTokenizer:
    """Ids of texts, as bytes of the smallest unsigned type that holds the vocabulary."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[k for token, k in vocabulary.items() if token.endswith(_END)]] = True
        self._digit = vocabulary.get(f"0{_END}")
        self._known: dict[bytes, bytes] = {b"": b""}
        self._old: dict[bytes, bytes] = {}
        self.by_words = self._digit is not None and self._as_whole(pa.array(PROBES))

    def _as_whole(self, texts: pa.Array) -> bool:
        try:
            return self._part(texts) == self._whole(texts)
        except (KeyError, ValueError):  # pieces without the marks that tell where a word's ids end
            return False

    def _whole(self, texts: pa.Array) -> list[bytes]:
        return [self._encode(x.encode()).tobytes() for x in texts.to_pylist()]

    def _encode(self, data: bytes) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([data.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, pieces: set[bytes]) -> None:
        known = self._known
        letters, others = [], []
        for p in pieces:
            if b"<|" in p or b"0" in p:
                known[p] = self._encode(p).tobytes()
            else:
                (letters if p.isalpha() else others).append(p)
        for kind, between in ((letters, b" "), (others, b" 0 ")):
            for at in range(0, len(kind), TOGETHER):
                part = kind[at : at + TOGETHER]
                ids = self._encode(between.join(part))
                if kind is letters:
                    ends, skip = (np.flatnonzero(self._ends[ids]) + 1).tolist(), 0
                else:
                    ends, skip = [*np.flatnonzero(ids == self._digit).tolist(), len(ids)], 1
                data, size, start = ids.tobytes(), self.dtype.itemsize, 0
                for p, end in zip(part, ends, strict=True):
                    known[p] = data[start * size : end * size]
                    start = end + skip

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, remembered ones from the two generations."""
        found = list(map(self._known.get, pieces))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            if len(self._known) + len(missing) > MOST_WORDS // 2:
                self._old, self._known = self._known, {b"": b""}
            known, old = self._known, self._old
            new = set()
            for k in missing:
                p = pieces[k]
                if (x := old.get(p)) is None:
                    new.add(p)
                else:
                    known[p] = x
            self._learn(new)
            for k in missing:
                found[k] = known[pieces[k]]
            for p in new:
                if len(p) > LONG_WORD:
                    del known[p]
        return found

    def _part(self, texts: pa.Array) -> list[bytes]:
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes() if bounds[-1] > bounds[0] else b""
        plain = not (b"<|" in whole or b"\xcc" in whole or b"\xcd" in whole)
        del whole
        # A-Z in lower case, unless that could make a special token or change how a mark composes
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if plain else texts)
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        n = len(words)
        if plain:
            runs = pc.ascii_rtrim(words, characters=_PUNCTUATION)
            cut = pc.utf8_is_alpha(pc.utf8_slice_codeunits(runs, -1))
            runs = pc.if_else(cut, runs, words)
            tails = _tails(words, runs)
            pieces = pa.concat_arrays([runs, tails]).dictionary_encode()
        else:
            pieces = words.dictionary_encode()
        distinct = self._ids_of(pieces.dictionary.cast(pa.binary()).to_pylist())
        size = self.dtype.itemsize
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // size
        code = pieces.indices.to_numpy(zero_copy_only=False)
        flat, sizes = _gather(np.frombuffer(b"".join(distinct), self.dtype), sizes, code.reshape(-1, n).T.ravel() if n else code)
        sizes = sizes.reshape(n, -1).sum(axis=1) if n else sizes
        ids, sizes = _gather(flat, sizes, at)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()] * size
        ids = ids.tobytes()
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def many(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids; null counts as empty. Works on so many texts at a time as have TOGETHER_CHARS, one at least."""
        _state["used"] = time.monotonic()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out, at = [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER_CHARS, "right")))
            out += (self._part if self.by_words else self._whole)(texts.slice(at, end - at))
            at = end
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.many(pa.array([text], pa.string()))[0], self.dtype)


_lock = threading.Lock()
_kept: dict[str, WordTokenizer] = {}
_state = {"used": 0.0, "watched": False}


def tokenizer(name: str) -> WordTokenizer:
    """The process's tokenizer of a vocabulary file, given by a path or a name among the public ones, with what it remembers.

    Tasks that follow each other share it; once no text has come for IDLE seconds it goes, so that a worker that serves
    other stages doesn't hold it.
    """
    with _lock:
        _state["used"] = time.monotonic()
        if name not in _kept:
            _kept.clear()
            _kept[name] = WordTokenizer(name if "/" in name else _public(name))
        if not _state["watched"]:
            _state["watched"] = True
            threading.Thread(target=_let_go, daemon=True).start()
        return _kept[name]


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _let_go() -> None:
    while True:
        time.sleep(IDLE / 4)
        with _lock:
            if time.monotonic() - _state["used"] > IDLE:
                _kept.clear()
                _state["watched"] = False
                break
    tidy()
