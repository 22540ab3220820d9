"""Token ids of whole text slices with a public tokenizer file.

White space separates words for the tokenizer, so a text's ids are its words' ids one
after the other. A worker encodes each distinct word once and finds it again by its hash, in
arrays of some 30 bytes a word; beyond a number of words it starts anew.
The contents of added tokens, such as <|endoftext|>, are plain text or those tokens.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from trolley.llm.spans import SPACED, Prefix, words

CACHED_WORDS = 400_000
# parts of words in each half of their memory, about 140 bytes each
CACHED_PARTS = 100_000
# the pattern by which the tokenizer file splits words, and the last letter up to which
# words are split here; it is a fixed value of that file
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "ɏ"

_encoders: dict[tuple[str, bool], Callable] = {}


class Memory:
    """Results by key: at least the last ``most`` keys asked for, at most twice as many.

    New and reused keys go to one half; once it is full it becomes the old half, and what
    was left in that is forgotten.
    """

    def __init__(self, make: Callable, most: int):
        self.make, self.most = make, most
        self.new, self.old = {}, {}

    def __call__(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(self.new) >= self.most:
                self.new, self.old = {}, self.new
            self.new[key] = found
        return found


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _word_encoder(path: str, added_tokens: bool) -> Callable[[bytes], bytes]:
    """The ids of one word as little-endian 32-bit numbers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not added_tokens
    pattern, stand_in = regex.compile(SPLIT), _byte_letters()
    contents = [regex.escape(t.content) for t in whole.get_added_tokens_decoder().values()] if added_tokens else []
    odd = regex.compile("|".join([r"[\x00-\x1f\x7f-\xa0\xad]|[^\x00-%s]" % PLAIN, *contents]))
    tokenize = whole.model.tokenize

    def merged(part: str) -> bytes:
        shown = "".join(map(stand_in.__getitem__, part.encode()))
        return np.array([t.id for t in tokenize(shown)], "<u4").tobytes()

    part_ids = Memory(merged, CACHED_PARTS)

    def encode(word: bytes) -> bytes:
        text = word.decode()
        if odd.search(text):
            ids = whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        return b"".join(map(part_ids, pattern.findall(text.lower())))

    return encode


def encoder(path: str, added_tokens: bool = False) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from the bytes and row offsets of texts to all ids and their row offsets."""
    if (path, added_tokens) in _encoders:
        return _encoders[path, added_tokens]
    one = _word_encoder(path, added_tokens)
    # sorted hashes of the known words, where the ids of each begin, and all ids
    known = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn(hashes: np.ndarray, found: list[bytes]) -> None:
        """Add unknown words, given by their sorted hashes, to the known ones."""
        nonlocal known
        old, bounds, ids = known
        at, new = np.searchsorted(old, hashes), np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.insert(ids, np.repeat(bounds[at], lengths), new)
        lengths = np.insert(np.diff(bounds), at, lengths)
        known = np.insert(old, at, hashes), np.concatenate([[0], np.cumsum(lengths)]), ids

    def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nonlocal known
        starts, ends, rows = words(data, offsets, SPACED)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes, sample, which = np.unique(Prefix(data).of(starts, ends), return_index=True, return_inverse=True)

        new = np.flatnonzero(~np.isin(hashes, known[0], assume_unique=True))
        if len(known[0]) + len(new) > CACHED_WORDS:
            known, new = (known[0][:0], known[1][:1], known[2][:0]), np.arange(len(hashes))
        raw = data.tobytes()
        spans = zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)
        learn(hashes[new], [one(raw[a:b]) for a, b in spans])
        _, bounds, ids = known
        word = np.searchsorted(known[0], hashes)[which]
        n = bounds[word + 1] - bounds[word]
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        at = np.arange(upto[-1]) + np.repeat(bounds[word] - upto[:-1], n)
        return ids[at].astype(np.uint32), upto[rows]

    _encoders[path, added_tokens] = encode
    return encode
