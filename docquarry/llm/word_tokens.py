"""Token ids of whole texts by a tokenizer of the ``tokenizers`` library, with a cache of words.

For tokenizers whose pre-tokens never span white space, drop it, and end in a token with the word-end suffix. A text's ids
are then those of its words one after the other, and a word's those of its pre-tokens. New pre-tokens are encoded by the
library, many to a call; the word-end tokens tell where each one's ids end. Texts with characters for which splitting at
white space is not safe are encoded whole by the library, and so are texts that hold the string of an added token such as
``<|endoftext|>``, which the library's plain ``encode`` turns into that token's id.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .common import Finder, newer_characters

#: Characters that Python's str.split() takes for white space and Unicode's White_Space doesn't; and a letter whose lower
#: case depends on its neighbours in Python.
SPECIAL = "\x1c-\x1fΣ"


class WordTokens:
    #: Longer words aren't kept: a text without blanks is one word.
    LONGEST = 64

    def __init__(self, path: str, cache_size: int = 800_000, batch: int = 50_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, *rest = spec["pre_tokenizer"]["pretokenizers"]
        suffix = spec["model"]["end_of_word_suffix"]
        if split["type"] != "Split" or not suffix:
            raise ValueError("this needs a tokenizer that splits by a pattern and marks word ends")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        # the same model for pre-tokens that are already normal and split: one call takes many, with blanks between
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}
        self.split_tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.split_tokenizer.encode_special_tokens = True
        self.added = [s for t in spec["added_tokens"] for s in {t["content"], self._normal(t["content"])}]
        vocabulary = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.special = Finder(SPECIAL + newer_characters())
        self.cache: dict[str, bytes] = {}
        self.cache_size, self.batch = cache_size, batch

    def encode_slice(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        normal = [None if self.special(t) else self._plain(t) for t in texts]
        # each distinct word is looked up once; the rest is gathering by position
        split = pc.utf8_split_whitespace(pa.array([n or "" for n in normal], pa.large_string()))
        words = split.flatten().dictionary_encode()
        distinct, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        cache = self.cache
        cache[""] = b""  # blanks at an end leave an empty word there
        blobs = list(map(cache.get, distinct))
        missing = [i for i, b in enumerate(blobs) if b is None]
        new = [distinct[i] for i in missing]
        for k in range(0, len(new), self.batch):
            self._learn(new[k : k + self.batch])
        for i, word in zip(missing, new, strict=True):
            blobs[i] = cache[word]
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        begin = np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[at])])
        ids = np.frombuffer(b"".join(blobs), "<u4")[np.repeat(begin[at] - ends[:-1], size[at]) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[split.offsets.to_numpy()]).tolist()
        out = [self._whole(t) if n is None else ids[a:b] for t, n, a, b in zip(texts, normal, bounds, bounds[1:], strict=False)]
        for word in new:
            if len(word) > self.LONGEST:
                del cache[word]
        return out

    @staticmethod
    def _normal(text: str) -> str:
        return unicodedata.normalize("NFC", text).lower()

    def _plain(self, text: str) -> str | None:
        """The normal form of a text; None if it holds an added token."""
        normal = self._normal(text)
        return None if any(s in normal or s in text for s in self.added) else normal

    def _pieces(self, word: str) -> list[str]:
        """The pre-tokens of a word that isn't letters only; letters with one mark at the end need no pattern."""
        if word[-1] in ".,!?;:" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pattern.findall(word)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]  # these are one pre-token each
        others = [w for w in words if not w.isalpha()]
        pieces = [self._pieces(w) for w in others]
        cached = self.cache
        known = {p: cached[p] for x in pieces for p in x if p in cached and p.isalpha()}
        distinct = list(set(plain).union(*pieces) - known.keys())
        lines = [" ".join(distinct[k : k + 50]) for k in range(0, len(distinct), 50)]
        ids = np.concatenate([np.empty(0, "<u4")] + [np.array(x.ids, "<u4") for k in range(0, len(lines), 100) for x in self.split_tokenizer.encode_batch_fast(lines[k : k + 100], add_special_tokens=False)])
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(distinct):  # a pre-token without an end mark, such as one that the vocabulary can't spell
            self.cache.update((w, self._whole(w)) for w in words)
            return
        blob = ids.tobytes()
        known.update((p, blob[a:b]) for p, a, b in zip(distinct, [0, *ends], ends))
        find = known.__getitem__
        self.cache.update(zip(plain, map(find, plain), strict=True))
        self.cache.update((w, find(x[0]) + find(x[1]) if len(x) == 2 else b"".join(map(find, x))) for w, x in zip(others, pieces, strict=True))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
