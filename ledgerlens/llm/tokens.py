"""Token ids of whole texts by a public tokenizer that drops white space."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

# Words remembered in each of two generations of the cache.
CACHE_WORDS = 400_000
_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, plain: bool = False) -> WordEncoder:
    """The encoder of this Python process; a later task finds the words of the earlier ones.

    plain: special tokens' strings in a text are ordinary text.
    """
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = WordEncoder(path, plain)
    return _ENCODERS[path, plain]


def forget() -> None:
    """Let go of this process' encoders: their words take up to some hundred MB for as long as it lives.

    Spark's Python workers live on from one operator's tasks to those of the next.
    """
    _ENCODERS.clear()


class WordEncoder:
    """Ids of texts, word by word with a cache.

    The tokenizer file must treat white space only as a separator. ASCII white space then never
    lies inside a token, so a text's ids are those of its words, one after the other. The cache
    holds ids as little-endian unsigned 32-bit bytes, which are joined like text.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.quick = self._quick_form()
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _quick_form(self) -> bool:
        """Whether the bare model encodes words of ASCII letters as the whole tokenizer does.

        Normalising and cutting such words takes most of the tokenizer's time and changes nothing;
        this is tried on every pair of letters, so a tokenizer that treats some otherwise is used whole.
        """
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.bare = Tokenizer.from_str(self.tokenizer.to_str())
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = "abcdefghijklmnopqrstuvwxyz"
        pairs = [a + b for a in letters for b in letters]
        pairs += [a + b + a + b for a, b in pairs]
        quick, whole = ([e.ids for e in t.encode_batch_fast(pairs, add_special_tokens=False)]
                        for t in (self.bare, self.tokenizer))
        upper = [e.ids for e in self.tokenizer.encode_batch_fast(
            [p.upper() for p in pairs], add_special_tokens=False)]
        return quick == whole == upper

    def _letters(self, words: list[bytes], bare: bool) -> list[bytes]:
        """Ids of words of letters alone, many at a time: each ends with its one word-end token."""
        out: list[bytes] = []
        tokenizer = self.bare if bare else self.tokenizer
        for at in range(0, len(words), 500):
            part = words[at:at + 500]
            found = tokenizer.encode_batch_fast(
                [b" ".join(part).decode()], add_special_tokens=False)[0].ids
            ids = np.array(found, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):  # some letter is not one to it
                out += self._each([w.decode() for w in part])
                continue
            data, start = ids.tobytes(), 0
            for stop in (4 * stops).tolist():
                out.append(data[start:stop])
                start = stop
        return out

    def learn(self, words: set[bytes]) -> None:
        """Bring the ids of all these words into the cache."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        cache, find = self.cache, self.older.get
        quick = self.quick
        plain: set[bytes] = set()
        letters: set[bytes] = set()
        odd: set[bytes] = set()
        split = []
        for word in [w for w in words if w not in cache]:
            ids = find(word)
            if ids is not None:
                cache[word] = ids
                continue
            # Most new words are letters with a mark behind, which is a piece of its own.
            core = word.rstrip(b".,;:!?")
            if quick and core.isalpha():
                core = core.lower()
                of = plain
            elif core and core.decode().isalpha():
                of = letters
            else:
                odd.add(word)
                continue
            if core != word:
                split.append((word, core, word[len(core):]))
                if core in cache:
                    continue
                ids = find(core)
                if ids is not None:
                    cache[core] = ids
                    continue
            of.add(core)
        for new, bare in ((list(plain), True), (list(letters), False)):
            cache.update(zip(new, self._letters(new, bare)))
        odd.update({t for _, _, t in split if t and t not in cache})
        rest = list(odd)
        for at in range(0, len(rest), 20_000):
            part = rest[at:at + 20_000]
            cache.update(zip(part, self._each([w.decode() for w in part])))
        for word, core, tail in split:
            cache[word] = cache[core] + cache[tail] if tail else cache[core]

    def encode(self, texts: list[bytes | None], end_id: int) -> list[np.ndarray]:
        """Ids of each text, with the end id last; a null text has the end id alone."""
        split = [(t or b"").split() for t in texts]
        self.learn(set(chain.from_iterable(split)))
        ids_of, end = self.cache.__getitem__, np.array([end_id], "<u4").tobytes()
        return [
            np.frombuffer(b"".join(map(ids_of, words)) + end, np.dtype("<u4")) for words in split]
