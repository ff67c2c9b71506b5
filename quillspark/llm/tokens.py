"""Exact and quick encoding with the tokenizers library.

Both public vocabularies first split a text into pretokens by a pattern, and encode each on its own. Over a fixed alphabet, in which
the classes of characters are known and normalisation only lower-cases one character to one, that pattern is written here for ``re``;
the library gives each pretoken's ids, which are kept, as pretokens recur and its own cache is small. Texts with any other character,
or with what may be the content of an added token, go to the library whole, with its own settings.
"""

from __future__ import annotations

import json
import re

import numpy as np

LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼½¾"
BLANK = " \t\n\r\x0b\x0c\x85\xa0"
#: Characters beyond these have other classes, compose, or change their number in lower case (U+0130).
ALPHABET = "\0-\x1b -į", "ı-ɏ", "‐-‧‰-⁞₠-₿\U0001f300-\U0001f6ff"
OTHER = re.compile(f"[^{''.join(ALPHABET)}]")
#: Where texts are lower-cased, nor may capitals be among them whose small letters lie beyond.
OTHER_LOWER = re.compile(f"[^{ALPHABET[0]}{''.join(c for c in map(chr, range(0x131, 0x250)) if not OTHER.search(c.lower()))}{ALPHABET[2]}]")
CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
DROPS = re.compile(f"{CONTRACTED}|[{LETTER}]+|[{NUMBER}]|[^{BLANK}{LETTER}{NUMBER}]+")
KEEPS = re.compile(f"{CONTRACTED}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


class Encoder:
    _own: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str, drops_space: bool) -> Encoder:
        """The worker's own: it outlives tasks, and so do the ids it knows."""
        if path not in cls._own:
            cls._own[path] = cls(path, drops_space)
        return cls._own[path]

    def __init__(self, path: str, drops_space: bool, most: int = 1_000_000):
        """most: pretokens whose ids are kept; the older half goes when there are more."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space, self.most, self.known = drops_space, most, {}
        self.split, self.other = (DROPS.findall, OTHER_LOWER.search) if drops_space else (KEEPS.findall, OTHER.search)
        #: Every added token starts with one of these.
        self.added = sorted({x["content"][:2] for x in json.loads(self.tokenizer.to_str())["added_tokens"]})
        vocabulary = self.tokenizer.get_vocab()
        self.last = max([*vocabulary.values(), *(x["id"] for x in json.loads(self.tokenizer.to_str())["added_tokens"])], default=0)
        self.line = vocabulary.get("Ċ", -1)
        #: Ids that end a pretoken of letters, or with kept space, that start one with a space.
        self.border = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.border[[v for k, v in vocabulary.items() if (k.endswith("</w>") if drops_space else k.startswith("Ġ"))]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def _joined(self, words: list[str], between: str) -> list[bytes]:
        """Pretokens of letters that go to the library as one text; the ids that border them tell them apart."""
        out = []
        for i in range(0, len(words), 4096):
            own = words[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(own)], add_special_tokens=False)[0].ids, "<u4")
            if between == "\n":
                at = np.flatnonzero(ids == self.line)
                starts, ends = [0, *(at + 1)], [*at, len(ids)]
            else:
                at = np.flatnonzero(self.border[ids])
                starts, ends = ([0, *(at[:-1] + 1)], [*(at + 1)]) if self.drops_space else ([*at], [*at[1:], len(ids)])
            if len(starts) != len(own) or len(ends) != len(own) or starts[0] or ends[-1] != len(ids):
                out += self._each(own)
            else:
                ids = ids.tobytes()
                out += [ids[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
        return out

    def _learn(self, missing: list[str]) -> None:
        if len(self.known) + len(missing) > self.most:
            self.known = dict(list(self.known.items())[len(self.known) // 2 :])
        if self.drops_space:
            words = [x for x in missing if x.isalpha()]
            self.known.update(zip(words, self._joined(words, " "), strict=True))
        else:
            words = [x for x in missing if x[0] == " " and x[1:].isalpha()]
            self.known.update(zip(words, self._joined(words, ""), strict=True))
            words = [x for x in missing if x.isalpha()]
            self.known.update(zip(words, self._joined(words, "\n"), strict=True))
        odd = [x for x in missing if x not in self.known]
        self.known.update(zip(odd, self._each(odd), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        flat, edges, whole = [], [0], []
        for i, text in enumerate(texts):
            if any(x in text for x in self.added) or self.other(text):
                whole.append(i)
            else:
                flat += self.split(text.lower() if self.drops_space else text)
            edges.append(len(flat))
        ids = list(map(self.known.get, flat))
        if None in ids:
            lacking = [i for i, x in enumerate(ids) if x is None]
            self._learn(list(dict.fromkeys(flat[i] for i in lacking)))
            for i in lacking:
                ids[i] = self.known[flat[i]]
        out = [b"".join(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        for i, x in zip(whole, self._each([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out
