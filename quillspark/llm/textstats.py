"""Counts over whole texts, for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quillspark.llm.common import Substrings, grams, mix, per_text, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER, LOWER, DIGIT = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True
WINDOW = 5


@dataclass
class Counts:
    """A value for each text; starts, ends, first and hashes are those of the words."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether an earlier one equals it, and whether any other does."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    later, any_ = np.empty(len(keys), bool), np.empty(len(keys), bool)
    later[order], any_[order] = same[:-1], same[:-1] | same[1:]
    return later, any_


def of_text(ptr: np.ndarray) -> np.ndarray:
    """A number that tells texts apart, for each item."""
    return np.repeat(mix(np.arange(1, len(ptr), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.diff(ptr))


def count(data: np.ndarray, offsets: np.ndarray) -> Counts:
    hashed = Substrings(data)
    starts, ends, first = words(data, offsets)
    hashes = hashed(starts, ends) + (ends - starts).astype(np.uint64)
    in_words = np.zeros(len(data) + 1, np.int8)
    in_words[starts] += 1
    in_words[ends] -= 1
    inside = np.cumsum(in_words[:-1], dtype=np.int8).astype(bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    edge[1:] |= np.append(data == 10, False)[:-1]
    edge[-1] = False
    line = np.flatnonzero(edge[:-1])
    stop = np.append(line[1:], len(data))
    stop = np.where((stop > line) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(data) else stop
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, line)
    line, stop = line[worded], stop[worded]
    line_ptr = np.searchsorted(line, offsets)
    again, _ = repeats(hashed(line, stop) + (stop - line).astype(np.uint64) ^ of_text(line_ptr))
    windows, ptr = grams(hashes, first, WINDOW)
    _, twice = repeats(windows ^ of_text(ptr))
    at = np.arange(len(windows)) + np.repeat(first[:-1] - ptr[:-1], np.diff(ptr))
    cover = np.zeros(len(starts) + WINDOW + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeated = np.cumsum(cover)[: len(starts)] > 0
    return Counts(
        starts, ends, first, hashes, np.diff(first),
        per_text(inside & ((data & 0xC0) != 0x80), offsets), per_text(SYMBOL[data], offsets),
        np.diff(line_ptr), per_text(again, line_ptr), per_text(repeated, first),
    )
