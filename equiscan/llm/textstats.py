"""Statistics of whole documents, computed for a slice of texts at once."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from equiscan.llm.textbytes import Texts, U, mix


def marks(characters: str, beyond_ascii: bool = False) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    if beyond_ascii:
        table[128:] = True
    return table


UPPER, LOWERCASE, DIGITS = (marks("".join(map(chr, range(ord(a), ord(b) + 1)))) for a, b in ("AZ", "az", "09"))
#: The characters counted as symbols.
SYMBOLS = marks("#*$%&|<>")
#: First byte of a code point.
LEADING = np.array([b & 0xC0 != 0x80 for b in range(256)])


class Statistics:
    """Counts of each text of a slice; words are separated by blanks and control white space, case is kept."""

    def __init__(self, texts: Texts) -> None:
        self.texts = texts

    def _of_bytes(self, table: np.ndarray) -> np.ndarray:
        return self.texts.count(table[self.texts.data])

    def _of_words(self, mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        first = self.texts.first_word
        return sums[first[1:]] - sums[first[:-1]]

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.texts.n_words

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in words."""
        return self.texts.count(self.texts.in_word & LEADING[self.texts.data])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._of_bytes(SYMBOLS)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._of_bytes(UPPER)

    @cached_property
    def n_lower(self) -> np.ndarray:
        return self._of_bytes(LOWERCASE)

    @cached_property
    def n_digits(self) -> np.ndarray:
        return self._of_bytes(DIGITS)

    @cached_property
    def n_beyond_ascii(self) -> np.ndarray:
        table = np.zeros(256, bool)
        table[0xC0:] = True
        return self._of_bytes(table)

    def n_of(self, characters: str) -> np.ndarray:
        return self._of_bytes(marks(characters))

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every line that has a word, in order."""
        t = self.texts
        breaks = np.flatnonzero(t.data == ord("\n"))
        starts = np.unique(np.concatenate([t.bounds[:-1], breaks + 1]))
        # A break that ends the last text, or a text's last byte, opens an empty line: it has no word and goes.
        starts = starts[starts < len(t.data)]
        ends = np.append(starts[1:], len(t.data)) if len(starts) else starts
        ends = ends - ((ends > starts) & (t.data[np.maximum(ends - 1, 0)] == ord("\n"))) if len(starts) else ends
        words = np.searchsorted(t.words[0], ends) - np.searchsorted(t.words[0], starts)
        starts, ends = starts[words > 0], ends[words > 0]
        return np.searchsorted(t.bounds, starts, "right") - 1, t.hashes(starts, ends)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[0], minlength=len(self.texts))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        text, h = self._lines
        distinct = np.unique(h ^ mix(text.astype(np.uint64) + U(1)), return_index=True)[1]
        return self.n_lines - np.bincount(text[distinct], minlength=len(self.texts))

    def repeated_words(self, k: int) -> np.ndarray:
        """Words inside windows of ``k`` words that stand at least twice in their text, the first time included."""
        at, h = self.texts.windows(k)
        key = h ^ mix(self.texts.text_of_word()[at].astype(np.uint64) + U(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(self.texts.words[0]) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + k, -1)
        return self._of_words(np.cumsum(cover[:-1]) > 0)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        return self.repeated_words(8)

    @cached_property
    def _word_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, times it occurs there) of every distinct word of each text."""
        text = self.texts.text_of_word()
        key = self.texts.word_hashes ^ mix(text.astype(np.uint64) + U(1))
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        return text[first], times, first

    @cached_property
    def n_distinct(self) -> np.ndarray:
        return np.bincount(self._word_keys[0], minlength=len(self.texts))

    @cached_property
    def most_frequent(self) -> np.ndarray:
        """Times the commonest word occurs."""
        out = np.zeros(len(self.texts), np.int64)
        np.maximum.at(out, self._word_keys[0], self._word_keys[1])
        return out

    @cached_property
    def n_same_as_last(self) -> np.ndarray:
        """Words equal to the word before them."""
        h = self.texts.word_hashes
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        heads = self.texts.first_word[:-1]
        same[heads[heads < len(h)]] = False
        return self._of_words(same)

    @cached_property
    def n_short(self) -> np.ndarray:
        """Words of at most two bytes."""
        starts, ends = self.texts.words
        return self._of_words(ends - starts <= 2)

    @cached_property
    def n_long(self) -> np.ndarray:
        """Words of over 14 bytes."""
        starts, ends = self.texts.words
        return self._of_words(ends - starts > 14)


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)
