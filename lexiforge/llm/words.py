"""What the two tokenizers share: long texts in parts, and the ids of words kept in bounded memory."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Texts longer than this are encoded in parts.
PART = 4 << 20


def parts(text: str, gap: re.Pattern, size: int | None = None) -> Iterator[str]:
    """The text in parts of about `size` characters (PART), each of which begins where `gap` matches."""
    size, at = size or PART, 0
    while len(text) - at > size:
        found = gap.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class WordMemory:
    """Words and their ids, in two generations, so that frequent words stay when rare ones go.

    learn: gives the ids of new words, as bytes; most: bytes for the words of both generations, about.
    """

    def __init__(self, learn: Callable[[list[str]], dict[str, bytes]], most: int) -> None:
        self.learn, self.most, self.size = learn, most, 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _know(self, words: set) -> None:
        new = words.difference(self.known)
        kept = {w for w in new if w in self.older}
        self.known.update((w, self.older[w]) for w in kept)
        self.known.update(self.learn(list(new - kept)))
        self.size += sum(map(len, new)) + sum(map(len, map(self.known.__getitem__, new))) + 150 * len(new)

    def _forget(self) -> None:
        if 2 * self.size > self.most:
            self.older, self.known, self.size = self.known, {}, 0

    def of(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of words, one after another."""
        self._know(set().union(*texts))
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in texts]
        self._forget()
        return out

    def each(self, words: list) -> list[bytes]:
        """The ids of each word."""
        self._know(set(words))
        out = list(map(self.known.__getitem__, words))
        self._forget()
        return out

    def encode(self, texts: list[str], split: Callable[[str], list[str]], gap: re.Pattern) -> list[bytes]:
        """The ids of texts. split: cuts a text into words; gap: where a long text may be cut. Short texts are looked up together."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= PART):
                group.append(texts[at])
                size += len(texts[at])
                at += 1
            if size > PART:
                out.append(b"".join(self.of([split(p)])[0] for p in parts(group[0], gap)))
            else:
                out += self.of([split(t) for t in group])
        return out
