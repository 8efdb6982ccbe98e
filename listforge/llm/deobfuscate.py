"""Noisy-channel restoration of disguised words: a Viterbi search through character lattices under a trigram model.

A writer may have put look-alike signs for letters, separators between letters, or letters several times. Each sign of
a suspicious stretch offers the letters it may stand for, at a price; the search finds the cheapest reading, prices of
signs plus surprisal of letters, in time linear in the stretch, which may have any length and any number of separators.
"""

from __future__ import annotations

import re

import numpy as np

#: The model's letters; every other character is a border between words. At most 63 of them.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
SIZE = 64
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_LUT = np.zeros(0x200, np.int64)
for _c, _i in CODE.items():
    _LUT[ord(_c)] = _i

#: Signs and the letters they stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y"}
SEPARATORS = " .-_*~#'"
LOOK, DROP, AGAIN, BORDER = 0.7, 0.4, 0.6, 6.0
#: From so many states on, those go that can't be part of the cheapest reading.
CROWDED = 48
#: Longer stretches are read as well, but not remembered.
LONGEST = 48

BORDERS = " \n\t"
_BORDER = re.compile(f"[{BORDERS}]")
_SIGNS = re.escape("".join(LOOKS)) + r".\-_*~#"
_HINT = re.compile(rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|(?<!\S)[{re.escape(''.join(LOOKS))}][^\W\d_]|[^\W\d_][@$|](?!\S)|([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")


def trigrams(text: str) -> np.ndarray:
    """Numbers of the text's character trigrams, those between words left out."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    codes = np.concatenate([[0, 0], _LUT[np.minimum(points, 0x1FF)], [0]])
    # A border is seen twice before a word, so that its first letter has a context.
    grams = codes[:-2] * SIZE * SIZE + codes[1:-1] * SIZE + codes[2:]
    starts = np.flatnonzero((codes[1:-1] == 0) & (codes[2:] > 0))
    grams[starts] = codes[2:][starts]
    return grams[(codes[1:-1] > 0) | (codes[2:] > 0)]


class Model:
    """Surprisal of a letter after two others, from trigram counts."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        by_two, by_one = c.sum(axis=2, keepdims=True), c.sum(axis=0, keepdims=True)
        short = (by_one + 0.5) / (by_one.sum(axis=2, keepdims=True) + 0.5 * SIZE)
        cost = -np.log((c + 5 * short) / (by_two + 5))
        self.cost = cost.ravel().tolist()
        # What follows is open to all states alike, and costs them the same but for two letters and a border.
        self.slack = 3 * float(cost.max() - cost.min())
        self.known: dict[str, str] = {}

    def decode(self, span: str) -> str:
        """The likeliest reading of a stretch, words separated by spaces."""
        cost, span = self.cost, span.lower()
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        before = ""
        for sign in span:
            options = [(CODE[sign], 0.0)] if sign in CODE else [(CODE[x], LOOK) for x in LOOKS.get(sign, "")]
            skip = DROP if sign in SEPARATORS else AGAIN if sign == before else None if sign in CODE else BORDER if sign in LOOKS else BORDER / 2
            if sign not in CODE:
                options.append((0, BORDER))
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (p, q), (score, path) in states.items():
                if skip is not None and ((p, q) not in new or new[p, q][0] > score + skip):
                    new[p, q] = (score + skip, path)
                for x, price in options:
                    if x == 0:
                        key, s = (0, 0), score + price + (cost[p * 4096 + q * 64] if q else 0.0)
                    else:
                        key, s = (q, x), score + price + cost[p * 4096 + q * 64 + x]
                    if key not in new or new[key][0] > s:
                        new[key] = (s, (path, x))
            if len(new) > CROWDED:
                most = min(s for s, _ in new.values()) + self.slack
                new = {key: held for key, held in new.items() if held[0] <= most}
            states, before = new, sign
        _, path = min((score + (cost[p * 4096 + q * 64] if q else 0.0), path) for (p, q), (score, path) in states.items())
        out = []
        while path:
            path, x = path
            out.append(LETTERS[x - 1] if x else " ")
        return "".join(reversed(out))

    def read(self, span: str) -> str:
        if len(span) > 2 * LONGEST:
            return self.decode(span)
        found = self.known.get(span)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[span] = self.decode(span)
        return found

    def readings(self, text: str) -> list[str]:
        """Readings of the text's suspicious stretches, of any length; the search is linear in it."""
        out, done = [], 0
        for m in _HINT.finditer(text):
            if m.start() < done:
                continue
            low = max(text.rfind(b, done, m.start()) for b in BORDERS) + 1 or done
            done = next((x.start() for x in _BORDER.finditer(text, m.end())), len(text))
            out.append(self.read(text[low:done]))
        out += [self.read(m[0].replace("\t", " ")) for m in _SPACED.finditer(text)]
        return out
