"""Noisy-channel restoration of disguised words.

The writer meant a letter sequence; the channel replaced letters by look-alikes, repeated them or put blanks and marks between
them. For a suspicious stretch the observed characters span a lattice: each may stand for a letter, be a repeat of the letter
before, or, between single letters, be a mark to drop or a real word break. Viterbi decoding over contexts of three symbols finds
the most likely reading under a character four-gram model, weighed against the cost of each channel act.
"""

from __future__ import annotations

import re

import numpy as np

#: Symbols of the model: 0 word break, 1-26 letters a-z, 27 any other letter or kept character.
SYMBOLS = 28
OTHER = 27

#: Look-alikes and the letters they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "",
}
LEET_COST, KEEP_COST, REPEAT_COST, LONG_REPEAT_COST, DROP_COST = 1.0, 6.0, 2.0, 0.5, 0.5

WORD = re.compile(r"[\w@$!|+*]+")
EDGES = "!|+*_"
SPACED = re.compile(r"(?<![^\W_])(?:(?:[^\W_]|[@$!|+])[ .*_-]{1,2}){2,}(?:[^\W_]|[@$!|+])(?![^\W_])")
#: Every match of SPACED has its last two letters like this.
SPACED_END = re.compile(r"[ .*_-](?:[^\W_]|[@$!|+])[ .*_-]{1,2}(?:[^\W_]|[@$!|+])(?![^\W_])")
LEET = re.compile(r"[0-9@$!|+*]")
LETTER = re.compile(r"[^\W\d_]")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
DOUBLE = re.compile(r"([^\W\d_])\1")
RUNS = re.compile(r"(.)\1+", re.S)


def skeleton(word: str) -> str:
    """The word with every run of a character as one."""
    return RUNS.sub(r"\1", word)


class SymbolTable:
    """Code points to symbols, for counting."""

    def __init__(self):
        table = np.zeros(0x110000, np.uint8)
        letters = [i for i in range(0x20000) if chr(i).isalpha()]
        table[letters] = OTHER
        for i in range(26):
            table[97 + i] = i + 1
        self.table = table

    def counts(self, text: str, total: np.ndarray, chunk: int = 1 << 20) -> None:
        """Adds the four-grams of the lower-cased text, breaks included, to total (SYMBOLS ** 4)."""
        text = f"   {text.lower()}   "
        for i in range(0, len(text) - 3, chunk):
            points = np.frombuffer(text[i : i + chunk + 3].encode("utf-32-le", "surrogatepass"), "<u4")
            s = self.table[points].astype(np.int32)
            codes = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
            total += np.bincount(codes, minlength=SYMBOLS**4)


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(symbol | three symbols before), Witten-Bell smoothed, from four-gram counts; shape (SYMBOLS,) * 4, float32."""
    full = counts.reshape((SYMBOLS,) * 4).astype(float)
    # runs of breaks say nothing about words
    full[:, 0, 0, 0] = 0
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for level in (3, 2, 1, 0):
        c = full.sum(axis=tuple(range(level)))
        total, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        p = (c + np.maximum(kinds, 1) * p) / (total + np.maximum(kinds, 1))
    return -np.log(p).astype(np.float32)


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


class Restorer:
    def __init__(self, model: np.ndarray):
        self.cost = model.ravel()
        self.known: dict[str, tuple[float, str]] = {}

    def decode(self, observed: str) -> str:
        """The most likely reading of a lower-case stretch; blanks in it separate single letters."""
        return self._decoded(observed)[1]

    def _decoded(self, observed: str) -> tuple[float, str]:
        """The cost of the most likely reading, and the reading."""
        # context of three symbols and the last letter read -> (cost, reading)
        beam: dict[tuple[int, str], tuple[float, str]] = {(0, ""): (0.0, "")}
        cube, cost = SYMBOLS**3, self.cost
        for i, c in enumerate(observed):
            nxt: dict[tuple[int, str], tuple[float, str]] = {}

            def offer(context: int, last: str, price: float, reading: str):
                key = (context, last)
                if key not in nxt or price < nxt[key][0]:
                    nxt[key] = (price, reading)

            long_run = observed[max(0, i - 2) : i + 3].count(c) >= 3
            letters = c if LETTER.match(c) else LOOKALIKES.get(c, "")
            for (context, last), (price, reading) in beam.items():
                if c == " ":
                    offer(context, last, price + DROP_COST, reading)
                    offer(context * SYMBOLS % cube, "", price + float(cost[context * SYMBOLS]), reading + " ")
                    continue
                for x in letters:
                    code = context * SYMBOLS + _symbol(x)
                    offer(code % cube, x, price + float(cost[code]) + (LEET_COST if x != c else 0.0), reading + x)
                    if x == last:
                        offer(context, last, price + (LONG_REPEAT_COST if long_run else REPEAT_COST), reading)
                if not letters or c in LOOKALIKES:
                    code = context * SYMBOLS + OTHER
                    offer(code % cube, "", price + float(cost[code]) + KEEP_COST, reading + c)
            beam = nxt
        return min(((price + float(cost[context * SYMBOLS]), reading) for (context, _), (price, reading) in beam.items()))

    def weighed(self, word: str) -> tuple[float, str]:
        if (found := self.known.get(word)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[word] = self._decoded(word)
        return found

    def word(self, word: str) -> str:
        return self.weighed(word)[1]


def suspicious(word: str) -> bool:
    """Whether a lower-case word may hide another one: look-alikes among letters, or a letter three times in a row."""
    return bool(LEET.search(word) and LETTER.search(word) or TRIPLE.search(word))


def _with_edges(edged: str, bare: str, restorer: Restorer) -> set[str]:
    """The words of a stretch's reading with the marks at its edges, if it is likelier than that without them."""
    price, reading = restorer.weighed(edged)
    if price >= restorer.weighed(bare)[0]:
        return set()
    return {w for part in reading.split() if (w := part.strip(EDGES))}


def forms(word: str, restorer: Restorer, doubled=lambda word: False) -> set[str]:
    """What a lower-case stretch without blanks may say: itself, or if it is suspicious, what it is restored to.

    `doubled` says for words with a letter twice in a row whether they are worth decoding; such words count in both forms, as
    most are spelt so. Marks at the edges may be punctuation or letters, so words with such are read both ways, and
    the reading with marks counts too where it is the likelier one.
    """
    w = word.strip(EDGES)
    if suspicious(w):
        out = set(restorer.word(w).split())
    elif w and DOUBLE.search(w) and doubled(w):
        out = {w, *restorer.word(w).split()}
    else:
        out = {w} if w else set()
    edged = word.strip("*_")
    if edged != w and LETTER.search(edged):
        out |= _with_edges(edged, w, restorer)
    return out


def spaced_words(low: str, restorer: Restorer) -> set[str]:
    """The words restored from three or more single letters or look-alikes with blanks or marks between them."""
    out: set[str] = set()
    if not SPACED_END.search(low):
        return out
    for m in SPACED.finditer(low):
        stretch = re.sub(r"[ .*_-]+", " ", m.group())
        if len(set(stretch)) > 2:
            # as in words, marks at the edges may be punctuation
            bare = stretch.strip(EDGES + " ")
            out.update(restorer.word(bare).split())
            if bare != stretch:
                out.update(_with_edges(stretch, bare, restorer))
    return out


def restored_words(text: str | None, restorer: Restorer, doubled=lambda word: False) -> set[str]:
    """The distinct lower-case words of a text, with the restored forms of its suspicious stretches."""
    low = (text or "").lower()
    words = set(WORD.findall(low))
    return spaced_words(low, restorer).union(*[forms(w, restorer, doubled) for w in words])
