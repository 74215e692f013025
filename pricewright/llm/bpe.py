"""Merge-rank vocabularies: which adjacent pieces can stand side by side in an encoding.

A greedy merge encoding has a local characterisation: a piece sequence is the encoding of its text
exactly if every two neighbours are the encoding of their own concatenation. Both the counting
transducer and the Viterbi encoder rest on this.
"""

from __future__ import annotations

import json


class Merges:
    """Pieces by rank, the pair each piece is merged from, and the pieces that pairs merge into.

    split[t] is (left, right) for a merged piece and None for an atom; joins maps left * SPAN + right to
    the merged piece; rank orders the merges (lower first).
    """

    SPAN = 1 << 20

    def __init__(self, split: list[tuple[int, int] | None], joins: dict[int, int], rank: list[int]):
        self.split, self.joins, self.rank = split, joins, rank
        self._fits: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        key = left * self.SPAN + right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 4_000_000:
                self._fits.clear()
            known = self._fits[key] = self._decide(left, right)
        return known

    def all_fit(self, keys: list[int]) -> list[bool]:
        """fits for each left * SPAN + right."""
        known = list(map(self._fits.get, keys))
        return [self.fits(k // self.SPAN, k % self.SPAN) if f is None else f for k, f in zip(keys, known)]

    def _decide(self, left: int, right: int, before: tuple[int, bool] | None = None) -> bool:
        """Undo the merges next to the border, latest first: at no moment may a merge over the border
        have come before the merge that is undone. before: (rank, whether an equal rank counts too)."""
        rank, split, joins = self.rank, self.split, self.joins
        while True:
            over = joins.get(left * self.SPAN + right)
            if over is not None:
                r = rank[over]
                # the merge undone on the right side starts right of the border: on equal rank the border is leftmost
                if before is None or r < before[0] or (r == before[0] and before[1]):
                    return False
            a, b = split[left], split[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and rank[left] > rank[right]):
                before = (rank[left], False)
                left = a[1]
            elif a is None or rank[right] > rank[left]:
                before = (rank[right], True)
                right = b[0]
            else:  # the same piece on both sides: the left one was merged first, so the right is undone first
                before = (rank[right], True)
                right = b[0]


#: The printable stand-ins of byte-level vocabularies: bytes that print keep their code point, the others follow from 256.
def byte_of_char() -> dict[str, int]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    return out | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(keep))}


def from_json(path: str) -> tuple[Merges, list[bytes], dict[bytes, int]]:
    """A byte-level vocabulary with listed merges: (merges, bytes of each id, id of each byte string)."""
    with open(path) as f:
        model = json.load(f)["model"]
    vocab, chars = model["vocab"], byte_of_char()
    size = max(vocab.values()) + 1
    text: list[bytes] = [b""] * size
    for s, i in vocab.items():
        text[i] = bytes(chars[c] for c in s) if all(c in chars for c in s) else b""
    split: list = [None] * size
    rank, joins = [-1] * size, {}
    for r, (a, b) in enumerate(model["merges"]):
        i, j, k = vocab[a], vocab[b], vocab[a + b]
        if split[k] is None:
            split[k], rank[k] = (i, j), r
        joins[i * Merges.SPAN + j] = k
    return Merges(split, joins, rank), text, {t: i for i, t in enumerate(text) if t}


def from_pieces(pieces: list[str], scores: list[float]) -> Merges:
    """A vocabulary in which any two neighbours merge whose concatenation is a piece, the best score first.

    "" stands for ids that are no text. The last id + 1 is an atom for characters outside the vocabulary.
    """
    ids = {p: i for i, p in enumerate(pieces) if p}
    split: list = [None] * (len(pieces) + 1)
    made = Merges(split, {}, [-1] * (len(pieces) + 1))
    place = {i: k for k, i in enumerate(sorted(ids.values(), key=lambda i: (-scores[i], i)))}
    parts = {}
    for p, i in ids.items():
        ways = [(ids[p[:k]], ids[p[k:]]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        parts[i] = ways
        for a, b in ways:
            made.joins[a * Merges.SPAN + b] = i
        if len(p) > 1:
            made.rank[i] = place[i]
    reached = {i for p, i in ids.items() if len(p) == 1}
    for i in sorted(parts, key=place.get):  # what a piece is merged from comes before it
        for a, b in parts[i]:
            if a in reached and b in reached and made._decide(a, b, (made.rank[i], False)):
                split[i] = (a, b)
                reached.add(i)
                break
    made.reached = reached
    return made
