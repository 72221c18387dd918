"""Encoding with a SentencePiece BPE vocabulary as a path of compatible pieces.

A sequence of pieces is the BPE encoding of its text if and only if every two
neighbours are the encoding of their own concatenation. So encoding is a
max-plus problem over positions: a step from one piece to the next scores 0 if
the two are compatible and minus infinity otherwise, and the best path, the only
finite one, is the encoding. Every prefix has one last piece, so a position
needs one survivor.

Between a character other than the space mark and a space mark no piece
continues, so any pair there is compatible: such places are *safe*, and what
lies between two of them can be encoded by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracework.llm.intmap import IntMap

SPACE = "▁"
#: Words (of each of two generations) and pairs of pieces that a process remembers.
_CACHE, _PAIRS = 120_000, 400_000
#: Words up to ``_WIDE`` characters are encoded side by side, some ``_BLOCK`` characters at a time.
_WIDE, _BLOCK = 64, 100_000
#: Characters, or ids, of whole texts that are worked on at a time (one text may have more).
_AT_ONCE = 1_000_000


class Pieces:
    """The pieces of a model by id, read from the bytes of its file: what decoding needs."""

    def __init__(self, model: bytes):
        self._read(model)

    def _read(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte, self.id, self.score, self.raw = {}, {}, {}, []
        self._raw: pa.Array | None = None
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.encode())
                self.id[piece] = i
                self.score[piece] = sp.get_score(i)
        return sp

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces and bytes joined, space marks as spaces, without the leading one."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """``decode`` for many rows; a null list, or one with a null id, gives null."""
        start, stop = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
        if self._raw is None:
            self._raw = pa.array(self.raw, pa.large_binary())
        pieces = self._raw.take(ids.values.slice(start, stop - start))
        rows = pa.ListArray.from_arrays(pc.subtract(ids.offsets, start), pieces, mask=ids.is_null())
        joined = pc.binary_join(rows, pa.scalar(b"", pa.large_binary()))
        try:
            text = joined.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8 in some row
            text = pa.array([None if r is None else r.decode("utf-8", "replace") for r in joined.to_pylist()], pa.large_string())
        text = pc.replace_substring(text, SPACE, " ")
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text).cast(pa.string())

    def decode_parts(self, ids: pa.ListArray) -> Iterator[tuple[int, pa.Array]]:
        """``decode_all`` of neighbouring rows with a bounded number of ids together: (rows, texts)."""
        offsets, start = ids.offsets.to_numpy(), 0
        while start < len(ids):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _AT_ONCE, "right")) - 1)
            stop = min(stop, len(ids))
            yield stop - start, self.decode_all(ids.slice(start, stop - start))
            start = stop


class Vocabulary(Pieces):
    """Pieces, scores and ids of a model, with all that encoding needs.

    Asks for what the encoder relies on and raises ValueError otherwise: the
    identity normaliser with a leading space mark, byte fallback, and no piece
    that goes on after a space mark following another character.
    """

    def __init__(self, model: bytes):
        sp = self._read(model)
        probe = "  a B\n\tﬁ  "
        if len(self.byte) != 256 or sp.normalize(probe) != normalise(probe):
            raise ValueError("a model with byte fallback and the identity normaliser is needed")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("a piece continues after a space mark")
        self.longest = max(map(len, self.id))
        tail: dict[str, set[int]] = {}  # lengths of pieces by their last four characters
        for p in self.id:
            tail.setdefault(p[-4:], set()).add(len(p))
        self.tail = {t: tuple(sorted(n, reverse=True)) + (3, 2, 1) for t, n in tail.items() if len(t) == 4}
        inside = {a + b for p in self.id for a, b in zip(p, p[1:])}
        self.hard = "" if any("\n" in p for p in self.id) else "\n"
        # Marks that no piece has after a letter: a place before one of them is safe after any letter.
        self.marks = "".join(m for m in ".,;:!?" if not any(x[1] == m and x[0].isalpha() for x in inside))
        ends = "".join(map(re.escape, self.hard + self.marks)) + SPACE
        self.words = re.compile(rf"{SPACE}*[^\W\d_]+(?=[{ends}]|$)|\n+|{SPACE}*[^{SPACE}{self.hard}]+|{SPACE}+" if self.hard else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        if not {c for p in self.id for c in p} <= self.id.keys() or len(self.raw) > 1 << 20:
            raise ValueError("a character occurs in pieces only, or there are too many pieces")
        self._piece = [r.decode("utf-8", "replace") for r in self.raw]
        self._pair: dict[int, bool] = {}  # by the two ids; 0 stands for a start or a character that is no piece
        self._merges: dict[int, tuple] = {}  # one entry a piece at most
        self._word: dict[str, bytes] = {}  # words met lately
        self._older: dict[str, bytes] = {}  # those met before them
        self._known: IntMap | None = None

    def _tables(self) -> None:
        """Arrays for encoding words side by side: classes of characters, a trie of the pieces, known pairs."""
        chars = sorted({c for p in self.id for c in p})
        self._class = np.zeros(0x110000, np.int32)  # 0: a character that is no piece
        self._class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self._size = np.ones(len(self.raw), np.int64)
        number = {c: i for i, c in enumerate(chars, 1)}
        steps: dict[int, int] = {}
        piece_at = [0]
        for p, i in self.id.items():
            node = 0
            for c in p:
                key = node << 20 | number[c]
                node = steps.get(key) or steps.setdefault(key, len(piece_at))
                if node == len(piece_at):
                    piece_at.append(0)
            piece_at[node] = i
            self._size[i] = len(p)
        self._step, self._piece_at = IntMap(len(steps)), np.array(piece_at, np.int32)
        self._step.put(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32))
        self._known = IntMap(_PAIRS)  # pair of ids -> 1 if they do not fit, 2 if they do

    def merges(self, i: int) -> tuple[list[tuple[float, str, str]], bool]:
        """The steps that make a piece of its characters, best pair first, and whether they end in one piece.

        Each step is the score of its merge and the first and the last part before it.
        """
        found = self._merges.get(i)
        if found is None:
            parts, steps = list(self._piece[i]), []
            while len(parts) > 1:
                scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
                best = max(scores)
                if best == -np.inf:
                    break
                steps.append((best, parts[0], parts[-1]))
                k = scores.index(best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            one = len(parts) == 1
            steps.append((-np.inf, parts[0], parts[-1]))
            found = self._merges[i] = steps, one
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of two pieces never joins a part of one to a part of the other.

        Until that happens both go through their own steps, the better of the next two first.
        """
        (left, whole), (right, whole_too) = self.merges(a), self.merges(b)
        if not (whole and whole_too):
            return False
        i = j = 0
        score = self.score
        while True:
            (x, _, end), (y, start, _) = left[i], right[j]
            cross = score.get(end + start)
            if cross is not None and cross > x and cross >= y:  # of equal scores the leftmost pair goes first
                return False
            if x == y == -np.inf:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def compatible(self, a: str, b: str) -> bool:
        """Whether a then b is the encoding of the two together; a may be empty for a start.

        No piece goes over a character that is none itself, so such a one fits with any.
        """
        return b not in self.id or self.fits(self.id.get(a, 0), self.id[b])

    def fits(self, a: int, b: int) -> bool:
        """The same for ids of pieces; 0 for a start."""
        key = a << 20 | b
        found = self._pair.get(key)
        if found is None:
            if len(self._pair) > _PAIRS:
                self._pair.clear()
            found = self._pair[key] = self._judge(a, b)
        return found

    def _judge(self, a: int, b: int) -> bool:
        return self._apart(a, b) if a else self.merges(b)[1]

    def forward(self, text: str, start: int, stop: int, before: str) -> dict[int, int]:
        """Survivors ``end -> start`` of the last piece, for ends up to ``stop``, after the piece ``before``."""
        last: dict[int, int] = {}
        names = {start: before}
        known, longest = self.id, self.longest
        for end in range(start + 1, stop + 1):
            for s in range(max(start, end - longest), end):
                if s in names:
                    piece = text[s:end]
                    if (piece in known or end - s == 1) and self.compatible(names[s], piece):
                        last[end] = s
                        names[end] = piece
                        break
        return last

    def word(self, text: str) -> list[int]:
        """Ids of a text between safe places."""
        return self.encode_all([text])[0].tolist()

    def learn(self, words: list[str]) -> None:
        """Encode new words and remember them."""
        if self._known is None:
            self._tables()
        wide, narrow, size = [], [], 0
        for text in words:
            if len(text) > _WIDE:
                narrow.append(text)
                continue
            wide.append(text)
            size += len(text)
            if size > _BLOCK:
                narrow += self._side_by_side(wide)
                wide, size = [], 0
        narrow += self._side_by_side(wide)
        for text in narrow:
            self._word[text] = self._one(text)

    def _side_by_side(self, words: list[str]) -> list[str]:
        """Encode words together, one position of all of them after another.

        Returns those with a character that is no piece, which are not encoded.
        """
        if not words:
            return []
        words = sorted(words, key=len, reverse=True)  # those that reach a position come first
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = self._class[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        matches = self._matches(chars, np.repeat(starts + lengths, lengths))
        last = np.zeros(len(chars), np.int64)  # last piece of a word's characters up to a position
        reach = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # words longer than k
        for k in range(lengths[0]):
            open_ = starts[: reach[k]] + k
            for size in range(min(k + 1, self.longest), 0, -1):
                piece = matches[size - 1][open_]
                some = np.flatnonzero(piece)
                if not len(some):
                    continue
                ends, piece = open_[some], piece[some].astype(np.int64)
                before = last[ends - size] if size <= k else np.zeros(len(ends), np.int64)
                fit = self._fit(before << 20 | piece)
                last[ends[fit]] = piece[fit]
                if len(some) == len(open_) and fit.all():
                    break
                left = np.ones(len(open_), bool)
                left[some[fit]] = False
                open_ = open_[left]
        final = np.zeros(len(chars), bool)  # where the pieces on the paths end
        at, start = starts + lengths - 1, starts
        while len(at):
            final[at] = True
            at = at - self._size[last[at]]
            more = at >= start
            at, start = at[more], start[more]
        counts = np.add.reduceat(final.astype(np.int64), starts)
        odd = np.add.reduceat((chars == 0).astype(np.int64), starts) > 0
        data = last[final].astype(np.int32).tobytes()
        stops = (4 * np.cumsum(counts)).tolist()
        left, begin = [], 0
        for text, stop, skip in zip(words, stops, odd.tolist()):
            if skip:
                left.append(text)
            else:
                self._word[text] = data[begin:stop]
            begin = stop
        return left

    def _matches(self, chars: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """``[n - 1, k]``: the piece of the ``n`` characters up to and including ``k``, or 0."""
        out = np.zeros((self.longest, len(chars)), np.int32)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for size in range(self.longest):
            node = self._step.get(node << 20 | chars[at]).astype(np.int64)
            more = np.flatnonzero(node)
            at, node = at[more], node[more]
            out[size, at] = self._piece_at[node]
            more = np.flatnonzero(at + 1 < stops[at])
            at, node = at[more] + 1, node[more]
        return out

    def _fit(self, keys: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs of ids."""
        found = self._known.get(keys)
        unknown = found == 0
        if unknown.any():
            new = np.unique(keys[unknown])
            if len(self._known) + len(new) > _PAIRS:
                self._known = IntMap(max(_PAIRS, len(new)))
            self._known.put(new, np.array([1 + self._judge(k >> 20, k & 0xFFFFF) for k in new.tolist()], np.int32))
            found[unknown] = self._known.get(keys[unknown])
        return found == 2

    def _one(self, text: str) -> bytes:
        """Encode one word by itself."""
        known, tail, pair = self.id, self.tail, self._pair
        # names[k] and sizes[k]: last piece of the first k characters, and its length; 0 for a character that is none
        short, names, sizes = (3, 2, 1), [0], [0]
        for end in range(1, len(text) + 1):
            for size in tail.get(text[end - 4 : end], short) if end > 3 else short:
                piece = known.get(text[end - size : end]) if size <= end else None
                if piece is not None:
                    before = names[end - size]
                    ok = pair.get(before << 20 | piece)
                    if ok or (ok is None and self.fits(before, piece)):
                        names.append(piece)
                        sizes.append(size)
                        break
            else:
                names.append(0)
                sizes.append(1)
        ids, end = [], len(text)
        while end:
            ids += [names[end]] if names[end] else [self.byte[b] for b in reversed(text[end - 1].encode())]
            end -= sizes[end]
        ids.reverse()
        return np.array(ids, np.int32).tobytes()

    def encode_all(self, normals: Iterable[str]) -> list[np.ndarray]:
        """Ids of whole normalised texts."""
        out, group, size = [], [], 0
        for text in normals:
            group.append(text)
            size += len(text)
            if size > _AT_ONCE:
                out += self._encode_group(group)
                group, size = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, normals: list[str]) -> list[np.ndarray]:
        split = [self.words.findall(n) for n in normals]
        if len(self._word) > _CACHE:  # what is not met again soon goes with the older words
            self._word, self._older = {}, self._word
        cache, older = self._word, self._older
        new = set().union(*split).difference(cache)
        kept = new.intersection(older)
        cache.update((w, older[w]) for w in kept)
        self.learn(list(new - kept))
        return [np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32) for words in split]

    def ids(self, text: str, spans: list[tuple[int, int]]) -> list[int]:
        """Ids of pieces; characters that are no piece become their bytes."""
        out = []
        for s, e in spans:
            i = self.id.get(text[s:e])
            out += [self.byte[b] for b in text[s:e].encode()] if i is None else [i]
        return out

    def encode(self, normal: str) -> np.ndarray:
        """Ids of one whole normalised text."""
        return self.encode_all([normal])[0]

    def safe(self, text: str, at: int) -> bool:
        """Whether no piece covers both sides of this place."""
        a, b = text[at - 1], text[at]
        return (
            (b == SPACE and a != SPACE)
            or (bool(self.hard) and (a == "\n" or b == "\n"))
            or (a.isalpha() and b in self.marks)
        )

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Pieces over the character before ``at``: (characters left of it, right of it)."""
        return [
            (a, b)
            for a in range(1, min(self.longest, at) + 1)
            for b in range(0, min(self.longest - a, len(text) - at) + 1)
            if text[at - a : at + b] in self.id or (a, b) == (1, 0)
        ]

    def transfer(self, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
        """Finite entries of a chunk's boundary-state matrix, as codes (entry, exit).

        The chunk is ``text[lo:hi]``, with some characters more on both sides. A
        state is the piece that covers the character before a boundary.
        """
        entries = self.states(text, lo) if lo else [(0, 0)]
        exits = self.states(text, hi) if hi < len(text) else [x for x in self.states(text, hi) if x[1] == 0]
        first, final = self._first(text, max(lo, 1), hi), self._final(text, max(lo, 1), hi)
        out = []
        if first is not None:
            heads = [e for e in entries if self._reaches(text, lo, e, first)]
            last = self.forward(text, final, hi, "")
            tails = [x for x in exits if self._ends(text, hi, x, last, final, "")]
            out = [(code(h), code(x)) for h in heads for x in tails]
        else:
            for e in entries:
                before = text[lo - e[0] : lo + e[1]]
                start = lo + e[1]
                if e[1] and start > hi - 1:
                    out += [(code(e), code(x)) for x in exits if hi - x[0] == lo - e[0] and hi + x[1] == start]
                    continue
                last = self.forward(text, start, hi, before)
                out += [(code(e), code(x)) for x in exits if self._ends(text, hi, x, last, start, before)]
        return out

    def path(self, text: str, lo: int, hi: int, entry: int, exit_: int) -> list[int]:
        """Ids of a chunk's pieces from after the entry piece to the exit piece, inclusive."""
        e, x = (entry >> 8, entry & 255), (exit_ >> 8, exit_ & 255)
        start = lo + e[1]
        s, end = hi - x[0], hi + x[1]
        if s < start:
            return []  # the entry piece is the exit piece
        out: list[int] = []
        first, final = self._first(text, max(start, 1), hi), self._final(text, max(start, 1), hi)
        before = text[lo - e[0] : start]
        if first is not None:
            if first > start:
                out += self.ids(text, back(self.forward(text, start, first, before), first, start))
            out += self.encode(text[first:final]).tolist()
            start, before = final, ""
        if s > start:
            out += self.ids(text, back(self.forward(text, start, s, before), s, start))
        return out + self.ids(text, [(s, end)])

    def _first(self, text: str, lo: int, hi: int) -> int | None:
        """The first safe place of a chunk."""
        return next((k for k in range(lo, hi) if self.safe(text, k)), None)

    def _final(self, text: str, lo: int, hi: int) -> int | None:
        """The last one."""
        return next((k for k in range(hi - 1, lo - 1, -1) if self.safe(text, k)), None)

    def _reaches(self, text: str, lo: int, entry: tuple[int, int], to: int) -> bool:
        start = lo + entry[1]
        if start >= to:
            return start == to
        return to in self.forward(text, start, to, text[lo - entry[0] : start])

    def _ends(self, text: str, hi: int, x: tuple[int, int], last: dict, start: int, before: str) -> bool:
        s, end = hi - x[0], hi + x[1]
        if s < start or (s > start and s not in last):
            return False
        piece = before if s == start else text[last[s] : s]
        return self.compatible(piece, text[s:end])


def normalise(text: str) -> str:
    """Space marks for spaces and one before the text; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def code(state: tuple[int, int]) -> int:
    """A state as one number; 0 stands for the start of a text."""
    return state[0] << 8 | state[1]


def back(last: dict[int, int], end: int, start: int) -> list[tuple[int, int]]:
    """Pieces (start, end) by following the survivors back."""
    out = []
    while end > start:
        out.append((last[end], end))
        end = last[end]
    return out[::-1]


def compose(relations: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Max-plus product of chunk matrices, by their finite entries."""
    out = relations[0]
    for nxt in relations[1:]:
        to: dict[int, list[int]] = {}
        for a, b in nxt:
            to.setdefault(a, []).append(b)
        out = sorted({(a, c) for a, b in out for c in to.get(b, ())})
    return out


def resolve(relations: list[list[tuple[int, int]]], entry: int, exit_: int) -> list[tuple[int, int]]:
    """Entry and exit of each matrix in a product with the given ends."""
    alive = [{entry}]
    for r in relations:
        alive.append({b for a, b in r if a in alive[-1]})
    at, out = exit_, []
    for k in range(len(relations) - 1, -1, -1):
        before = min(a for a, b in relations[k] if b == at and a in alive[k])
        out.append((before, at))
        at = before
    return out[::-1]
