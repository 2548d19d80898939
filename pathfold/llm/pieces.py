"""The piece table of a SentencePiece model file, loaded once in each Python worker."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pathfold.llm.batches import mix, span_hashes

SPACE = "▁"  # the mark that stands for a space


class Pieces:
    """Normal pieces with ids and scores, and the byte pieces for characters without a piece.

    Only models that keep the text as it is but for the space mark and a leading space are
    supported, which is checked on a probe text.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.names = names
        self.byte_ids = [-1] * 256
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[name] = i
                self.scores[name] = model.get_score(i)
        probe = "  A ﬁ é　\t."
        if min(self.byte_ids) < 0 or model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model must keep texts unchanged, add a leading space and have byte pieces")
        long = [x for x in self.ids if len(x) > 1]
        if any(SPACE in x.lstrip(SPACE) for x in long):
            raise ValueError("a piece holds a space mark after another character")
        # No piece mixes letters with other characters (but for its space mark) or holds a newline
        # among others, so texts fall apart there. Both are checked, not assumed.
        pairs = {(a, b) for x in long for a, b in zip(x.lstrip(SPACE), x.lstrip(SPACE)[1:])}
        # Numerals such as a superscript two are word characters of the pattern, but no letters.
        odd = re.escape("".join(sorted({c for p in pairs for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()})))
        letter = re.compile(rf"[^\W\d_{odd}]")
        self.letters_alone = not any(bool(letter.match(a)) != bool(letter.match(b)) for a, b in pairs)
        self.newline_alone = not any("\n" in x for x in long)
        self.longest = max(map(len, self.ids))
        self.lowest = min(self.scores.values())
        byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else b"" for i in range(n)]
        for name, i in self.ids.items():
            self.raw[i] = name.replace(SPACE, " ").encode()
        self.raw_bytes = np.frombuffer(b"".join(self.raw) + b" ", np.uint8)
        self.raw_size = np.array([len(x) for x in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        # Score of each piece, None for what only begins one.
        self.begins: dict[str, float | None] = {x[:k]: None for x in self.ids for k in range(1, len(x))}
        self.begins.update(self.scores)
        # 0: space mark, 1: letter, 2: other, 3: newline; without a border between 1 and 2 all are 2.
        self._letter = letter
        self._kinds: np.ndarray | None = None

    def kinds(self) -> np.ndarray:
        """The kind of each code point."""
        if self._kinds is None:
            every = "".join(map(chr, range(0x110000)))
            kinds = np.full(0x110000, 2, np.uint8)
            if self.letters_alone:
                kinds[[m.start() for m in self._letter.finditer(every)]] = 1
            kinds[ord(SPACE)] = 0
            if self.newline_alone:
                kinds[10] = 3
            self._kinds = kinds
        return self._kinds


class Segments:
    """The marked texts of a block cut into segments, parts that no piece crosses.

    A segment is a run of space marks with the letters, or the other characters, that follow; or
    such a run without marks; or a newline. ``distinct`` holds the different ones, ``index`` the
    number of each segment among them, ``first`` where each text's segments begin.
    """

    def __init__(self, texts: pa.Array, pieces: Pieces):
        marked = [SPACE + x.replace(" ", SPACE) if x else "" for x in texts.to_pylist()]
        joined = "".join(marked)
        offsets = np.zeros(len(marked) + 1, np.int64)
        np.cumsum([len(x) for x in marked], out=offsets[1:])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = pieces.kinds()[points]
        start = np.zeros(len(points) + 1, bool)
        if len(points):
            before, now = kind[:-1], kind[1:]
            start[1:-1] = ((now != before) & ((before != 0) | (now == 3))) | (now == 3)
        start[offsets] = True
        borders = np.flatnonzero(start)
        starts, ends = borders[:-1], borders[1:]
        hashes = span_hashes(points, point_codes, starts, ends)
        _, example, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        self.distinct = [joined[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist())]
        self.first = np.searchsorted(starts, offsets)


def point_codes(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)
