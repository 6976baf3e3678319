"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct units (a run of word marks with what follows it) are joined
to one text. Its suffixes are sorted, every piece of the vocabulary is found by
binary search as a range of suffixes, and the ranges give all edges (start,
piece). The edges are sorted by the place in the unit where they end and then
relaxed: an edge is taken if its start has been reached by a piece with which
it may stand side by side, which is so if merging the two pieces' characters by
the model's scores gives those two pieces again. Each place is reached by one
edge at most, and going back from the end gives the segmentation that the
model's own merging gives for the unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from .common import append_columns, pieces_of

MARK = "▁"
#: The rank of what is no piece.
NEVER = (float("inf"), 0)
#: Characters of text that are encoded together, and of new units that are indexed together: an index
#: takes some hundred times as many bytes. A longer unit is indexed and relaxed in windows of so many bytes.
BATCH_CHARS, INDEXED_CHARS, WINDOW = 1_000_000, 200_000, 1 << 15
#: Units whose ids a worker remembers, in each of two generations, before the older one goes; longer ones are forgotten.
REMEMBERED_UNITS, REMEMBERED_CHARS = 150_000, 256
#: Pairs of pieces whose verdict a worker remembers, as a power of 2.
PAIR_BITS = 20


class PieceModel:
    """The pieces of a SentencePiece BPE model with byte fallback, and the codec."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes_at = model.piece_to_id("<0x00>")
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if not all(model.is_byte(self.bytes_at + b) for b in range(256)):
            raise ValueError("the model must have byte fallback")
        self.texts: dict[int, str] = {i: model.id_to_piece(i) for i in normal}
        self.ids = {p: i for i, p in self.texts.items()}
        self.rank = {p: (-model.get_score(i), i) for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes beyond a word mark, so words can't be encoded one by one")
        self.unknown = model.get_piece_size()
        # What each id stands for; control pieces for nothing.
        self.raw = [b""] * self.unknown
        for i, p in self.texts.items():
            self.raw[i] = p.encode()
        for b in range(256):
            self.raw[self.bytes_at + b] = bytes([b])
        # No piece has a line end in it: then a unit may end there, too.
        stop = "" if any("\n" in p for p in self.ids) else "\n"
        self.stops = bool(stop)
        self.unit = re.compile(f"{stop}|{MARK}+[^{MARK}{stop}]*|[^{MARK}{stop}]+" if stop else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._index_pieces()
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        self.pair_memo: dict[tuple[int, int], bool] = {}

    # -- the vocabulary, ready for searching ---------------------------------

    def _index_pieces(self) -> None:
        # A piece that its own characters don't merge to never comes out of merging.
        reached = [(p.encode(), i) for p, i in self.ids.items() if len(self.merge(p)) == 1]
        self.piece_ids = np.array([i for _, i in reached], np.int64)
        self.piece_len = np.array([len(p) for p, _ in reached], np.int64)
        self.width = -(-int(self.piece_len.max()) // 8)
        padded = np.frombuffer(b"".join(p.ljust(8 * self.width, b"\0") for p, _ in reached), ">u8").reshape(-1, self.width).astype(np.uint64)
        ends = np.frombuffer(b"".join(p.ljust(8 * self.width, b"\xff") for p, _ in reached), ">u8").reshape(-1, self.width).astype(np.uint64)
        self.low, self.high = padded, ends
        self.long = np.flatnonzero(self.piece_len > 8)
        self.long_heads = np.unique(padded[self.long, 0])
        self.size_of = np.zeros(self.unknown + 1, np.int64)
        self.size_of[self.piece_ids] = self.piece_len

    def merge(self, text: str) -> list[str]:
        """``text`` merged from characters, best score first and leftmost of equals."""
        parts, rank = list(text), self.rank.get
        while len(parts) > 1:
            ranks = list(map(rank, map(str.__add__, parts, parts[1:]), repeat(NEVER)))
            best = min(ranks)
            if best is NEVER:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pieces of each pair stay apart when merged together."""
        codes = left * (self.unknown + 1) + right
        at = (codes * 0x1E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF) >> (63 - PAIR_BITS)
        missing = np.unique(codes[self.pair_keys[at] != codes])
        verdict: dict[int, bool] = {}
        for code in missing.tolist():
            a, b = divmod(code, self.unknown + 1)
            verdict[code] = a == self.unknown or b == self.unknown or self.merge(self.texts[a] + self.texts[b]) == [self.texts[a], self.texts[b]]
        out = self.pair_fits[at]
        if verdict:
            new = self.pair_keys[at] != codes
            out[new] = [verdict[c] for c in codes[new].tolist()]
            where = (missing * 0x1E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF) >> (63 - PAIR_BITS)
            self.pair_keys[where] = missing
            # Two missing codes may share a place; the one that is left there says what holds.
            self.pair_fits[where] = [verdict[c] for c in self.pair_keys[where].tolist()]
        return out

    # -- matching ------------------------------------------------------------

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of a piece in ``text`` (bytes; 0xff parts units)."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(8 * self.width, np.uint8)])
        heads = np.zeros(n + 8 * (self.width - 1), np.uint64)
        for k in range(8):
            heads = (heads << np.uint64(8)) | padded[k : k + len(heads)]
        order = np.argsort(heads[:n])
        first = heads[order]
        # Suffixes that only differ after 8 bytes are sorted further where a longer piece begins like them.
        if len(self.long_heads):
            lo, hi = np.searchsorted(first, self.long_heads, "left"), np.searchsorted(first, self.long_heads, "right")
            some = hi > lo
            if some.any():
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo[some], hi[some])])
                suffixes = order[at]
                order[at] = suffixes[np.lexsort([heads[suffixes + 8 * k] for k in range(self.width - 1, -1, -1)])]
        lo, hi = np.searchsorted(first, self.low[:, 0], "left"), np.searchsorted(first, self.high[:, 0], "right")
        some = self.long[hi[self.long] > lo[self.long]]
        if len(some):
            lo[some], hi[some] = self._narrow(heads, order, some, lo[some], hi[some])
        count = np.maximum(hi - lo, 0)
        total = int(count.sum())
        offsets = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return order[np.repeat(lo, count) + offsets], np.repeat(self.piece_ids, count)

    def _narrow(self, heads: np.ndarray, order: np.ndarray, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of pieces of over 8 bytes between ``lo`` and ``hi``."""

        def bound(keys: np.ndarray, right: bool) -> np.ndarray:
            a, b = lo.copy(), hi.copy()
            while (a < b).any():
                mid = np.minimum((a + b) >> 1, len(order) - 1)
                less = np.zeros(len(which), bool)
                equal = np.ones(len(which), bool)
                for k in range(self.width):
                    seen = heads[order[mid] + 8 * k]
                    less |= equal & (seen < keys[:, k])
                    equal &= seen == keys[:, k]
                go = (less | equal if right else less) & (a < b)
                stay = ~go & (a < b)
                a[go], b[stay] = mid[go] + 1, mid[stay]
            return a

        return bound(self.low[which], False), bound(self.high[which], True)

    def _all_edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every edge in ``text``; a character that is no piece is an edge of its own kind."""
        at, piece = self._edges(text)
        is_start = (text & 0xC0 != 0x80) & (text != 0xFF)
        chars = np.flatnonzero(is_start)
        # A character goes on to the next byte that doesn't continue it.
        ends = np.append(np.flatnonzero(text & 0xC0 != 0x80), len(text))
        width_at = np.zeros(len(text), np.int64)
        width_at[chars] = ends[np.searchsorted(ends, chars) + 1] - chars
        single = np.zeros(len(text), bool)
        single[at[self.size_of[piece] == width_at[at]]] = True
        lone = chars[~single[chars]]
        start = np.concatenate([at, lone])
        end = np.concatenate([at + self.size_of[piece], lone + width_at[lone]])
        return start, end, np.concatenate([piece, np.full(len(lone), self.unknown)])

    def _segment_long(self, unit: str) -> bytes:
        """The ids of one long unit, as the bytes of int32.

        Its text is indexed window by window, each with as many bytes more as a
        piece may go beyond it. What is kept of a window is the edge that reaches
        each place, 8 bytes for each byte of the unit.
        """
        raw = np.frombuffer(unit.encode(), np.uint8)
        n, over = len(raw), max(8 * self.width, 4)
        last, came = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        last[0] = -2
        for a in range(0, n, WINDOW):
            start, end, piece = self._all_edges(raw[a : min(n, a + WINDOW + over)])
            mine = (start < WINDOW) & (end + a <= n)
            start, end, piece = start[mine], end[mine], piece[mine]
            order = np.argsort(end, kind="stable")
            here = last[a : a + WINDOW + over].tolist()
            here += [-1] * (WINDOW + over + 1 - len(here))
            fits = self.pair_memo
            for s, e, p in zip(start[order].tolist(), end[order].tolist(), piece[order].tolist()):
                before = here[s]
                if before == -1:
                    continue
                if before >= 0:
                    if (before, p) not in fits:
                        if len(fits) >= 1 << PAIR_BITS:
                            fits.clear()
                        fits[before, p] = before == self.unknown or p == self.unknown or self.merge(self.texts[before] + self.texts[p]) == [self.texts[before], self.texts[p]]
                    if not fits[before, p]:
                        continue
                here[e] = p
                came[a + e] = a + s
            stop = min(n + 1, a + WINDOW + over)
            last[a:stop] = here[: stop - a]
        pieces, cuts, at = [], [], n
        while at:
            pieces.append(int(last[at]))
            at = int(came[at])
            cuts.append(at)
        if -1 in pieces:
            raise RuntimeError("a unit has no segmentation")
        ids: list[int] = []
        for p, a, b in zip(reversed(pieces), reversed(cuts), [*reversed(cuts[:-1]), n]):
            ids.extend((self.bytes_at + raw[a:b].astype(np.int32)).tolist() if p == self.unknown else [p])
        return np.array(ids, np.int32).tobytes()

    def _segment(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as the bytes of int32."""
        raw = [u.encode() for u in units]
        text = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes + 1) - sizes - 1
        start, end, piece = self._all_edges(text)
        unit_start = np.repeat(starts, sizes + 1)
        offset = end - unit_start[start]
        order = np.argsort(offset, kind="stable")
        start, end, piece, offset = start[order], end[order], piece[order], offset[order]
        last = np.full(len(text) + 1, -1, np.int64)
        last[starts] = -2
        came = np.zeros(len(text) + 1, np.int64)
        cuts = np.flatnonzero(np.diff(offset)) + 1
        for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(offset)]]).tolist()):
            before = last[start[a:b]]
            some = np.flatnonzero(before != -1)
            before = before[some]
            good = np.ones(len(some), bool)
            inner = before >= 0
            if inner.any():
                good[inner] = self._fit(before[inner], piece[a:b][some][inner])
            taken = some[good] + a
            last[end[taken]] = piece[taken]
            came[end[taken]] = start[taken]
        return self._walk_back(raw, starts, sizes, last, came)

    def _walk_back(self, raw, starts, sizes, last, came) -> list[bytes]:
        """All units go back from their ends together, a piece at each step."""
        at, steps = starts + sizes, []
        live = np.flatnonzero(sizes > 0)
        while len(live):
            piece, before = last[at[live]], came[at[live]]
            if (piece < 0).any():
                raise RuntimeError("a unit has no segmentation")
            steps.append((live, piece, before, at[live]))
            at[live] = before
            live = live[before > starts[live]]
        units = np.concatenate([s[0] for s in steps]) if steps else np.zeros(0, np.int64)
        pieces = np.concatenate([s[1] for s in steps]) if steps else np.zeros(0, np.int64)
        back = np.concatenate([np.full(len(s[0]), -k) for k, s in enumerate(steps)]) if steps else np.zeros(0, np.int64)
        begin = np.concatenate([s[2] for s in steps]) if steps else np.zeros(0, np.int64)
        end = np.concatenate([s[3] for s in steps]) if steps else np.zeros(0, np.int64)
        order = np.lexsort((back, units))
        units, pieces, begin, end = units[order], pieces[order], begin[order], end[order]
        flat = pieces.astype(np.int32).tobytes()
        bounds = (np.searchsorted(units, np.arange(len(raw) + 1)) * 4).tolist()
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        for u in np.unique(units[pieces == self.unknown]).tolist():
            ids: list[int] = []
            s = int(starts[u])
            for k in range(bounds[u] // 4, bounds[u + 1] // 4):
                if pieces[k] == self.unknown:
                    ids.extend(self.bytes_at + b for b in raw[u][int(begin[k]) - s : int(end[k]) - s])
                else:
                    ids.append(int(pieces[k]))
            out[u] = np.array(ids, np.int32).tobytes()
        return out

    # -- texts ---------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        """What merging never goes across, and empty strings. Joined, they are the text with marks for spaces."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return self.unit.findall(MARK + text.replace(" ", MARK))
        # Without runs of marks each mark begins a unit: this is quicker than the expression.
        spaced = MARK + text.replace(" ", " " + MARK)
        return (spaced.replace("\n", " \n ") if self.stops else spaced).split(" ")

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text, as int32 arrays."""
        split = [self.units(t) for t in texts]
        if len(self.memory) > REMEMBERED_UNITS:
            # What is used again comes over from the older generation.
            self.memory, self.older = {}, self.memory
        known, older = self.memory, self.older
        known[""] = b""
        asked = set().union(*split).difference(known)
        known.update((u, older[u]) for u in asked if u in older)
        missing = [u for u in asked if u not in older]
        for a, b in pieces_of(missing, INDEXED_CHARS):
            if b == a + 1 and len(missing[a]) > WINDOW:
                known[missing[a]] = self._segment_long(missing[a])
            else:
                known.update(zip(missing[a:b], self._segment(missing[a:b])))
        out = [np.frombuffer(b"".join(map(known.__getitem__, us)), np.int32) for us in split]
        for u in missing:
            if len(u) > REMEMBERED_CHARS:
                del known[u]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``: marks become spaces, the first one goes, bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    """The model of a worker, read once."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, model_path: str, *, carry: list[str] | None = None, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Adds ``piece_ids`` (array of int) to ``docs``.

    A null or empty text has no ids, equal texts have equal ones, and an empty
    table gives an empty one. ``model_path`` must be there on every executor.
    Texts are taken in groups of ``batch_chars``, a longer text is a group of its
    own; what is indexed at once is bounded by bytes, even within one unit. An
    input column ``piece_ids``, without regard to case, is left out.
    """

    def make():
        import pyarrow as pa

        model = model_at(model_path)

        def encode(texts):
            texts = [t or "" for t in texts.to_pylist()]
            ids = [x for a, b in pieces_of(texts, batch_chars) for x in model.encode(texts[a:b])]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else [], pa.int32()))]

        return encode

    return append_columns(docs, "piece_ids array<int>", make, carry=carry)


def decode_pieces(encoded: DataFrame, model_path: str, *, carry: list[str] | None = None) -> DataFrame:
    """Adds ``decoded`` (string) from ``piece_ids``; null ids give an empty text.

    It is the encoded text again, but that a word mark in it has become a space.
    An empty table gives an empty one; an input column ``decoded`` is left out.
    """

    def make():
        model = model_at(model_path)
        return lambda ids: [[model.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in ids]]

    return append_columns(encoded, "decoded string", make, uses=("piece_ids",), carry=carry)


def piece_digests(docs: DataFrame, model_path: str, *, carry: list[str] | None = None, batch_chars: int = BATCH_CHARS, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each text; adds ``n_pieces, ids_crc32, decoded_chars, decoded_crc32, round_trip``.

    ``ids_crc32`` is of the ids as little-endian int32. ``round_trip`` says that
    the decoded text is the text again, where a word mark counts as a space.
    ``with_ids`` adds ``piece_ids`` (array of int) in front of them. Nulls, empty
    and long texts, equal rows, empty tables and clashing names are as in
    :func:`encode_pieces`: a null text has no pieces, decodes to an empty text
    and is its round trip.
    """

    def make():
        from zlib import crc32

        import pyarrow as pa

        model = model_at(model_path)

        def digest(texts):
            out, held = [], []
            texts = [t or "" for t in texts.to_pylist()]
            for a, b in pieces_of(texts, batch_chars):
                for text, ids in zip(texts[a:b], model.encode(texts[a:b])):
                    if with_ids:
                        held.append(ids)
                    back = model.decode(ids.tolist())
                    out.append((len(ids), crc32(ids.astype("<i4").tobytes()), len(back), crc32(back.encode()), back == text.replace(MARK, " ")))
            made = [list(c) for c in zip(*out)]
            if not with_ids:
                return made
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held), pa.int32())), *made]

        return digest

    return append_columns(docs, ("piece_ids array<int>, " if with_ids else "") + "n_pieces long, ids_crc32 long, decoded_chars long, decoded_crc32 long, round_trip boolean", make, carry=carry)
