"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut into words where no piece can reach over; each distinct word is encoded once. Words of equal length advance
together: at every end position the substrings of all words and all piece lengths are probed in the sorted table of piece keys, one
vectorised maximum picks the best last piece, and its length is the back pointer.

The maximum is taken over what the model defines as best:

* unigram models: the sum of the pieces' scores;
* BPE models: a path is admissible when merging would never cross the border between its neighbouring pieces, and just one
  admissible last piece exists at each position. Admissibility of all candidate pairs is decided together, by undoing merges on
  both sides of the border (``Pieces.separable``). The result is the merge order's own segmentation, not an approximation.

Models must use identity normalisation. Characters outside the vocabulary become byte pieces if the model has them, else the unknown
id, one for each run. Decoding gives the text back, but for U+2581 in it, which stands for a blank.

Defined results: null text is empty, an empty text has no ids. Rows that repeat are encoded each. An empty table gives an empty
result. Only the named columns are read. A text of any length is cut at blanks and between characters that no piece has
side by side, so work grows with its length; a single unbroken word costs one array step for each of its characters.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.text import Chunk, RangeKeys, chunks, mix
from shelfgraph.llm.word_cache import WordCache, per_row

BLANK = "▁"
CHUNK = 1 << 21    # bytes of text encoded together
LONG = 48          # words of more characters are cut between characters that no piece has side by side
MEMORY = 1 << 20   # slots for decided pairs of pieces
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
_BLANK_BYTES = BLANK.encode()
_U = np.uint64
_BASE = _U(0xA24BAED4963EE407)
_DOWN = _U(pow(0xA24BAED4963EE407, -1, 1 << 64))


def _fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a protocol buffer message."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, kind, raw[at:at + n]
            at += n


class Model:
    """Pieces, scores, kinds and settings of a model file."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.algorithm, self.dummy_prefix = UNIGRAM, True
        for number, _, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, _, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                self.algorithm = next((v for k, _, v in _fields(value) if k == 3), UNIGRAM)
            elif number == 3:
                spec = {k: v for k, _, v in _fields(value)}
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models with identity normalisation that keep all blanks are supported")
                self.dummy_prefix = bool(spec.get(3, 1))
        if self.algorithm not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("only unigram and BPE models without user-defined symbols are supported")
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("pieces that go over a blank are not supported")


def _code_keys(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a rows x length array of code points, from which ``_sub`` takes substring keys."""
    n, width = codes.shape
    up = np.full(width + 1, _BASE, _U)
    up[0] = 1
    sums = np.zeros((n, width + 1), _U)
    np.cumsum(mix(codes.astype(_U) + _U(1)) * np.cumprod(up)[:width], axis=1, out=sums[:, 1:])
    return sums


def _downs(width: int) -> np.ndarray:
    down = np.full(width + 1, _DOWN, _U)
    down[0] = 1
    return np.cumprod(down)


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(keys.shape, -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class PieceKeys:
    """Sorted keys that are found by their leading 20 bits: one look at the first key with these bits, and at the few after it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, _U(0))
        lead = (keys >> _U(44)).astype(np.int64)
        self.first = np.full(1 << 20, len(keys), np.int32)
        self.first[lead[::-1]] = np.arange(len(keys) - 1, -1, -1)
        self.most = int(np.unique(lead, return_counts=True)[1].max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where absent."""
        out = np.full(len(keys), -1)
        at = self.first[(keys >> _U(44)).astype(np.int64)]
        open_ = np.flatnonzero(at < len(self.keys) - 1)
        at, wanted = at[open_], keys[open_]
        for _ in range(self.most):
            hit = self.keys[at] == wanted
            out[open_[hit]] = at[hit]
            rest = ~hit & (self.keys[at] < wanted) & (at < len(self.keys) - 2)
            if not rest.any():
                break
            open_, at, wanted = open_[rest], at[rest] + 1, wanted[rest]
        return out


class Pieces:
    """Lookup tables of a model, plain arrays that travel with a task."""

    def __init__(self, model: Model):
        self.algorithm, self.dummy_prefix = model.algorithm, model.dummy_prefix
        texts = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL and p}
        self.unknown = model.kinds.index(UNKNOWN) if UNKNOWN in model.kinds else 0
        self.bytes = np.array([next((i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE and p == f"<0x{b:02X}>"), -1)
                               for b in range(256)]) if BYTE in model.kinds else None
        by_length: dict[int, list[str]] = {}
        for p in texts:
            by_length.setdefault(len(p), []).append(p)
        self.longest = max(by_length, default=1)
        keys, ids = [], []
        for n, pieces in by_length.items():
            codes = np.array([[ord(c) for c in p] for p in pieces])
            keys.append(mix(_code_keys(codes)[:, n] + _U(n)))
            ids.append(np.array([texts[p] for p in pieces]))
        keys, ids = np.concatenate([*keys, np.zeros(0, _U)]), np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.table = PieceKeys(self.keys)
        self.scores = np.array(model.scores, np.float32)
        self.outside = np.float32(min((model.scores[i] for i in texts.values()), default=0.0) - 10)
        #: Pairs of ASCII characters (a blank stands for U+2581) that stand side by side in some piece; texts can be cut between others.
        self.beside = np.ones((256, 256), bool)
        self.beside[:128, :128] = False
        for p in texts:
            for a, b in zip(p.replace(BLANK, " "), p.replace(BLANK, " ")[1:]):
                if max(a, b) < "\x80":
                    self.beside[ord(a), ord(b)] = True
        self.beside[32, 32] = True
        if self.bytes is None:  # a run of unknown characters is one id
            self.beside[:] = True
        #: The same for all characters, as sorted pairs of code points; a blank may stand beside anything.
        self.beside_pairs = np.unique(np.array([ord(a) << 21 | ord(b) for p in texts for a, b in zip(p, p[1:])], np.int64))
        self.decoded = [self._surface(p, k) for p, k in zip(model.pieces, model.kinds, strict=True)]
        if self.algorithm == BPE:
            self._merges(texts, model)

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace(BLANK, " ").encode())

    def _merges(self, texts: dict[str, int], model: Model) -> None:
        """Ranks, the last merge inside each piece, and which pairs of pieces merge into a third."""
        self.blanks = {len(p): i for p, i in texts.items() if set(p) == {BLANK}}
        wide = sorted((i for p, i in texts.items() if len(p) > 1 and p.lstrip(BLANK)), key=lambda i: (-model.scores[i], i))
        n = len(model.pieces)
        self.rank = np.full(n + 1, -1)
        self.rank[wide] = np.arange(len(wide))
        self.left, self.right = np.full(n + 1, -1), np.full(n + 1, -1)
        self.whole = np.ones(n + 1, bool)
        pairs: dict[int, int] = {}
        for i in wide:
            piece = model.pieces[i]
            for k in range(1, len(piece)):
                a, b = texts.get(piece[:k]), texts.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = self.rank[i]
        pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ranks = pair_keys, np.array([pairs[k] for k in pair_keys.tolist()], np.int64)
        for i in wide:
            parts = [texts.get(c, -1) for c in model.pieces[i]]
            while len(parts) > 1:
                ranks = [pairs.get(a * n + b, n) if a >= 0 <= b else n for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best == n:
                    break
                k = ranks.index(best)
                self.left[wide[best]], self.right[wide[best]] = (parts[k], parts[k + 1]) if wide[best] == i else (self.left[wide[best]], self.right[wide[best]])
                parts[k:k + 2] = [wide[best]]
            self.whole[i] = parts == [i]

    def separable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``decided`` for pairs that were not met before; a memory of fixed size keeps what was found out."""
        pair = a * len(self.rank) + b
        slot = (mix(pair.astype(_U)) >> _U(44)).astype(np.int64)
        if not hasattr(self, "memory"):
            self.memory, self.answers = np.full(MEMORY, -(1 << 62)), np.zeros(MEMORY, bool)
        out = self.answers[slot]
        new = np.flatnonzero(self.memory[slot] != pair)
        if len(new):
            _, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            fine = self.decided(a[new[first]], b[new[first]])
            out[new] = fine[back]
            self.memory[slot[new[first]]], self.answers[slot[new[first]]] = pair[new[first]], fine
        return out

    def decided(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of piece a followed by those of b ends in just (a, b); -1 is an unknown character.

        Both pieces are taken apart from the border outwards, the later merge first. A pair of parts that could merge across the
        border before either is used up inside its own piece rules the pair out (on equal ranks the left one comes first).
        """
        n = len(self.rank) - 1
        fine = (a < 0) | (b < 0)
        open_ = np.flatnonzero(~fine)
        x, y = a[open_], b[open_]
        most_x = np.full(len(open_), n + 1)
        most_y = most_x.copy()
        while len(open_):
            at = _lookup(self.pair_keys, x * n + y)
            rank = np.where(at >= 0, self.pair_ranks[at], n + 2)
            go = ~((rank < most_x) & (rank <= most_y))
            open_, x, y, most_x, most_y = (v[go] for v in (open_, x, y, most_x, most_y))
            rx, ry = self.rank[x], self.rank[y]
            done = (rx < 0) & (ry < 0)
            fine[open_[done]] = True
            open_, x, y, most_x, most_y, rx, ry = (v[~done] for v in (open_, x, y, most_x, most_y, rx, ry))
            undo_x = rx > ry
            most_x, most_y = np.where(undo_x, rx, most_x), np.where(undo_x, most_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return fine

    def _probe(self, sums: np.ndarray, downs: np.ndarray, end: int, size: int) -> np.ndarray:
        """Ids of the substrings that end at ``end``, -1 if no piece."""
        at = self.table.find(mix((sums[:, end] - sums[:, end - size]) * downs[end - size] + _U(size)))
        return np.where(at >= 0, self.ids[at], -1)

    def _advance(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last piece and its length at each end position of words of one length: rows x (length + 1)."""
        n, width = codes.shape
        sums, downs = _code_keys(codes), _downs(width)
        last, back = np.full((n, width + 1), -1), np.ones((n, width + 1), np.int64)
        best = np.zeros((n, width + 1), np.float32)
        rows = np.arange(n)
        for end in range(1, width + 1):
            sizes = np.arange(min(end, self.longest), 0, -1)
            found = np.stack([self._probe(sums, downs, end, int(s)) for s in sizes], axis=1)
            if self.algorithm == UNIGRAM:
                value = np.where(found >= 0, self.scores[found], np.float32(-np.inf))
                value[:, -1] = np.where(found[:, -1] >= 0, value[:, -1], self.outside)
                value = value + best[:, end - sizes]
            else:
                value = np.full(found.shape, -1.0)
                known = (found >= 0) & self.whole[found]
                row, col = np.nonzero(known)
                start = end - sizes[col]
                ok = start == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.separable(last[row[inner], start[inner]], found[row[inner], col[inner]])
                value[row[ok], col[ok]] = 1.0
                value[:, -1] = np.where(found[:, -1] < 0, 0.0, value[:, -1])
            pick = value.argmax(axis=1)
            last[:, end], back[:, end], best[:, end] = found[rows, pick], sizes[pick], value[rows, pick]
        return last, back

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and each word's number of ids. Back pointers of a group are followed together."""
        lengths = np.array([len(w) for w in words], np.int64)
        ids, chars, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in np.unique(lengths[lengths > 0]).tolist():
            group = np.flatnonzero(lengths == width)
            step = max(1, 400_000 // width)
            for part in (group[k:k + step] for k in range(0, len(group), step)):
                codes = np.frombuffer("".join([words[k] for k in part.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(part), width)
                last, back = self._advance(codes)
                rows, at = np.arange(len(part)), np.full(len(part), width)
                steps = []
                while len(rows):
                    size = back[rows, at]
                    steps.append((rows, last[rows, at], codes[rows, at - size]))
                    at = at - size
                    rows, at = rows[at > 0], at[at > 0]
                for rows, piece, char in reversed(steps):
                    owner.append(part[rows])
                    ids.append(piece)
                    chars.append(char.astype(np.int64))
        ids, chars, owner = (np.concatenate(x) for x in (ids, chars, owner))
        order = np.argsort(owner, kind="stable")
        ids, chars, owner = ids[order], chars[order], owner[order]
        strange = np.flatnonzero(ids < 0)
        if len(strange):
            if self.bytes is None:  # one unknown id for each run
                again = strange[(strange > 0) & (ids[strange - 1] < 0) & (owner[strange - 1] == owner[strange])]
                ids[strange] = self.unknown
                ids, owner = np.delete(ids, again), np.delete(owner, again)
            else:
                raw = [chr(c).encode() for c in chars[strange].tolist()]
                size = np.ones(len(ids), np.int64)
                size[strange] = [len(r) for r in raw]
                ids, owner, spots = np.repeat(ids, size), np.repeat(owner, size), np.repeat(ids < 0, size)
                ids[spots] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, np.bincount(owner, minlength=len(words))

    def _blank_run(self, n: int) -> list[int]:
        """Ids of n blanks under BPE, whose merges rank alike: the leftmost pair that makes a piece goes first."""
        sizes, now, left = [], 1, n - 1
        while n:
            if sizes and sizes[-1] + now in self.blanks:
                now += sizes.pop()
            elif left and now + 1 in self.blanks:
                now, left = now + 1, left - 1
            else:
                sizes.append(now)
                if not left:
                    break
                now, left = 1, left - 1
        return [self.blanks.get(size, -1) for size in sizes]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as ``parts`` cuts them (blanks written as U+2581), and each word's number of ids."""
        if self.algorithm == UNIGRAM:
            return self._solve(words)
        heads = np.array([len(w) - len(w.lstrip(BLANK)) for w in words], np.int64)
        whole = np.array([len(w) for w in words], np.int64)
        cut = np.where(heads == whole, whole, np.maximum(heads - 1, 0)).tolist()
        ids, sizes = self._solve([w[c:] if c else w for w, c in zip(words, cut, strict=True)])
        runs = np.flatnonzero(np.array(cut, np.int64))
        if not len(runs):
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k in runs.tolist():
            alone = len(parts[k]) > 0 and parts[k][0] == self.blanks.get(1)
            blanks = self._blank_run(int(cut[k]) + bool(alone))
            parts[k] = np.concatenate([np.array(blanks, np.int64), parts[k][int(alone):]])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def parts(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin: at a row's start, at a run of blanks, and between ASCII characters that no piece has side by side."""
        data = chunk.data
        first = np.zeros(len(data) + 1, bool)
        first[chunk.offsets[:-1]] = True
        blank = data == 32
        if len(data) > 1:
            first[1:-1] |= blank[1:] & ~blank[:-1]
            first[1:-1] |= ~self.beside[data[:-1], data[1:]]
            if _BLANK_BYTES in data.tobytes():  # U+2581 is a blank too: a run that mixes both stays whole
                e = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) + 3
                e = e[e < len(data)]
                e = e[~np.isin(e, chunk.offsets) & blank[e]]
                first[e] = False
        start = np.flatnonzero(first[:-1])
        return start, np.append(start[1:], len(data)) if len(start) else start


class PieceEncoder:
    """Encoder of whole chunks with a bounded cache of words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.cache = WordCache(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words may hold U+2581 inside; they are cut there, and long ones between characters that no piece has side by side."""
        if not any(len(w) > LONG or BLANK in w.lstrip(BLANK) for w in words):
            return self.pieces.encode_words(words)
        cut = [[x for p in self._join([BLANK + p if k else p for k, p in enumerate(w.split(BLANK))]) for x in self._apart(p)] for w in words]
        ids, sizes = self.pieces.encode_words([p for parts in cut for p in parts])
        return ids, per_row(sizes, np.cumsum([0, *(len(c) for c in cut)]))

    def _apart(self, word: str) -> list[str]:
        if len(word) <= LONG or self.pieces.bytes is None:
            return [word]
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = codes[:-1] << 21 | codes[1:]
        known = self.pieces.beside_pairs
        at = np.minimum(np.searchsorted(known, pairs), len(known) - 1) if len(known) else np.zeros(len(pairs), np.int64)
        joined = (known[at] == pairs) if len(known) else np.zeros(len(pairs), bool)
        joined |= codes[:-1] == ord(BLANK)
        cuts = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _join(parts: list[str]) -> list[str]:
        """Runs of blanks go with the word after them."""
        out, run = [], ""
        for p in parts:
            if p == BLANK:
                run += p
            elif p:
                out.append(run + p)
                run = ""
        return out + [run] if run else out

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's texts, and how many each has."""
        if not len(chunk.data):
            return np.zeros(0, np.int64), np.zeros(chunk.n, np.int64)
        start, end = self.pieces.parts(chunk)
        leading = np.zeros(len(chunk.data) + 1, bool)
        if self.pieces.dummy_prefix:
            leading[chunk.offsets[:-1]] = True
        leading = leading[start]
        keys = RangeKeys(chunk.data)(start, end)
        keys = np.where(leading, mix(keys ^ _U(0x5851F42D4C957F2D)), keys)
        raw = chunk.data.tobytes()

        def text_of(places: np.ndarray) -> list[str]:
            return [(BLANK if leading[k] else "") + raw[start[k]:end[k]].decode().replace(" ", BLANK) for k in places.tolist()]

        ids, sizes = self.cache.encode(keys, text_of)
        return ids, per_row(sizes, np.searchsorted(start, chunk.offsets))


class PieceDecoder:
    """Bytes of id sequences by one gather from the table of all pieces' bytes."""

    def __init__(self, pieces: Pieces):
        self.table = np.frombuffer(b"".join(pieces.decoded), np.uint8)
        self.starts = np.cumsum([0, *(len(p) for p in pieces.decoded)])
        self.dummy_prefix = pieces.dummy_prefix

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of sequences that lie one after another."""
        size = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(size)
        raw = self.table[np.repeat(self.starts[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *sizes.tolist()])].tolist()
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(cuts, cuts[1:])]
        return [t.removeprefix(" ") for t in texts] if self.dummy_prefix else texts


_workers: dict[int, tuple[PieceEncoder, PieceDecoder]] = {}


def _worker(pieces: Pieces) -> tuple[PieceEncoder, PieceDecoder]:
    """One encoder for each worker process and vocabulary: its cache outlives a task."""
    key = zlib.crc32(pieces.keys.tobytes()) + (pieces.algorithm << 40)
    if key not in _workers:
        _workers.clear()
        _workers[key] = PieceEncoder(pieces), PieceDecoder(pieces)
    return _workers[key]


def load(path: str) -> Pieces:
    """Tables of a model file that the driver can open; tasks get the tables."""
    with open(path, "rb") as file:
        return Pieces(Model(file.read()))


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of each document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _worker(pieces)
        for batch in batches:
            for chunk in chunks(batch.column(1), CHUNK):
                ids, sizes = encoder.encode(chunk)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column(0).slice(chunk.first, chunk.n), lists], ["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """(id, n_ids, text) of rows with an ``ids`` array; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _worker(pieces)
        for batch in batches:
            lists = batch.column(1)
            for first in range(0, batch.num_rows, 256):
                part = lists.slice(first, 256)
                sizes = np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
                texts = decoder.decode(np.asarray(part.flatten(), np.int64), sizes)
                yield pa.record_batch([batch.column(0).slice(first, 256), pa.array(sizes), pa.array(texts, pa.string())], ["id", "n_ids", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, n_ids long, text string")


def round_trip(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_ids, ids_crc32, n_chars_back, restored [, ids]): encode and decode in one pass over the texts, and compare.

    ``restored`` allows for the one thing decoding cannot tell: U+2581 in a text comes back as a blank.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker(pieces)
        for batch in batches:
            for chunk in chunks(batch.column(1), CHUNK):
                ids, sizes = encoder.encode(chunk)
                texts = decoder.decode(ids, sizes)
                raw, at = chunk.data.tobytes(), chunk.offsets.tolist()
                cuts = np.cumsum([0, *sizes.tolist()]).tolist()
                wide = ids.astype("<u4")
                yield pa.record_batch([
                    batch.column(0).slice(chunk.first, chunk.n), pa.array(sizes.astype(np.int64)),
                    pa.array([zlib.crc32(wide[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([t.encode() == raw[a:b].replace(_BLANK_BYTES, b" ") for t, a, b in zip(texts, at, at[1:])]),
                    *([pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))] if with_ids else []),
                ], ["id", "n_ids", "ids_crc32", "n_chars_back", "restored", *(["ids"] if with_ids else [])])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, n_chars_back long, restored boolean" + ", ids array<int>" * with_ids)
