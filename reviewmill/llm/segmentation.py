"""SentencePiece encoding with several sampled segmentations of a text, and decoding.

A text's segmentations are the paths of a lattice of vocabulary pieces. A piece weighs 1 / (rank + 1)
(Zipf's law over the model's merge ranks, as the public model has no probabilities), to the power
``SHARPNESS``; characters without a piece are spelled in byte pieces. Paths are drawn without
replacement by Gumbel top-k, as an A* search: the best path of a region of the lattice takes the
region's Gumbel number, what is left of the region falls into one region per step of that path, the
paths that leave it there, and each of them gets its own number, bounded by the one just taken. The
next path is in the region of the largest number. Random numbers follow from the row's key, the
path's number and the place in the text, so the result doesn't depend on how rows are batched.

A path's inclusion score is 1 - exp(-exp(log_prob - threshold)), its probability of being among the
drawn given the threshold, the largest number not drawn.

No piece has a blank behind another character or a line break, so lattices are built per stretch of
blanks and the characters after it, once for each distinct stretch of a block. A task keeps those it
meets first, up to ``KEPT`` nodes, for its later blocks.

Encoding puts a blank before the text, as the model does; decoding takes it off, and gives back the
text exactly. Defined cases: a null or empty text has one segmentation, without pieces; a text with
fewer than k segmentations gives all it has; a null key counts as 0; repeated rows give equal
results; of regions with equal numbers (ties) the earlier path's earlier step is taken; a text longer than
a block is a block of its own, drawn whole; empty tables give empty results; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.words import blocks, give_back, mix, offsets

SHARPNESS = 0.5
SEED = 1
BLOCK = 1 << 19
# Nodes of lattices, about 110 bytes each, that a task keeps from block to block.
KEPT = 3 << 18
# Blocks after which freed memory goes back to the system; doing so after each cost a fifth of the time.
RETURNED = 16
STRETCH = re.compile(r" *[^ \n]+| +|\n")
# Fixed values of the model format: the visible blank, and the first byte piece's id.
BLANK = 0x2581
FIRST_BYTE = 3
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 20
# Log mass of regions that can't hold the next path but with a probability far below rounding errors.
FAINT = -100.0


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * BASE) >> np.uint64(64 - TABLE_BITS)


class Vocabulary:
    """Pieces of a SentencePiece model: ids by character sequence, weights, and bytes to decode to."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i)]
        spelled = {i for i in range(size) if model.is_byte(i)}
        pieces = [model.id_to_piece(i) for i in range(size)]
        if any(chr(BLANK) in p.lstrip(chr(BLANK)) or "\n" in p for p in pieces):
            raise ValueError("a piece spans stretches")
        whole = [i for i in range(size) if i not in spelled and i not in special]
        self.longest = max(len(pieces[i]) for i in whole)
        self.bytes = [bytes([i - FIRST_BYTE]) if i in spelled else pieces[i].replace(chr(BLANK), " ").encode() for i in range(size)]
        self.spelling = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = np.fromiter(map(len, self.bytes), np.int64, size)
        # Pieces made of other pieces by hand carry no rank; they count as the least frequent.
        rank = np.array([-model.get_score(i) for i in range(size)])
        rank = np.where((rank < 0) | (rank > size), size, rank)
        self.weight = -SHARPNESS * np.log(rank + 1)
        self.byte_weight = -SHARPNESS * float(np.log(size + 1))
        keys, prefixes = [], set()
        for i in whole:
            h = 0
            for c in map(ord, pieces[i]):
                h = (h * int(BASE) + c + 1) & (1 << 64) - 1
                prefixes.add(h)
            keys.append(h)
        order = np.argsort(np.array(keys, np.uint64))
        self.keys = np.array(keys, np.uint64)[order]
        self.ids = np.array(whole, np.int64)[order]
        # By a hash's slot: -1 where no piece begins so, else where its key may be among the keys, or -2
        # for mere beginnings; another hash may have the slot.
        self.where = np.full(1 << TABLE_BITS, -1, np.int16 if len(keys) < 1 << 15 else np.int32)
        self.where[_slots(np.array(sorted(prefixes), np.uint64))] = -2
        self.where[_slots(self.keys)] = np.arange(len(self.keys))

    @classmethod
    def of(cls, parts: dict) -> Vocabulary:
        """The vocabulary with the attributes given, which travel to workers without this class."""
        own = cls.__new__(cls)
        own.__dict__.update(parts)
        return own

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of many pieces, one after the other."""
        length = self.length[ids]
        begin = offsets(self.length)[ids]
        return self.spelling[np.repeat(begin - offsets(length)[:-1], length) + np.arange(length.sum())]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[1:]


class _Index(dict):
    """Numbers stretches in the order in which they are met."""

    def __missing__(self, stretch: str) -> int:
        value = self[stretch] = len(self)
        return value


class Lattices:
    """The lattices of distinct stretches, laid end to end: one node per character and one per end."""

    def __init__(self, stretches: list[str], vocabulary: Vocabulary) -> None:
        joined = "".join(stretches)
        self.code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        self.start = offsets(lengths)[:-1]
        self.end = self.start + lengths
        # A row has a power of two of places, of which those behind the longest piece stay empty.
        size, width = len(self.code), 1 << (vocabulary.longest - 1).bit_length()
        left = np.repeat(self.end, lengths) - np.arange(size)
        symbols = np.where(self.code == ord(" "), BLANK, np.where(self.code == BLANK, 0x110000, self.code))
        symbols = (symbols + 1).astype(np.uint64)
        self.id = np.full((size, width), -1, np.int16 if len(vocabulary.bytes) < 1 << 15 else np.int32)
        at, h, rest = np.arange(size), np.zeros(size, np.uint64), left
        for n in range(1, vocabulary.longest + 1):
            h = h * BASE + symbols.take(at + (n - 1))
            found = vocabulary.where.take(_slots(h))
            maybe = np.flatnonzero(found >= 0)
            key, wanted = found.take(maybe), h.take(maybe)
            miss = np.flatnonzero(vocabulary.keys.take(key) != wanted)
            key[miss] = np.minimum(np.searchsorted(vocabulary.keys, wanted[miss]), len(vocabulary.keys) - 1)
            hit = vocabulary.keys.take(key) == wanted
            self.id.ravel()[at.take(maybe[hit]) * width + (n - 1)] = vocabulary.ids.take(key[hit])
            more = np.flatnonzero((found != -1) & (rest > n))
            at, h, rest = at.take(more), h.take(more), rest.take(more)
        self.bytes = (1 + (self.code >= 0x80) + (self.code >= 0x800) + (self.code >= 0x10000)).astype(np.int8)
        self.vocabulary = vocabulary
        # Log mass of all paths from a node to its stretch's end, the nodes nearest to an end first.
        self.mass = np.zeros(size + 1)
        self.cumulative = np.zeros((size, width), np.float32)
        self.longest = np.ones(size, np.int16)
        if not size:
            return
        order = np.argsort(left.astype(np.int16) if left.max() < 1 << 15 else left, kind="stable")
        held = self.id >= 0
        held[:, 0] = True
        cell = np.flatnonzero(held.take(order, axis=0))
        at, column = cell >> width.bit_length() - 1, cell & width - 1
        edges = offsets(np.bincount(at, minlength=size))
        at = order.take(at)
        cell = at * width + column
        piece = self.id.ravel().take(cell)
        weight = vocabulary.weight.take(piece, mode="wrap")
        spelled = np.flatnonzero(piece < 0)
        weight[spelled] = self.bytes[at[spelled]] * vocabulary.byte_weight
        weight = weight.astype(np.float32).astype(float)
        # No mass is left behind the last node, nor behind a stretch's end.
        onward = np.where(column + 1 == left.take(at), size, at + column + 1)
        share = np.empty(len(at))
        bounds = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if low == high:
                continue
            first, last = edges[low], edges[high]
            starts = edges[low:high] - first
            terms = weight[first:last] + self.mass.take(onward[first:last])
            count = np.diff(edges[low : high + 1])
            top = np.maximum.reduceat(terms, starts)
            odds = np.exp(terms - np.repeat(top, count))
            total = np.add.reduceat(odds, starts)
            self.mass[order[low:high]] = top + np.log(total)
            share[first:last] = odds / np.repeat(total, count)
        self.cumulative.ravel()[cell] = share
        np.cumsum(self.cumulative, axis=1, out=self.cumulative)
        self.longest[order] = column[edges[1:] - 1] + 1

    def log_share(self, node: np.ndarray, step: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability of taking the piece of ``step`` characters at a node."""
        after = node + step
        onward = self.mass.take(after)
        onward[after == end] = 0.0
        piece = self.pieces(node, step)
        weight = self.vocabulary.weight.take(piece, mode="wrap")
        spelled = np.flatnonzero(piece < 0)
        weight[spelled] = self.bytes[node[spelled]] * self.vocabulary.byte_weight
        return np.minimum(weight.astype(np.float32) + onward - self.mass.take(node), 0.0)

    def pieces(self, node: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The piece of ``step`` characters at a node, -1 for a character to spell."""
        return self.id.ravel().take(node * self.id.shape[1] + (step - 1))

    def steps(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The piece lengths that numbers ``u`` between 0 and 1 draw at nodes."""
        # Cumulative shares never fall along a row: halving finds how many of them a number isn't below.
        width = self.cumulative.shape[1]
        shares, at = self.cumulative.ravel(), node * width
        first, half = at - 1, width >> 1
        while half:
            at += half * (shares.take(at + (half - 1)) <= u)
            half >>= 1
        # Shares add up to 1 but for rounding; a number above all of them takes the longest piece.
        step = at - first
        last = np.flatnonzero(step == width)
        over = last[shares[at[last]] <= u[last]]
        step[over] = self.longest[node[over]]
        return step


class KeptLattices(Lattices):
    """Lattices of the stretches numbered in ``index``, built as they come; the first ones are kept."""

    COLUMNS = ("code", "id", "bytes", "mass", "cumulative", "longest")

    def __init__(self, vocabulary: Vocabulary, most: int | None = None) -> None:
        super().__init__([], vocabulary)
        self.most = KEPT if most is None else most
        self.index = _Index()
        self.nodes = 0

    def extend(self) -> None:
        """Build the lattices of the stretches that the index has numbered since the last call."""
        part = Lattices(list(islice(self.index, len(self.start), None)), self.vocabulary)
        first, self.nodes = self.nodes, self.nodes + len(part.code)
        self.start = np.concatenate([self.start, part.start + first])
        self.end = np.concatenate([self.end, part.end + first])
        for name in self.COLUMNS:
            column, new = getattr(self, name), getattr(part, name)
            if len(column) <= self.nodes:
                room = np.zeros((max(self.nodes + 1, len(column) * 3 // 2), *column.shape[1:]), column.dtype)
                room[:first] = column[:first]
                setattr(self, name, room)
            getattr(self, name)[first : first + len(new)] = new

    def trim(self) -> None:
        """Forget the stretches behind the first ``most`` nodes."""
        if self.nodes <= self.most:
            return
        kept = int(np.searchsorted(self.end, self.most, side="right"))
        for stretch in list(islice(self.index, kept, None)):
            del self.index[stretch]
        self.start, self.end = self.start[:kept].copy(), self.end[:kept].copy()
        self.nodes = int(self.end[-1]) if kept else 0
        if len(self.code) > 2 * self.most:
            for name in self.COLUMNS:
                setattr(self, name, getattr(self, name)[: self.nodes + 1].copy())


def _uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((mix(seed + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)) + 0.5) * 2.0**-53


class _Paths:
    """One path per text: nodes, steps and log shares in text order, and the steps' region numbers."""

    def __init__(self, node, step, share, place, text, n_texts):
        self.node, self.step, self.share, self.place, self.text = node, step, share, place, text
        self.ends = np.searchsorted(text, np.arange(n_texts + 1))
        before = np.concatenate([[0.0], np.cumsum(share)])[:-1]
        first = np.minimum(self.ends[:-1], max(len(share) - 1, 0))
        self.before = before - before[first][text] if len(share) else before
        self.number = np.full(len(share), -np.inf)

    def scatter(self, bound: np.ndarray, seed: np.ndarray, since: np.ndarray) -> None:
        """Give the regions of steps from place ``since`` on their numbers, at most ``bound`` of their text."""
        at = np.flatnonzero((self.before > FAINT) & (self.place >= since[self.text]) & (self.share < 0))
        text = self.text[at]
        rest = self.before[at] + np.log(-np.expm1(self.share[at]))
        uniform = _uniform(seed[text] ^ np.uint64(0x5851F42D4C957F2D), self.place[at])
        self.number[at] = _truncated(rest, bound[text], uniform)


def _truncated(location: np.ndarray, bound: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """A Gumbel number at a location, given that it is at most ``bound``."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        value = location - np.log(np.exp(location - bound) - np.log(uniform))
    return np.where(np.isneginf(location), -np.inf, np.minimum(value, bound))


def draw(
    texts: list[str], keys: np.ndarray, vocabulary: Vocabulary, k: int, seed: int = SEED, lattices: KeptLattices | None = None
) -> list[list[tuple]]:
    """For each text its drawn segmentations, in order: (ids, log_prob, inclusion).

    ``lattices`` of texts drawn before are used, and extended by those of the other stretches.
    """
    lattices = KeptLattices(vocabulary) if lattices is None else lattices
    index = lattices.index
    found, counts = [], []
    for text in texts:
        own = STRETCH.findall(" " + text) if text else []
        counts.append(len(own))
        found += own
    n = len(texts)
    unit = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
    del found
    text_of = np.repeat(np.arange(n), counts)
    lattices.extend()
    length = (lattices.end - lattices.start)[unit] if len(unit) else unit
    ends = offsets(np.array(counts, np.int64))
    total = np.concatenate([[0], np.cumsum(length)])
    begin = total[:-1] - total[ends[:-1]][text_of] if len(unit) else unit
    base = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed))
    seeds = [mix(base + np.uint64((j + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)) for j in range(k + 1)]

    def walk(units: np.ndarray, node: np.ndarray, seed_of: np.ndarray):
        """Free draws from a node of each stretch to its end: node, step, share, place, stretch, in order."""
        turns, steps = [], np.zeros(len(units), np.int64)
        at, own = np.arange(len(units)), unit[units]
        stop = ends_of = lattices.end[own]
        shift = shifts = begin[units] - lattices.start[own]
        while len(at):
            step = lattices.steps(node, _uniform(seed_of, shift + node).astype(np.float32))
            turns.append((at, node, step))
            steps[at] += 1
            node = node + step
            on = np.flatnonzero(node < stop)
            at, node, seed_of, stop, shift = (a.take(on) for a in (at, node, seed_of, stop, shift))
        slots = offsets(steps)
        nodes, lengths = np.empty(slots[-1], np.int64), np.empty(slots[-1], np.int64)
        for i, (at, node, step) in enumerate(turns):
            slot = slots.take(at) + i
            nodes[slot], lengths[slot] = node, step
        share = lattices.log_share(nodes, lengths, np.repeat(ends_of, steps))
        return nodes, lengths, share, nodes + np.repeat(shifts, steps), np.repeat(units, steps)

    def whole(parts):
        node, step, share, place, units = parts
        return _Paths(node, step, share, place, text_of[units], n)

    every = np.arange(len(unit))
    paths = [whole(walk(every, lattices.start[unit] if len(unit) else unit, seeds[0][text_of]))]
    numbers = [-np.log(-np.log(_uniform(base, np.zeros(n))))]
    paths[0].scatter(numbers[0], seeds[0], np.zeros(n, np.int64))
    alive = [np.ones(n, bool)]
    bends: list[tuple[np.ndarray, ...]] = []
    threshold = np.full(n, -np.inf)
    for turn in range(1, k + 1):
        best, where, which = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j, path in enumerate(paths):
            if not len(path.number):
                continue
            has = np.flatnonzero(path.ends[1:] > path.ends[:-1])
            tops = np.maximum.reduceat(path.number, path.ends[:-1][has])
            better = has[tops > best[has]]
            best[has] = np.maximum(best[has], tops)
            which[better] = j
        for j, path in enumerate(paths):
            wanted = np.where((which == j) & (best > -np.inf), best, np.nan)
            at = np.flatnonzero(path.number == np.repeat(wanted, np.diff(path.ends)))
            of, first = np.unique(path.text[at], return_index=True)
            where[of] = at[first]
        open_ = best > -np.inf
        if turn == k:
            threshold = best
            break
        alive.append(open_)
        numbers.append(best)
        paths.append(_branch(paths, which, where, open_, best, seeds[turn], bends, lattices, unit, text_of, begin, ends, walk, n))
    out: list[list[tuple]] = [[] for _ in range(n)]
    for j, path in enumerate(paths):
        sums = np.bincount(path.text, weights=path.share, minlength=n)
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(np.minimum(sums - threshold, 700)))
        ids, id_ends = _ids(path, lattices)
        for i in np.flatnonzero(alive[j]):
            out[i].append((ids[id_ends[i] : id_ends[i + 1]], float(sums[i]), float(inclusion[i])))
    return out


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers low, low + 1, ... of each range, one range after the other."""
    return np.repeat(low - offsets(count)[:-1], count) + np.arange(count.sum())


def _branch(paths, which, where, open_, best, seeds, bends, lattices, unit, text_of, begin, ends, walk, n) -> _Paths:
    """The next path of each open text: along an earlier one to a step, another piece there, then free.

    ``bends`` has a (path, step, piece length) of each text for every earlier branch, and gets this one's.
    """
    of = np.flatnonzero(open_)
    came, at = which[of], where[of]
    node, place, first = (np.empty(len(of), np.int64) for _ in range(3))
    before, row = np.empty(len(of)), np.empty((len(of), lattices.cumulative.shape[1]))
    for j, path in enumerate(paths):
        own = np.flatnonzero(came == j)
        t = at[own]
        node[own], place[own], before[own], first[own] = path.node[t], path.place[t], path.before[t], path.ends[of[own]]
        row[own] = np.diff(lattices.cumulative.take(path.node[t], axis=0).astype(float), prepend=0.0, axis=1)
        row[own, path.step[t] - 1] = 0
    for path, t, step in bends:
        again = np.flatnonzero((path[of] == came) & (t[of] == at))
        row[again, step[of[again]] - 1] = 0
    left = np.cumsum(row, axis=1)
    u = _uniform(seeds[of], place) * left[:, -1]
    step = np.sum(left <= u[:, None], axis=1) + 1
    unit_at = np.searchsorted(text_of << 40 | begin, of << 40 | place, side="right") - 1
    stop = lattices.end[unit[unit_at]]
    share = lattices.log_share(node, step, stop)
    rest = row.sum(axis=1) - row[np.arange(len(of)), step - 1]
    with np.errstate(divide="ignore"):
        location = np.where(rest > 1e-7, before + np.log(np.maximum(rest, 0.0)), -np.inf)
    number = _truncated(location, best[of], _uniform(seeds[of] ^ np.uint64(0x2545F4914F6CDD1D), place))
    for j, path in enumerate(paths):
        own = np.flatnonzero(came == j)
        path.number[at[own]] = number[own]
    since, bend = np.zeros(n, np.int64), np.zeros(n, np.int64)
    since[of], bend[of] = place + 1, step
    bends.append((np.where(open_, which, -1), where, bend))
    inside = node + step < stop
    low = unit_at + ~inside
    count = ends[of + 1] - low
    units = _ranges(low, count)
    nodes = lattices.start[unit[units]]
    nodes[offsets(count)[:-1][inside]] = (node + step)[inside]
    free = walk(units, nodes, seeds[text_of[units]])
    kept, walked = at - first, np.bincount(text_of[free[4]], minlength=n)[of]
    sizes = kept + 1 + walked
    begins = offsets(sizes)[:-1]
    columns = [np.empty(sizes.sum(), a.dtype) for a in free[:4]]
    for j, path in enumerate(paths):
        own = np.flatnonzero(came == j)
        source, slot = _ranges(first[own], kept[own]), _ranges(begins[own], kept[own])
        for column, values in zip(columns, (path.node, path.step, path.share, path.place), strict=True):
            column[slot] = values[source]
    slot = _ranges(begins + kept + 1, walked)
    for column, value, values in zip(columns, (node, step, share, place), free[:4], strict=True):
        column[begins + kept] = value
        column[slot] = values
    new = _Paths(*columns, np.repeat(of, sizes), n)
    new.scatter(best, seeds, since)
    return new


def _ids(path: _Paths, lattices: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and where each text's begin; spelled characters become byte pieces."""
    ids = lattices.pieces(path.node, path.step).astype(np.int32)
    spelled = ids < 0
    count = np.where(spelled, lattices.bytes[path.node], 1)
    out = np.repeat(ids, count)
    if spelled.any():
        text = "".join(map(chr, lattices.code[path.node[spelled]].tolist())).encode()
        out[out < 0] = np.frombuffer(text, np.uint8).astype(np.int32) + FIRST_BYTE
    ends = np.concatenate([[0], np.cumsum(count)])
    return out, ends[path.ends]


def _same(lists: list[np.ndarray], texts: list[bytes], vocabulary: Vocabulary) -> list[bool]:
    """Whether each list of pieces spells its text, after the blank put before it."""
    ids = np.concatenate([np.zeros(0, np.int32), *lists])
    ends = offsets(vocabulary.length[ids])[offsets(np.fromiter(map(len, lists), np.int64, len(lists)))]
    spelled = vocabulary.spell(ids).tobytes()
    return [
        spelled[low:high] == (b" " + text if text else b"") for low, high, text in zip(ends[:-1], ends[1:], texts, strict=True)
    ]


def encode(
    docs: DataFrame,
    model_path: str,
    k: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    kept: int = KEPT,
    returned: int = RETURNED,
) -> DataFrame:
    """One row per text and segmentation: doc_id, rank, n_pieces, log_prob, inclusion, ids, round_trip.

    Fewer nodes ``kept`` and fewer blocks before freed memory is ``returned`` take less memory and more
    time; the rows are the same.
    """
    if k < 1:
        raise ValueError("at least one segmentation")
    sent = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        vocabulary = Vocabulary.of(sent.value)
        lattices, done = KeptLattices(vocabulary, kept), 0
        for batch in batches:
            keys = batch.column("doc_id").fill_null(0).to_numpy()
            for start, end, values in blocks(batch, limit=BLOCK):
                texts = [(v or b"").decode() for v in values]
                drawn = draw(texts, keys[start:end], vocabulary, k, seed, lattices)
                lattices.trim()
                flat = [(start + i, r + 1, *d) for i, own in enumerate(drawn) for r, d in enumerate(own)]
                lists = [f[2] for f in flat]
                ends = offsets(np.fromiter(map(len, lists), np.int64, len(lists))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))
                same = _same(lists, [values[f[0] - start] or b"" for f in flat], vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([f[0] for f in flat], pa.int64())),
                        pa.array([f[1] for f in flat], pa.int32()),
                        pa.array([len(x) for x in lists], pa.int64()),
                        pa.array([f[3] for f in flat], pa.float64()),
                        pa.array([f[4] for f in flat], pa.float64()),
                        ids,
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "rank", "n_pieces", "log_prob", "inclusion", "ids", "round_trip"],
                )
                del texts, drawn, flat, lists, ids
                done += 1
                if done % returned == 0:
                    give_back()
        del lattices
        give_back()

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    columns = "doc_id bigint, rank int, n_pieces bigint, log_prob double, inclusion double, ids array<int>, round_trip boolean"
    return source.mapInArrow(run, columns)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows given, with ``decoded``: the text whose segmentation the ids are."""
    sent = encoded.sparkSession.sparkContext.broadcast(vars(Vocabulary(model_path)))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        vocabulary = Vocabulary.of(sent.value)
        return ids.map(lambda x: None if x is None else vocabulary.decode(list(x)))

    return encoded.withColumn("decoded", text(F.col(ids_col)))
