"""Operator 7, SentencePiece encoding and decoding by weighted finite-state transducers.

A machine has states and arcs (input label, output label, weight, next state). These are compiled once per worker from the model file:

* the normaliser N rewrites characters and writes the word mark for the mark of a text's start;
* the lexicon L is the closure of a trie of the pieces: the arc of a piece's last character leads on into the trie, writing nothing, or
  back to the start, writing the piece at its cost;
* the byte fallback B, joined to L's start: a character that is no piece itself writes its UTF-8 bytes' ids at the unknown cost;
* of a BPE file also the pair acceptor P: a state for each last piece, with an arc for a next piece only if the two stay apart when
  their joined text is merged. Exactly one path is then left, the file's own encoding.

N is composed with the closure of L and B when they are compiled (:meth:`Lexicon.after`). :func:`shortest_path` composes an input, a linear
acceptor, with the result and that with P, all three at once: a state is a pair of a trie node and a state of P, its arcs are read from the
two machines when a label reaches it, and P's arcs are made when they are first read. The lattice is acyclic,
and its shortest path in the tropical semiring (sums along a path, the least over paths, of equal ones the one whose last piece starts
first) is the encoding. Only the states that the last character reached are held, so a text without any space needs memory for
its ids alone. A unigram file's costs are its negated scores, a BPE file's are 0; its P has one state that takes every piece.

A chunk without any path, which takes a BPE file whose pieces can't all be made by its own merges, is merged directly;
``Codec.merged_chunks`` counts them, and the tests find none with the public file. Chunks are words with the spaces before them, kept in a
bounded cache, because no arc of L crosses the start of a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .pieces import BPE, CACHE_WORDS, SPACE, UNK, PieceModel, read_model


#: What an arc that writes nothing writes; arcs that read nothing aren't needed.
EPSILON = None
#: The label of a text's start, which is no character.
START = "<s>"
#: Arcs of P that a worker keeps; beyond that it begins anew.
CACHE_ARCS = 2_000_000
#: Chunks that begin with the same so many characters share the states that these reach; what a worker keeps of them.
HEAD, CACHE_HEADS = 5, 50_000
#: A piece, UNK after a character without one; the ids it stands for; its cost.
Written = tuple[int, tuple[int, ...], float]


class Normaliser:
    """N: one state; a character without an arc of its own copies itself."""

    def __init__(self, model: PieceModel) -> None:
        self.table = {START: SPACE if model.prefix else EPSILON, " ": SPACE}


class Lexicon:
    """The closure of L and B. A state is a node of the trie: its arcs by label, as (next node, what is written by the arcs that lead
    back to ``start``). ``start`` is the root and the only final state."""

    def __init__(self, model: PieceModel) -> None:
        self.model, pairs = model, model.kind == BPE
        self.unknown = 0.0 if pairs else -model.unk_score
        self.start: dict[str, tuple[dict | None, tuple[Written, ...]]] = {}
        self.nodes = [self.start]
        for piece, i in model.id.items():
            node = self.start
            for char in piece[:-1]:
                child, written = node.get(char, (None, ()))
                if child is None:
                    child = {}
                    self.nodes.append(child)
                    node[char] = child, written
                node = child
            child, written = node.get(piece[-1], (None, ()))
            node[piece[-1]] = child, (*written, (i, (i,), 0.0 if pairs else -model.score[i]))
        for char, (child, written) in self.start.items():
            if char not in model.known:
                self.start[char] = child, written + self.fallback(char)

    def fallback(self, char: str) -> tuple[Written, ...]:
        """B's arc for a character."""
        m = self.model
        ids = [m.byte_id[b] for b in char.encode("utf-8", "surrogatepass")] if m.byte_fallback else [m.unk_id]
        return ((UNK, tuple(ids), self.unknown),)

    def after(self, first: Normaliser) -> Lexicon:
        """``first`` composed with this machine: an arc of its only state is one of every state here that reads its output."""
        for read, written in first.table.items():
            for node in self.nodes:
                found = (node, ()) if written is EPSILON else node.get(written, (None, self.fallback(written)) if node is self.start else None)
                if found:
                    node[read] = found
        return self


class Last(dict):
    """A state of P, the last piece: next states by piece, None where there is no arc. States are told apart by identity."""

    __hash__ = object.__hash__
    __eq__ = object.__eq__
    __slots__ = ("piece",)


class PairAcceptor:
    """P: a state for each last piece, UNK after bytes; ``start`` before the first. Of a unigram file all are one state."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.made = model, 0
        self.states: dict[int | None, Last] = {}
        self.pairs = model.kind == BPE
        self.start = self._state(None)

    def _state(self, piece: int | None) -> Last:
        found = self.states.get(piece if self.pairs else None)
        if found is None:
            found = self.states[piece] = Last()
            found.piece = piece
        return found

    def arc(self, state: Last, piece: int) -> Last | None:
        """Make the arc of ``state`` that reads ``piece``."""
        if self.made >= CACHE_ARCS:
            for other in self.states.values():
                other.clear()
            self.made = 0
        m = self.model
        stays = not self.pairs or piece == UNK or (m.whole(piece) and (state.piece is None or m.stay_apart(state.piece, piece)))
        state[piece] = self._state(piece) if stays else None
        self.made += 1
        return state[piece]


def reach(now: list[tuple], labels: Iterable[str], lexicon: Lexicon, pairs: PairAcceptor) -> list[tuple]:
    """The states (trie node, state of P, weight, path) that ``labels`` lead to from those of ``now``, which stays as it is.

    Only an arc that writes can meet another path, and a state that was reached without writing comes from further back. So those
    come first in the order of the states that one label reached, and of equal paths the first found stays."""
    root, make = lexicon.start, pairs.arc
    for label in labels:
        reached: list[tuple] = []
        wrote: dict[Last, tuple] = {}
        for node, last, cost, path in now:
            found = node.get(label)
            if found is None:
                if node is not root:
                    continue
                found = None, lexicon.fallback(label)
            child, written = found
            if child is not None:
                reached.append((child, last, cost, path))
            for piece, ids, weight in written:
                to = last[piece] if piece in last else make(last, piece)
                if to is not None and (to not in wrote or cost + weight < wrote[to][2]):
                    wrote[to] = root, to, cost + weight, (path, ids)
        if wrote:
            reached += wrote.values()
        now = reached
    return now


def begin(lexicon: Lexicon, pairs: PairAcceptor) -> list[tuple]:
    """The state before the first label."""
    return [(lexicon.start, pairs.start, 0.0, None)]


def shortest_path(labels: Iterable[str], lexicon: Lexicon, pairs: PairAcceptor, now: list[tuple] | None = None) -> list[tuple[int, ...]] | None:
    """What the composed machines write for ``labels`` on the path of least weight to a final state; None if there is none. ``now`` are the states
    that the labels before them have reached."""
    now = reach(now or begin(lexicon, pairs), labels, lexicon, pairs)
    ends = [(cost, path) for node, _, cost, path in now if node is lexicon.start]
    if not ends:
        return None
    out, path = [], min(ends, key=lambda x: x[0])[1]
    while path is not None:
        path, ids = path
        out.append(ids)
    return out[::-1]


class Codec:
    """The machines of one model, with encoding by shortest path and decoding."""

    def __init__(self, data: bytes) -> None:
        self.model = m = PieceModel(data)
        self.lexicon = Lexicon(m).after(Normaliser(m))
        self.pairs = PairAcceptor(m)
        self.merged_chunks = 0
        self.begun: dict[str, list[tuple]] = {}
        self.new: dict[tuple[bool, str], bytes] = {}
        self.old: dict[tuple[bool, str], bytes] = {}
        # Spaces and word marks are the same after N.
        self.parts = re.compile(f"\n|[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+" if m.by_word else "(?s:.+)")
        self.surface = [b"" if m.type[i] == 3 else p.replace(SPACE, " ").encode() for i, p in enumerate(m.text)]
        for byte, i in m.byte_id.items():
            self.surface[i] = bytes([byte])
        self.surface[m.unk_id] = " ⁇ ".encode()

    def shortest(self, chunk: str, first: bool) -> list[int]:
        """Ids on the shortest path of a chunk of a raw text, its first or a later one."""
        if first or len(chunk) <= HEAD:
            path = shortest_path([START, *chunk] if first else chunk, self.lexicon, self.pairs)
        else:
            head = chunk[:HEAD]
            begun = self.begun.get(head)
            if begun is None:
                if len(self.begun) >= CACHE_HEADS:
                    self.begun.clear()
                begun = self.begun[head] = reach(begin(self.lexicon, self.pairs), head, self.lexicon, self.pairs)
            path = shortest_path(chunk[HEAD:], self.lexicon, self.pairs, begun) if begun else None
        if path is None:
            self.merged_chunks += 1
            return self.merged(self.model.normalised(chunk) if first else chunk.replace(" ", SPACE))
        return [i for ids in path for i in ids]

    def merged(self, chunk: str) -> list[int]:
        out, at = [], 0
        for p in self.model.merge(chunk):
            size = 1 if p == UNK else len(self.model.text[p])
            out += self.lexicon.fallback(chunk[at : at + size])[0][1] if p == UNK else [p]
            at += size
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none of null or the empty text."""
        if not text:
            return np.empty(0, np.int32)
        new, old, parts, first = self.new, self.old, [], True
        for chunk in self.parts.findall(text):
            key = (first, chunk)
            got = new.get(key)
            if got is None:
                got = old.get(key)
                if got is None:
                    got = np.asarray(self.shortest(chunk, first), np.int32).tobytes()
                if len(new) >= CACHE_WORDS:
                    self.old, self.new = new, {}
                    new, old = self.new, self.old
                if len(chunk) < 64:
                    new[key] = got
            parts.append(got)
            first = False
        ids = np.frombuffer(b"".join(parts), np.int32)
        if self.model.byte_fallback:
            return ids
        # Without bytes for them, unknown characters in a row are one piece, also over the start of a word.
        unknown = ids == self.model.unk_id
        return ids[~np.concatenate([[False], unknown[1:] & unknown[:-1]])]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: L and B read backwards, then N's start output removed."""
        surface = self.surface
        out = b"".join(map(surface.__getitem__, ids))
        if self.model.prefix and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(data: bytes) -> Codec:
    key = hash(data)
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(id, n_ids, ids, round_trip) of every whole text, in one narrow pass.

    round_trip says whether decoding the ids gives the text back, the word mark read as a space; it is null if
    ``check`` is off. Null and empty texts have no ids and round-trip. Repeated rows are encoded each; other columns
    aren't read.
    """
    data = read_model(model_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _codec(data)
        texts = batch.column(1).to_pylist()
        ids = [c.encode(t) for t in texts]
        sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = np.concatenate(ids) if ids else np.empty(0, np.int32)
        same = [(c.decode(x.tolist()) == (t or "").replace(SPACE, " ")) if check else None for x, t in zip(ids, texts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(same, pa.bool_())],
            names=["doc_id", "n_ids", "ids", "round_trip"],
        )

    return map_batches(docs, [id_col, text_col], "doc_id long, n_ids long, ids array<int>, round_trip boolean", run)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows; null ids give a null text."""
    data = read_model(model_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _codec(data)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([None if x is None else c.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), ["doc_id", "ids"], "doc_id long, text string", run)
