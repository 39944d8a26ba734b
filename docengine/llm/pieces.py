"""SentencePiece vocabularies: reading a model file, segmenting by its own rule, counting without building ids.

A model file states how its pieces are put together. A unigram model takes the best-scoring segmentation. A BPE
model merges neighbours; its outcome is the one path through the lattice of vocabulary matches on which every two
neighbouring pieces stay apart when their joined text is merged on its own. Both are dynamic programmes over the
same matches, which :class:`PieceModel` enumerates with an Aho-Corasick automaton.
"""

from __future__ import annotations

import collections
import heapq
import re

import ahocorasick

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character costs below the lowest score of a normal piece, a fixed value of the format.
UNK_PENALTY = 10.0
#: Words kept by a worker in each of two generations of its cache.
CACHE_WORDS = 300_000
#: Pairs of pieces whose merging a worker remembers; beyond that it begins anew.
CACHE_PAIRS = 500_000
#: A model file is sent to every worker, so its size is checked first.
MODEL_BYTES = 64 << 20
UNK = -1
#: A path that neither starts nor ends with an unknown character.
NEITHER = (False, False)


def read_model(path: str) -> bytes:
    """The bytes of a tokenizer file, read on the driver, at most MODEL_BYTES."""
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return data


class PieceModel:
    """Pieces, scores and rules of one SentencePiece model with the identity normaliser. Characters of a normal piece are taken to be
    pieces themselves, as its trainer makes them."""

    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser are supported")
        self.kind = proto.trainer_spec.model_type
        self.prefix = norm.add_dummy_prefix
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.type = [p.type for p in proto.pieces]
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unk_id = next(i for i, t in enumerate(self.type) if t == UNKNOWN)
        self.id = {p: i for i, p in enumerate(self.text) if self.type[i] in (NORMAL, USER_DEFINED)}
        self.known = {p for p in self.id if len(p) == 1}
        self.unk_score = min((s for s, t in zip(self.score, self.type, strict=True) if t == NORMAL), default=0.0) - UNK_PENALTY
        inside = [p for p in self.id if SPACE in p.lstrip(SPACE)]
        #: Pieces never run over the start of a word or a line break, so these can be solved one by one.
        self.by_word = not inside and not any("\n" in p for p in self.id)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self._apart: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        longer = sorted((i for p, i in self.id.items() if len(p) > 1), key=lambda i: -self.score[i])
        #: When merging makes a piece: its place by score, -1 of characters. Of equal scores the order is open.
        self.made_at = [-1] * len(self.text)
        for at, i in enumerate(longer):
            self.made_at[i] = at
        times = collections.Counter(self.score[i] for i in longer)
        self.tied = {i for i in longer if times[self.score[i]] > 1}

    # -- merging, the definition of BPE ------------------------------------------------------------------------

    def merge(self, chunk: str, merges: list[tuple[str, str]] | None = None) -> list[int]:
        """Ids of a chunk by merging: the best score first, of equal ones the leftmost; UNK for a character without a piece.
        What was merged is added to ``merges``."""
        symbols = list(chunk)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1] if n else []
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (both := symbols[i] + symbols[j]) in self.id:
                heapq.heappush(heap, (-self.score[self.id[both]], i, j, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if right[i] != j or symbols[i] + symbols[j] != both or not symbols[i] or not symbols[j]:
                continue
            if merges is not None:
                merges.append((symbols[i], symbols[j]))
            symbols[i], symbols[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [self.id.get(s, UNK) for s in symbols if s]

    def whole(self, a: int) -> bool:
        """Whether merging ever makes piece ``a`` of its own text."""
        known = self._whole.get(a)
        if known is None:
            known = self._whole[a] = self.merge(self.text[a]) == [a]
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether pieces ``a`` and ``b`` may stand side by side in a merged text."""
        if a == UNK or b == UNK:
            return True
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) >= CACHE_PAIRS:
                self._apart.clear()
            known = self._apart[a, b] = self.stay_apart(a, b)
        return known

    def halves(self, a: int) -> tuple[int, int] | None:
        """The two pieces that piece ``a`` is merged of last; None if its score isn't its own or it isn't made of pieces made before it."""
        if a in self.tied:
            return None
        if a not in self._halves:
            merges: list[tuple[str, str]] = []
            whole = self.merge(self.text[a], merges) == [a]
            l, r = (self.id.get(x) for x in merges[-1]) if whole and merges else (None, None)
            at = self.made_at
            self._halves[a] = (l, r) if l is not None and r is not None and max(at[l], at[r]) < at[a] else None
        return self._halves[a]

    def stay_apart(self, a: int, b: int) -> bool:
        """:meth:`apart` without its cache, by undoing the last merge of either side: while pieces x and y met, nothing that
        crosses their border was merged if their joined text is no piece or one that comes later than what made x or y part of more."""
        x, y, limit = a, b, len(self.made_at)
        text, at = self.text, self.made_at
        while True:
            both = self.id.get(text[x] + text[y])
            if both is not None and at[both] < limit:
                return False
            if at[x] < 0 and at[y] < 0:
                return True
            if at[x] > at[y]:
                limit, found = at[x], self.halves(x)
                if found:
                    x = found[1]
            else:  # of equal merges the left one comes first
                limit, found = at[y] + 1, self.halves(y)
                if found:
                    y = found[0]
            if not found:
                break
        return self.merge(text[a] + text[b]) == [a, b]

    # -- chunks -----------------------------------------------------------------------------------------------

    def normalised(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def chunks(self, text: str) -> list[str]:
        """The normalised text in parts that no piece crosses."""
        if not text:
            return []
        out = self.normalised(text)
        return re.findall(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+", out) if self.by_word else [out]

    def n_bytes(self, char: str) -> int:
        return len(char.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1


class Counter:
    """Count-only segmentation: pieces of the file's own rule, and pieces and score of the best-scoring path."""

    def __init__(self, data: bytes) -> None:
        self.model = PieceModel(data)
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.merged_chunks = 0

    def solve(self, chunk: str) -> tuple[int, int, float, tuple[bool, bool], tuple[bool, bool]]:
        """(pieces by merging, pieces of the best path, its score, ends of both). Ties: of equal paths into a position, the one whose last
        piece starts first, as the tokenizer's own Viterbi search keeps it.

        Without byte fallback, unknown characters in a row are one piece; ends say whether a path starts and ends with one."""
        m, n = self.model, len(chunk)
        score, text = m.score, m.text
        best: list[float | None] = [None] * (n + 1)
        best_n, last, last_n = [0] * (n + 1), [UNK] * (n + 1), [0] * (n + 1)
        best[0], ok = 0.0, [False] * (n + 1)
        ok[0] = True
        joins = not m.byte_fallback
        # Whether the path into a position starts, and ends, with an unknown character.
        odd, best_odd = ([NEITHER] * (n + 1), [NEITHER] * (n + 1)) if joins else (None, None)
        matches = iter(m.automaton.iter(chunk))
        at = next(matches, None)
        for i, char in enumerate(chunk):
            top, top_n, top_odd, single = None, 0, NEITHER, False
            while at is not None and at[0] == i:
                size, piece = at[1]
                j = i + 1 - size
                single |= size == 1
                if best[j] is not None and (top is None or best[j] + score[piece] > top):
                    top, top_n = best[j] + score[piece], best_n[j] + 1
                    if joins:
                        top_odd = (best_odd[j][0], False)
                if ok[j] and not ok[i + 1] and m.whole(piece) and (j == 0 or m.apart(last[j], piece)):
                    ok[i + 1], last[i + 1], last_n[i + 1] = True, piece, last_n[j] + 1
                    if joins:
                        odd[i + 1] = (odd[j][0], False)
                at = next(matches, None)
            if not single:
                extra = m.n_bytes(char)
                if best[i] is not None and (top is None or best[i] + m.unk_score > top):
                    top, top_n = best[i] + m.unk_score, best_n[i] + extra
                    if joins:
                        top_n, top_odd = top_n - best_odd[i][1], (i == 0 or best_odd[i][0], True)
                if ok[i]:
                    ok[i + 1], last[i + 1], last_n[i + 1] = True, UNK, last_n[i] + extra
                    if joins:
                        last_n[i + 1], odd[i + 1] = last_n[i + 1] - odd[i][1], (i == 0 or odd[i][0], True)
            best[i + 1], best_n[i + 1] = top, top_n
            if joins:
                best_odd[i + 1] = top_odd
        by_merge, ends = last_n[n], odd[n] if joins else NEITHER
        if not ok[n]:  # a BPE file whose pieces can't all be made by its own merges
            self.merged_chunks += 1
            found = _with_text(m, chunk)
            unknown = [p == UNK for p, _ in found]
            by_merge = sum(1 if p != UNK else m.n_bytes(c) for p, c in found) - (sum(a and b for a, b in zip(unknown, unknown[1:], strict=False)) if joins else 0)
            ends = (unknown[0], unknown[-1]) if unknown else NEITHER
        return by_merge, best_n[n], best[n] or 0.0, ends, best_odd[n] if joins else NEITHER

    def count(self, text: str | None) -> tuple[int, int, float]:
        """Totals of a whole text; of null or the empty text zeros."""
        total, total_u, total_s = 0, 0, 0.0
        joins, after, after_u = not self.model.byte_fallback, False, False
        if text:
            new, old = self.new, self.old
            for chunk in self.model.chunks(text):
                got = new.get(chunk)
                if got is None:
                    got = old.get(chunk)
                    if got is None:
                        got = self.solve(chunk)
                    if len(new) >= CACHE_WORDS:
                        self.old, self.new = new, {}
                        new, old = self.new, self.old
                    if len(chunk) < 64:
                        new[chunk] = got
                total += got[0]
                total_u += got[1]
                total_s += got[2]
                if joins:  # a run of unknown characters goes on over the start of a chunk
                    total -= after and got[3][0]
                    total_u -= after_u and got[4][0]
                    after, after_u = got[3][1], got[4][1]
        return total, total_u, total_s


def _with_text(m: PieceModel, chunk: str) -> list[tuple[int, str]]:
    """Merged pieces of a chunk with the character of each unknown one."""
    out, at = [], 0
    for p in m.merge(chunk):
        size = 1 if p == UNK else len(m.text[p])
        out.append((p, chunk[at : at + size]))
        at += size
    return out
