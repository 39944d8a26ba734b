"""Operator 1, token counts: count-only Viterbi over Aho-Corasick matches of a SentencePiece vocabulary.

No ids are built. For each word the automaton enumerates every vocabulary match, and a dynamic programme over the
positions carries, per end position, the best score and the number of pieces on that path, with the tokenizer's tie
rules. Byte fallback counts one token per UTF-8 byte of a character that no piece covers.

The one SentencePiece file of this box states that it is a BPE model, whose segmentation is not the best-scoring path.
``n_tokens`` therefore follows the file's own rule, on the same matches: the path on which every two neighbours stay
apart under merging (see :mod:`.pieces`); it equals the tokenizer's own count. ``n_viterbi`` and ``viterbi_score``
are those of the best-scoring path over the same pieces read as a unigram vocabulary. For a unigram file, ``n_tokens``
is ``n_viterbi``.

Defined results: null and empty texts count 0 tokens; repeated rows are counted each; an empty table gives no rows;
texts of any length are counted whole; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .pieces import BPE, Counter, read_model

SCHEMA = "doc_id long, n_tokens long, n_viterbi long, viterbi_score double"
_counters: dict[int, Counter] = {}


def _counter(data: bytes) -> Counter:
    """One counter per worker and model, so that its cache of words serves all batches."""
    key = hash(data)
    if key not in _counters:
        _counters[key] = Counter(data)
    return _counters[key]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: (id, n_tokens, n_viterbi, viterbi_score). One narrow pass; nothing is shuffled."""
    data = read_model(model_path)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = _counter(data)
        got = [c.count(t) for t in batch.column(1).to_pylist()]
        own = 0 if c.model.kind == BPE else 1
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array([g[own] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())],
            names=["doc_id", "n_tokens", "n_viterbi", "viterbi_score"],
        )

    return map_batches(docs, [id_col, text_col], SCHEMA, count)
