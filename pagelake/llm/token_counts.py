"""Token counts by the whole-token shortcut.

Offline, ``whole_tokens`` proves which vocabulary strings encode alone as the one token that they are and
are one pre-token. In a text, each pre-token among them counts one, with no merging; only the others
are merged, by the library, once for each distinct one.

A null text counts as empty: no bytes, no tokens. A row repeated is counted as often as it stands.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, lean
from .tokenizing import Encoder, encoder, forget, in_parts


@cache
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven, by encoding each alone, to be one pre-token and one token."""
    enc = Encoder(path)
    ids = [i for i in range(enc.vocab_size)]
    texts = [(i, enc.tokenizer.decode([i], skip_special_tokens=False)) for i in ids]
    texts = [(i, t) for i, t in texts if t and "�" not in t and enc.pieces(t) == [t]]
    alone = enc.tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False)
    return frozenset(t for (i, t), e in zip(texts, alone, strict=True) if e.ids == [i])


class Counter:
    """Counts by the shortcut. The whole tokens are always known; the merged rest is remembered up to a bound."""

    def __init__(self, path: str, whole: frozenset[str], bound: int = 200_000):
        self.enc, self.known, self.bound = encoder(path), dict.fromkeys(whole, 1), bound + len(whole)

    def __call__(self, texts: list[str]) -> list[int]:
        cut, known = [self.enc.pieces(t) for t in texts], self.known
        if missing := list(set().union(*(c for c in cut if c)).difference(known)):
            known.update((p, len(b) // 4) for p, b in self.enc.learn(missing).items())
        out = [len(self.enc.whole(t)) // 4 if c is None else sum(map(known.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        forget(known, missing, self.bound)
        return out


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row of ``docs``."""
    whole = whole_tokens(path)

    @lean
    def count(batches):
        if path not in _counters:
            _counters[path] = Counter(path, whole)
        for batch in batches:
            n = [x for part in in_parts(batch.column(1)) for x in _counters[path](part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
