"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are words of the lower-cased text; each is clean or toxic. Only documents are labelled, so token labels
are made from them: a word of a toxic document is taken for toxic if it, or a beginning of it, is much
commoner in toxic than in clean documents, and after a first fit if the field itself finds it so; words of
clean documents are clean. The field has a weight for each word, its beginnings, its endings and its
shape, and for each pair of neighbouring tags; its gradient comes from forward-backward marginals. In
scoring, the marginals give spans with their offsets, and a logistic function of a document's marginals,
fitted on labelled documents that the field was not fitted on, gives its score.

The fit reads at most ``max_fit_docs`` labelled documents of each class (those with the smallest id hashes);
every document is scored over its whole text.

Defined cases: a null text is empty; a text without words has the score of no evidence, no spans; rows with the
same id are scored each; a label counts for all rows with its id, one of a repeated label's rows is taken, and labels without a document are not
used; without labels of both classes all scores are the share of toxic labels (0 with none); very long texts are scored whole, in
batches of words; ties in the sample go by id; an empty table gives an empty one; columns other than id and text aren't read, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, held_out, id_text, lean, least, stored, word_list

BITS = 18
CHUNK = 64


_seed = {x: zlib.crc32(x.encode()) for x in ("w:", "d:0", "d:1", *(f"{e}{k}:" for e, lengths in (("p", (3, 4, 5, 6)), ("s", (3, 4))) for k in lengths))}
_length = [zlib.crc32(f"n:{k}".encode()) for k in range(13)]
_parts = [(k, _seed[f"p{k}:"]) for k in (3, 4, 5, 6)], [(k, _seed[f"s{k}:"]) for k in (3, 4)]


def features(word: str) -> list[int]:
    """Places of a word's features in the table of weights: itself, its beginnings and endings, its length, whether it begins with a digit."""
    n, crc, mask = len(word), zlib.crc32, (1 << BITS) - 1
    raw = word.encode()
    out = [crc(raw, _seed["w:"]) & mask, _length[min(n, 12)] & mask, _seed["d:1" if word[0].isdigit() else "d:0"] & mask]
    if len(raw) == n:
        out += [crc(raw[:k], s) & mask for k, s in _parts[0] if n > k] + [crc(raw[-k:], s) & mask for k, s in _parts[1] if n > k]
    else:
        out += [crc(word[:k].encode(), s) & mask for k, s in _parts[0] if n > k] + [crc(word[-k:].encode(), s) & mask for k, s in _parts[1] if n > k]
    return out


def forward_backward(e: np.ndarray, starts: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic tag, and of each pair of tags summed over all places (each as often as its ``weight``).

    ``e``: score of toxic over clean for each token; ``starts``: where documents begin; ``trans``: 2 x 2 scores. A document
    is cut into chunks of CHUNK tokens. All chunks' transfer matrices are made at once, then documents' chunks are
    chained, then all chunks are run through with their proper borders: exact, in 2 * CHUNK vector steps.
    """
    n = len(e)
    if n == 0:
        return np.empty(0), np.zeros((2, 2))
    ends = np.append(starts[1:], n)
    per = -(-(ends - starts) // CHUNK)
    doc = np.repeat(np.arange(len(starts)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    first = starts[doc] + k * CHUNK
    size = np.minimum(CHUNK, ends[doc] - first)
    order = np.argsort(-size, kind="stable")  # so that the chunks that reach a step are a prefix
    first, size, k, doc = first[order], size[order], k[order], doc[order]
    m = len(first)
    w, x = np.exp(trans), np.exp(np.clip(e, -30, 30))
    reach = [int(np.searchsorted(-size, -t, side="left")) for t in range(CHUNK)]  # chunks longer than t
    # Transfer matrix of each chunk, scaled: rows = tag before the chunk, columns = tag at its end.
    t00, t01, t10, t11 = np.ones(m), np.zeros(m), np.zeros(m), np.ones(m)
    for t in range(CHUNK):
        r = reach[t]
        if not r:
            break
        v = x[first[:r] + t]
        a, b, c, d = t00[:r], t01[:r], t10[:r], t11[:r]
        n00, n01, n10, n11 = a * w[0, 0] + b * w[1, 0], (a * w[0, 1] + b * w[1, 1]) * v, c * w[0, 0] + d * w[1, 0], (c * w[0, 1] + d * w[1, 1]) * v
        s = n00 + n01 + n10 + n11
        t00[:r], t01[:r], t10[:r], t11[:r] = n00 / s, n01 / s, n10 / s, n11 / s
    # Chain over each document's chunks: messages at the borders, step by step over all documents at once.
    at = {}
    steps = int(per.max())
    by_step = np.argsort(k, kind="stable")
    cut = np.searchsorted(k[by_step], np.arange(steps + 1))
    pos = np.empty((len(starts), 2))
    pos[:] = (1.0, 0.0)  # before the first token: clean
    fwd, bwd = np.empty((m, 2)), np.ones((m, 2))
    for s in range(steps):
        i = by_step[cut[s] : cut[s + 1]]
        at[s] = i
        fwd[i] = pos[doc[i]]
        a = np.stack((fwd[i, 0] * t00[i] + fwd[i, 1] * t10[i], fwd[i, 0] * t01[i] + fwd[i, 1] * t11[i]), axis=1)
        pos[doc[i]] = a / a.sum(1, keepdims=True)
    pos[:] = 1.0
    for s in range(steps - 1, -1, -1):
        i = at[s]
        bwd[i] = pos[doc[i]]
        a = np.stack((t00[i] * bwd[i, 0] + t01[i] * bwd[i, 1], t10[i] * bwd[i, 0] + t11[i] * bwd[i, 1]), axis=1)
        pos[doc[i]] = a / a.sum(1, keepdims=True)
    # Through the chunks: forward messages kept, backward ones combined with them.
    alpha = np.empty((n, 2), dtype=np.float64)
    f0, f1 = fwd[:, 0].copy(), fwd[:, 1].copy()
    for t in range(CHUNK):
        r = reach[t]
        if not r:
            break
        j = first[:r] + t
        a0, a1 = f0[:r] * w[0, 0] + f1[:r] * w[1, 0], (f0[:r] * w[0, 1] + f1[:r] * w[1, 1]) * x[j]
        s = a0 + a1
        f0[:r], f1[:r] = a0 / s, a1 / s
        alpha[j, 0], alpha[j, 1] = f0[:r], f1[:r]
    p, pairs = np.empty(n), np.zeros((2, 2))
    b0, b1 = bwd[:, 0].copy(), bwd[:, 1].copy()
    for t in range(CHUNK - 1, -1, -1):
        r = reach[t]
        if not r:
            continue
        j = first[:r] + t
        z1, z0 = alpha[j, 1] * b1[:r], alpha[j, 0] * b0[:r]
        p[j] = z1 / (z0 + z1)
        before0, before1 = (alpha[j - 1, 0], alpha[j - 1, 1]) if t else (fwd[:r, 0], fwd[:r, 1])
        v = x[j]
        q = np.stack((before0 * w[0, 0] * b0[:r], before0 * w[0, 1] * v * b1[:r], before1 * w[1, 0] * b0[:r], before1 * w[1, 1] * v * b1[:r]))
        q /= q.sum(0)
        pairs += (q.sum(1) if weight is None else q @ weight[j]).reshape(2, 2)
        m0, m1 = w[0, 0] * b0[:r] + w[0, 1] * v * b1[:r], w[1, 0] * b0[:r] + w[1, 1] * v * b1[:r]
        s = m0 + m1
        b0[:r], b1[:r] = m0 / s, m1 / s
    return p, pairs


def evidence(p: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """What the document's score is made of: expected toxic tokens, the surest one, the odds against none, and their share."""
    if not n:
        return np.zeros((len(starts), 4))
    ends = np.append(starts[1:], n)
    q = np.append(np.where(p > 0.02, p, 0), 0)
    total = np.where(ends > starts, np.add.reduceat(q, starts), 0)
    top = np.where(ends > starts, np.maximum.reduceat(q, starts), 0)
    none = np.where(ends > starts, np.add.reduceat(-np.log1p(-np.minimum(q, 0.9999)), starts), 0)
    return np.stack((np.log1p(total), top, np.log1p(none), total / np.maximum(ends - starts, 20)), axis=1)


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray
    intercept: float
    slopes: np.ndarray

    def __post_init__(self):
        self.known: dict[str, float] = {}
        self.listed = self.weights.tolist()

    def scores(self, words: list[str], bound: int = 120_000) -> np.ndarray:
        got = list(map(self.known.get, words))
        if None in got:
            known, listed = self.known, self.listed
            latest = [x for x in set(words) if x not in known]
            for x in latest:
                known[x] = sum([listed[k] for k in features(x)])
            got = list(map(known.__getitem__, words))
            if len(known) > bound:  # what came first is kept, the frequent words among it
                for x in latest:
                    del known[x]
        return np.array(got)

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + found @ self.slopes)))


def guess(ids: list[np.ndarray], toxic: np.ndarray, names: list[str]) -> np.ndarray:
    """Whether each word is much commoner in toxic documents than in clean ones, by itself or by one of its beginnings."""
    begins: dict[str, int] = {"": 0}  # 0: too short to have one
    begin = np.array([[begins.setdefault(f"{k}:{w[:k]}", len(begins)) if len(w) > k else 0 for k in (4, 5, 6)] for w in names], dtype=np.int32).reshape(-1, 3)
    n, words, starts = [max(1, int((toxic == y).sum())) for y in (0, 1)], np.zeros((2, len(names))), np.zeros((2, len(begins)))
    for own, y in zip(ids, toxic.astype(int), strict=True):
        u = np.unique(own)
        words[y, u] += 1
        starts[y, np.unique(begin[u])] += 1
    sure = lambda c, times: (c[1] >= max(3, n[1] // 400)) & (c[1] / n[1] >= times * (c[0] + 0.5) / n[0])
    by_start = sure(starts, 8)
    by_start[0] = False
    return sure(words, 12) | by_start[begin].any(axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[float, np.ndarray]:
    """Newton's method over weighted rows."""
    a, b = np.column_stack((np.ones(len(x)), x)), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(len(b))
        b = b + np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * len(x) * np.append(0, b[1:]))
    return float(b[0]), b[1:]


def fit(texts: list[str], toxic: np.ndarray, clean_weight: float = 1.0, rounds: int = 40, decay: float = 2e-2) -> Field:
    """The field by adaptive gradient steps, refitted once on its own tags, and the document score on documents left out of the fit.

    ``clean_weight``: how many times more of the clean documents than of the toxic ones each of the sample stands for.
    """
    toxic = np.asarray(toxic, dtype=bool)
    if len(toxic) == 0 or toxic.all() or not toxic.any():
        p = float(np.clip(toxic.mean(), 1e-6, 1 - 1e-6)) if len(toxic) else 1e-6
        return Field(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), float(np.log(p / (1 - p))), np.zeros(4))
    kinds: dict[str, int] = {}
    ids = [np.array([kinds.setdefault(x, len(kinds)) for x in word_list(t)], dtype=np.int32) for t in texts]
    part = np.array([zlib.crc32(t.encode()) % 3 != 0 for t in texts])  # two thirds fit the field; equal texts stay together
    if not (toxic & part).any() or not (~toxic & part).any() or not (toxic & ~part).any() or not (~toxic & ~part).any():
        part[:] = True
    names = list(kinds)
    own = [d for d, u in zip(ids, part, strict=True) if u]
    mark = guess(own, toxic[part], names)
    row, col = array("i"), array("i")
    for k, x in enumerate(names):
        places = features(x)
        row.extend([k] * len(places))
        col.extend(places)
    row, col = np.frombuffer(row, np.int32), np.frombuffer(col, np.int32)
    tokens, starts = _joined(own)
    in_toxic = np.repeat(toxic[part], [len(d) for d in own])
    weight = np.where(in_toxic, 1.0, clean_weight)
    label = mark[tokens] & in_toxic
    weights, trans = np.zeros(1 << BITS), np.array([[0.0, -3.0], [0.0, -3.0]])
    for turn in range(2):
        s_w, s_t = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6)
        inner = np.ones(len(tokens), dtype=bool)
        inner[starts] = False
        before = np.where(inner, np.append(False, label[:-1]), False)
        true_pairs = np.bincount(2 * before + label, weight, minlength=4).reshape(2, 2).astype(float)
        for _ in range(rounds):
            e = np.bincount(row, weights[col], len(names))[tokens]
            p, pairs = forward_backward(e, starts, trans, weight)
            g_kind = np.bincount(tokens, weight * (label - p), len(names))
            g = np.bincount(col, g_kind[row], 1 << BITS) - decay * weights
            g_t = true_pairs - pairs - decay * trans
            s_w += g * g
            s_t += g_t * g_t
            weights += 0.5 * g / np.sqrt(s_w)
            trans += 0.2 * g_t / np.sqrt(s_t)
        if turn == 0:
            p, _ = forward_backward(np.bincount(row, weights[col], len(names))[tokens], starts, trans)
            label |= in_toxic & (p > 0.5)
    out = Field(weights.astype(np.float32), trans, 0.0, np.zeros(4))
    calm = ~part if not part.all() else part
    tokens, starts = _joined(rest := [d for d, u in zip(ids, calm, strict=True) if u])
    p, _ = forward_backward(np.bincount(row, out.weights[col], len(names))[tokens], starts, trans)
    filled = np.array([len(d) > 0 for d in rest])
    found = np.zeros((len(rest), 4))
    found[filled] = evidence(p, starts, len(tokens))
    out.intercept, out.slopes = logistic(found, toxic[calm].astype(float), np.where(toxic[calm], 1.0, clean_weight))
    return out


def _joined(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' words in a row, and where each document that has any begins."""
    sizes = np.array([len(d) for d in ids], dtype=np.int64)
    return np.concatenate([*ids, np.empty(0, np.int32)]), (np.cumsum(sizes) - sizes)[sizes > 0]


def marginals(field: Field, words: list[str], starts: np.ndarray) -> np.ndarray:
    keep = np.append(starts[1:], len(words)) > starts
    return forward_backward(field.scores(words), starts[keep], field.trans)[0]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_fit_docs: int = 1500) -> Field:
    """``docs``: doc_id, text. Held-out ids are not read."""
    known = labels.filter(~held_out()).select("doc_id", F.col(label_col).cast("int").alias("label")).dropna().dropDuplicates(["doc_id"]).join(docs.select("doc_id"), "doc_id", "left_semi")
    known = stored(known.select("doc_id", "label", F.xxhash64("doc_id").alias("at")), "labels")
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in (0, 1)}
    pick = lambda y: known.filter(F.col("label") == y).filter(F.col("at") <= least(count.get(y, 0), max_fit_docs)).orderBy("at", "doc_id").limit(max_fit_docs).drop("at")
    chosen = pick(1).unionByName(pick(0))  # so few that the texts are the only large side
    sample = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "label")

    @lean
    def run(batches):
        rows = sorted((t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        y = np.array([r[1] for r in rows], dtype=bool)
        share = [count.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)]
        made = fit([r[0] for r in rows], y, share[0] / share[1] if all(share) else 1.0)
        yield pa.RecordBatch.from_pydict({"weights": [made.weights.tobytes()], "trans": [made.trans.ravel().tolist()], "intercept": [made.intercept], "slopes": [made.slopes.tolist()]})

    # One task fits; only weights, as many as the table has places, come to the driver.
    got = sample.repartition(1).mapInArrow(run, "weights binary, trans array<double>, intercept double, slopes array<double>").collect()
    if not got:
        return fit([], np.empty(0, bool))
    return Field(np.frombuffer(bytes(got[0]["weights"]), np.float32), np.array(got[0]["trans"]).reshape(2, 2), got[0]["intercept"], np.array(got[0]["slopes"]))


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_fit_docs: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start and end of each toxic run, in characters) of every row."""
    rows = id_text(docs, id_col, text_col)
    shared = _shared(rows, labels, label_col, max_fit_docs)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @lean
    def tag(batches):
        own = Field(*shared.value)
        for batch in batches:
            scores, spans = [], []
            for texts, cut, p, starts in _tagged(own, batch.column(1)):
                scores.append(own.score(evidence(p, starts, len(p))))
                ends = np.append(starts[1:], len(p))
                found: list[list] = [[] for _ in texts]
                for d in np.unique(np.searchsorted(starts, np.flatnonzero(p > 0.5), side="right") - 1).tolist():
                    found[d] = runs(texts[d], p[starts[d] : ends[d]] > 0.5)
                spans += found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0)), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(tag, f"doc_id {id_kind}, score double, spans array<struct<start:int,end:int>>")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def reject(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_fit_docs: int = 1500) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under the threshold. Nothing is shuffled."""
    shared = _shared(id_text(docs, id_col, text_col), labels, label_col, max_fit_docs)
    at = docs.columns.index(text_col)

    @lean
    def keep(batches):
        own = Field(*shared.value)
        for batch in batches:
            scores = [own.score(evidence(p, starts, len(p))) for _, _, p, starts in _tagged(own, batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold if scores else np.empty(0, bool)))

    return docs.mapInArrow(keep, docs.schema)


def _shared(rows: DataFrame, labels: DataFrame, label_col: str, max_fit_docs: int):
    field = train(rows, labels, label_col, max_fit_docs)
    return rows.sparkSession.sparkContext.broadcast((field.weights, field.trans, field.intercept, field.slopes))  # a fixed number of weights


def _tagged(field: Field, texts: pa.Array):
    """Texts, their words, the words' marginals and where each text's begin, a few hundred texts at a time."""
    for at in range(0, len(texts), 512):
        part = [t or "" for t in texts.slice(at, 512).to_pylist()]
        cut = [word_list(t) for t in part]
        words = [x for d in cut for x in d]
        starts = np.concatenate(([0], np.cumsum([len(d) for d in cut])[:-1])).astype(np.int64)
        yield part, cut, marginals(field, words, starts), starts


def runs(text: str, bad: np.ndarray) -> list[dict[str, int]]:
    """Character offsets in the text of the runs of tagged words."""
    where = [m.span() for m in WORD.finditer(text)]
    out: list[dict[str, int]] = []
    last = -2
    for k in np.flatnonzero(bad).tolist():
        if k == last + 1 and out:
            out[-1]["end"] = where[k][1]
        else:
            out.append({"start": where[k][0], "end": where[k][1]})
        last = k
    return out
