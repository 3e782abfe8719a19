"""Repeated passages by paragraph MinHash banding.

Paragraphs don't hang on line ends. A document's words give five-word shingles; wherever a shingle's hash is the least of
``min_run - UNIT + 1`` neighbours, a paragraph of UNIT words begins there. So any run of ``min_run`` words holds a whole paragraph, and it
is the same one wherever the run stands. Lines of ``min_run`` words or more are paragraphs too. (The hashes' least values being where
they are, what repeats is cut into the same paragraphs in every document.)

1. Each line has a MinHash signature of its shingles, cut into bands; ``tune`` chooses bands and rows so that similar lines collide with
   the recall that is asked for. A paragraph of UNIT words has one band, of shingles that hold all its words: another one is 0.8 like it only
   if an end word differs, and then the words beside say the same. Bands that several documents have are joined.
2. Each paragraph is verified by exact Jaccard against one other: of those that are first in bands it is in, the one it shares most bands
   with. Equal words beside the two are followed as far as they go, so a link also says how far the repetition reaches.
3. Lines that still stand apart in a band are compared with all else there, in blocks of bounded size, by 32 bits of each shingle, then as in 2. Members of large bands are
   first dealt to sub-bands by their rarest shingles (a prefix filter: two sets that are similar enough share one of them).
4. Connected components of lines' links are passages; a paragraph of UNIT words belongs to its band's first. Where some of a band agree less far
   with that one than ``min_run`` words, every run of ``min_run`` words around its members is grouped by a hash; so a shorter passage hides no longer one.
5. What belongs to a component is a repeat, unless it stands in the component's first document (by id). Repeats that touch or overlap (or leave out
   at most GAP words) join, and runs of at least ``min_run`` words are cut. So every exact repetition of that many words in an earlier document goes.

Defined cases: null texts stay null and empty ones empty; a text under ``min_run`` words is never cut; a passage that repeats inside one
document only stays; a document that is cut wholly keeps an empty text, and its row; rows that are the same (id and text) are one document
and cut alike, rows that only share an id are documents of their own; rows without an id stay as they are and cut nothing; ids are of any
type that has an order; other columns are passed on untouched, whatever their names; very long texts are cut as any other, in one task each;
an empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, WordHasher, dealt_join, free_name, is_small, lean, mix64, release, remove, runs_of, scope, shingles, small, stored, word_list
from .components import components, extended
from .near_dedup import apart, dealt_blocks

TOKEN = re.compile(r"\w+|\n")
MIN_RUN, SIMILARITY, UNIT, SHINGLE = 50, 0.8, 21, 5
#: Words that a cut may take along between two repeats.
GAP = 4
#: Members of a band over which it is dealt to sub-bands, and of a block.
LARGE, BLOCK = 256, 256
#: Slots in which the rows of buckets are counted.
SLOTS = 1 << 14
#: Places of an id's bits that number a document's paragraphs.
BITS = 26
_C, _D, _MOST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFFFFFFFFFFFFFFFF)


def tune(similarity: float = SIMILARITY, recall: float = 0.9995, hashes: int = 33) -> tuple[int, int]:
    """(bands, rows): the most rows a band (the fewest chance collisions) for which bands of them reach the recall."""
    return max(((hashes // r, r) for r in range(1, hashes + 1) if 1 - (1 - similarity**r) ** (hashes // r) >= recall), key=lambda x: x[1], default=(hashes, 1))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def starts(h: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Where paragraphs begin: places whose hash is the least of some ``width`` neighbours of one document (``count`` hashes from ``first`` on).

    Where one hash comes again and again, as in a text of one word, places less than ``width`` apart count once.
    """
    if len(h) < width:
        return np.empty(0, np.int64)
    least = _least(h, width)
    border = np.zeros(len(h) + 1, np.int64)
    full = count >= width
    np.add.at(border, first[full], 1)
    np.add.at(border, first[full] + count[full] - width + 1, -1)
    least = np.where(np.cumsum(border[: len(least)]) > 0, least, 0)  # windows that cross a document's end don't count
    none = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == ~_least(~np.concatenate((none, least, none)), width))
    if len(at) > 1:
        again = (h[at][1:] == h[at][:-1]) & (np.diff(at) < width)
        run = np.cumsum(np.append(True, ~again)) - 1
        begin = at[np.append(True, ~again)][run]
        turn = (at - begin) // width
        at = at[np.append(True, ~again | (turn[1:] != turn[:-1]))]
    return at


def _minima(h: np.ndarray, cuts: np.ndarray, n: int) -> np.ndarray:
    """The least hashes of each of some stretches of ``h`` (from one cut to the next, every second one) in n orders: two of 32 bits from each mixed hash."""
    out = np.empty((n, len(cuts) // 2), np.uint64)
    for k, seed in enumerate(mix64(np.arange(1, 1 + (n + 1) // 2, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))):
        m = (h ^ seed) * _C
        m ^= m >> np.uint64(32)
        m *= _D
        m ^= m >> np.uint64(32)
        halves = m.view(np.uint32)
        for i in range(2 * k, min(n, 2 * k + 2)):
            out[i] = np.minimum.reduceat(np.ascontiguousarray(halves[i % 2 :: 2]), cuts)[::2]
    return out


def _keys(minima: np.ndarray, bands: int, rows: int, kind: int) -> np.ndarray:
    """A key for each band (columns) of each paragraph (rows); its last bit is the ``kind``, 1 for lines."""
    out = np.empty((minima.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.full(minima.shape[1], 1000 * kind + b, np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(31) + minima[b * rows + r])
        out[:, b] = key & ~np.uint64(1) | np.uint64(kind)
    return out


def _signed(rows: DataFrame, min_run: int, similarity: float) -> DataFrame:
    """doc_id, version, starts, sizes (words) of each document's paragraphs; their bands' keys, and ``of``: which paragraph each key is of."""
    width, (bands, depth) = min_run - UNIT + 1, tune(similarity)

    @lean
    def run(batches):
        hasher = WordHasher()
        line_end = hasher(["\n"])[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                found, which = [], []
                for k, text in enumerate(batch.column(2).slice(at, 128).to_pylist()):
                    tokens = TOKEN.findall(text)
                    if len(tokens) >= min_run:
                        found.append(hasher("\0".join(tokens).lower().split("\0")))
                        which.append(at + k)
                if not found:
                    continue
                h = np.concatenate(found)
                is_word = h != line_end
                ends = np.cumsum([len(x) for x in found])
                line = np.cumsum(~is_word)[is_word]  # of each word; a document's end is one too
                words, n = h[is_word], np.diff(np.concatenate(([0], np.cumsum(is_word)[ends - 1])))
                off, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
                if len(words) < min_run:
                    continue
                sh = np.append(shingles(words, SHINGLE), np.full(SHINGLE - 1, _MOST))
                begin = starts(sh, off, np.maximum(n - SHINGLE + 1, 0), width)
                begin = begin[begin + UNIT <= (off + n)[doc[begin]]]
                new = np.append(True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1]))
                first = np.flatnonzero(new)
                long = np.diff(np.append(first, len(words)))
                first, long = first[long >= min_run], long[long >= min_run]
                whole = [*range(0, UNIT - SHINGLE + 1, SHINGLE), UNIT - SHINGLE]  # shingles that hold all words
                keys, key_of = [_keys(np.stack([sh[begin + k] for k in whole]), 1, len(whole), 0).ravel()], [np.arange(len(begin))]
                if len(first):
                    cuts = np.stack((first, first + long - SHINGLE + 1), axis=1).ravel()
                    keys.append(_keys(_minima(sh, cuts, bands * depth), bands, depth, 1).ravel())
                    key_of.append(np.repeat(np.arange(len(begin), len(begin) + len(first)), bands))
                unit, size = np.concatenate((begin, first)), np.concatenate((np.full(len(begin), UNIT), long))
                own = doc[unit]
                order = np.argsort(own, kind="stable")
                count = np.bincount(own, minlength=len(n))
                place = np.empty(len(unit), np.int64)
                place[order] = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
                keys, key_of = np.concatenate(keys), np.concatenate(key_of)
                by_doc = np.argsort(own[key_of], kind="stable")
                key_count = np.bincount(own[key_of], minlength=len(n))
                some = np.flatnonzero(count)
                take = pa.array(np.array(which)[some], pa.int64())
                lists = lambda values, counts, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts[some]))), pa.int32()), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take), lists((unit - off[own])[order], count, pa.int32()), lists(size[order], count, pa.int32()),
                    lists(keys[by_doc].view(np.int64), key_count, pa.int64()), lists(place[key_of[by_doc]], key_count, pa.int32()),
                ], ["doc_id", "version", "starts", "sizes", "keys", "of"])

    return rows.mapInArrow(run, f"doc_id {_kind(rows)}, version long, starts array<int>, sizes array<int>, keys array<long>, of array<int>")


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (stored, with ``m``, what Spark numbered them when it wrote them) with ``node``: numbers without holes between tasks."""
    parts = rows.groupBy(F.shiftright("m", 33).alias("part")).agg(F.max("m").alias("high"))  # a row for each task that wrote
    count = F.col("high").bitwiseAND((1 << 33) - 1) + 1
    base = parts.select("part", (F.sum(count).over(Window.orderBy("part")) - count).alias("base"))
    return rows.withColumn("part", F.shiftright("m", 33)).join(F.broadcast(base), "part").withColumn("node", F.col("base") + F.col("m").bitwiseAND((1 << 33) - 1)).drop("part", "base", "m")


def _ranked(signed: DataFrame) -> DataFrame:
    """row (``m`` of ``signed``), node, doc_id, version: documents numbered in the order of their ids, so the least id of a paragraph is the first document's."""
    ordered = signed.select("doc_id", "version", F.col("m").alias("row")).sort("doc_id", "version")
    return stored(_numbered(stored(ordered.withColumn("m", F.monotonically_increasing_id()), "ordered")), "documents")


def node_of(name: str) -> Column:
    """The document that a paragraph or a place is of."""
    return F.shiftright(name, BITS)


def placed(name: str, start: str) -> Column:
    """The document that a paragraph is of, and a word's place there, as one number."""
    return F.shiftleft(node_of(name), BITS) + F.col(start)


def company_of(rows: DataFrame, most: int = 4096, runs: bool = False) -> DataFrame:
    """bucket, id, first (the bucket's least id) of ``rows`` (bucket, id; read several times) whose bucket several documents have.

    With ``runs``, ids are places: only those of other documents than the first come out, and such as follow one another in hot buckets may come
    as one, that of the least; ``n`` says how many they are.

    All rows of a bucket meet in one task, once. Buckets that have over ``most`` rows, and over a two thousandth of all, are fewer than 2,000; counts in
    slots tell where they may be. Their least and largest ids are aggregated before they are shuffled, and their rows stay where they are.
    """
    slot = F.shiftright("bucket", 8).bitwiseAND(SLOTS - 1)
    counted = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).toArrow()  # as many rows as there are slots at most
    n = counted["n"].to_numpy()
    most = max(most, int(n.sum()) // 2000)
    slots, rows = counted["slot"].to_numpy()[n > most].tolist(), rows.select("bucket", "id")
    ends = rows.filter(slot.isin(slots)).groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).filter(F.col("n") > most).sort("bucket").toArrow() if slots else None

    @lean
    def run(batches):
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if not sum(len(x) for x, _ in held):
            return
        bucket, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket, ids = bucket[order], ids[order]
        begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(begin, len(ids)))
        low, high = np.minimum.reduceat(ids, begin), np.maximum.reduceat(ids, begin)
        several = (low >> BITS) != (high >> BITS)
        keep, first = np.repeat(several, size), np.repeat(low[several], size[several])
        yield from made(bucket[keep], ids[keep], first, False)

    def made(bucket, ids, first, hot):
        n = np.ones(len(ids), np.int32)
        if runs:
            other = ids >> BITS != first >> BITS
            bucket, ids, first, n = (x[other] for x in (bucket, ids, first, n))
        if runs and hot and len(ids):
            begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1] + 1))
            n = np.diff(np.append(begin, len(ids))).astype(np.int32)
            bucket, ids, first = (x[begin] for x in (bucket, ids, first))
        columns = {"bucket": bucket, "id": ids, "first": first} | ({"n": n} if runs else {})
        for at in range(0, len(ids), 1 << 16):
            yield pa.RecordBatch.from_pydict({c: pa.array(x[at : at + (1 << 16)]) for c, x in columns.items()})

    kind = "bucket long, id long, first long" + ", n int" * runs
    if not ends:
        return rows.repartition("bucket").mapInArrow(run, kind)
    keys, low, high = (ends[c].to_numpy() for c in ("bucket", "low", "high"))

    @lean
    def named(batches):
        for batch in batches:
            bucket, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.searchsorted(keys, bucket)
            several = (low >> BITS != high >> BITS)[at]
            yield from made(bucket[several], ids[several], low[at][several], True)

    is_hot = F.col("bucket").isin(keys.tolist())
    return rows.filter(~is_hot).repartition("bucket").mapInArrow(run, kind).unionByName(rows.filter(is_hot).mapInArrow(named, kind))


def _around(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, a, head, root, start, n, left, words of the wanted paragraphs: 32-bit hashes of their words and of up to ``width`` on either side (none beside lines).

    ``wanted``: doc_id, version and the document's paragraphs as structs (id, a, head, root, start, n).
    """
    keys = wanted.select("doc_id", "version")
    texts = rows.join(small(keys), ["doc_id", "version"], "left_semi").join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "units")

    @lean
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                lists = part.column(1)
                count, units = lists.value_lengths().to_numpy(), lists.flatten()
                start, n = (units.field(k).to_numpy() for k in ("start", "n"))
                low = np.where(n == UNIT, np.maximum(start - width, 0), start)
                high = start + n + np.where(n == UNIT, width, 0)
                words, last = [], 0
                for text, c in zip(part.column(0).to_pylist(), count.tolist(), strict=True):
                    raw = hasher(word_list(text)).astype(np.uint32).tobytes()
                    words += [raw[4 * a : 4 * b] for a, b in zip(low[last : last + c].tolist(), high[last : last + c].tolist(), strict=True)]
                    last += c
                yield pa.RecordBatch.from_arrays([*(units.field(c) for c in ("id", "a", "head", "root", "start", "n")), pa.array((start - low).astype(np.int32)), pa.array(words, pa.binary())], ["id", "a", "head", "root", "start", "n", "left", "words"])

    return texts.select("text", "units").mapInArrow(run, "id long, a long, head boolean, root long, start int, n int, left int, words binary")


def _reach(x: np.ndarray, lx: int, nx: int, y: np.ndarray, ly: int, ny: int, similarity: float) -> tuple[int, int, int, int] | None:
    """How far two paragraphs with the words beside them agree: from and to, counted from each one's first word; None if they aren't similar."""
    u, v = x[lx : lx + nx], y[ly : ly + ny]
    trims = (0, 0, 0, 0)
    if nx != ny or u.tobytes() != v.tobytes():
        su, sv = shingles(u, SHINGLE), shingles(v, SHINGLE)
        hu, hv = np.isin(su, sv), np.isin(sv, su)
        both = len(np.unique(su[hu]))
        if both < similarity * (len(np.unique(su)) + len(np.unique(sv)) - both):
            return None
        pu, pv = np.flatnonzero(hu), np.flatnonzero(hv)
        trims = int(pu[0]), len(hu) - 1 - int(pu[-1]), int(pv[0]), len(hv) - 1 - int(pv[-1])
    left = right = 0
    if trims[0] == trims[2] == 0 and (m := min(lx, ly)):
        differ = np.flatnonzero(x[lx - m : lx] != y[ly - m : ly])
        left = m - 1 - int(differ[-1]) if len(differ) else m
    if trims[1] == trims[3] == 0 and (m := min(len(x) - lx - nx, len(y) - ly - ny)) > 0:
        differ = np.flatnonzero(x[lx + nx : lx + nx + m] != y[ly + ny : ly + ny + m])
        right = int(differ[0]) if len(differ) else m
    return trims[0] - left, nx - trims[1] + right, trims[2] - left, ny - trims[3] + right


def _flat(words: pa.Array, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' words in one array; where each row's paragraph begins in it, and where the row ends."""
    raw = words.to_pylist()
    size = np.array([len(x) // 4 for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint32), np.cumsum(size) - size + left, np.cumsum(size)


def _rows_of_shingles(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of paragraphs of UNIT words, a row each, and how many; what is left of a row holds large numbers of its own."""
    h = np.zeros((len(units), UNIT - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        h = (h ^ units[:, i : i + h.shape[1]]) * _C
        h ^= h >> np.uint64(29)
    h = np.sort(mix64(h), axis=1)
    again = np.zeros(h.shape, bool)
    again[:, 1:] = h[:, 1:] == h[:, :-1]
    return np.where(again, _MOST - np.arange(h.shape[1], dtype=np.uint64), h), h.shape[1] - again.sum(axis=1)


def _similar(u: np.ndarray, v: np.ndarray, similarity: float) -> np.ndarray:
    """Of pairs of paragraphs of UNIT words (rows), which are similar."""
    (a, na), (b, nb) = _rows_of_shingles(u), _rows_of_shingles(v)
    b = np.where(b > _MOST - np.uint64(64), b - np.uint64(64), b)
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    shared = (both[:, 1:] == both[:, :-1]).sum(axis=1)
    return shared >= similarity * (na + nb - shared)


def _alike(x: np.ndarray, at: np.ndarray, y: np.ndarray, there: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from ``at`` and ``there`` on, in steps of 1 or -1, ``most`` at most."""
    k = np.arange(int(most.max(initial=0)))[None, :]
    ok = k < most[:, None]
    same = ok & (x[np.where(ok, at[:, None] + step * k, 0)] == y[np.where(ok, there[:, None] + step * k, 0)])
    return np.argmin(np.concatenate((same, np.zeros((len(at), 1), bool)), axis=1), axis=1)


def _partnered(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """``pairs`` with their partners' rows of ``heads``, by ``a``. Partners of very many are 10,000 at most: what has them is joined on its own, the rest isn't looked up."""
    if is_small(heads):
        return pairs.join(F.broadcast(heads), "a")
    each = max(4096, pairs.count() // 10_000)
    hot = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > each).select("a").toArrow()["a"].to_pylist()
    if not hot:
        return pairs.join(heads, "a")
    is_hot = F.col("a").isin(hot)
    return pairs.filter(~is_hot).join(heads.filter(~is_hot), "a").unionByName(dealt_join(pairs.filter(is_hot), heads.filter(is_hot), "a"))


LINK = "a long, b long, a_start int, b_start int, a_from int, a_to int, b_from int, b_to int, unit boolean"


def _linked(pairs: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """The links among ``pairs`` (a, id, start, n, left, words) and their partners' rows of ``heads``."""
    other = heads.select(F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("start", "n", "left", "words")))
    joined = _partnered(pairs.select("a", "id", "start", "n", "left", "words"), other).select("a", "id", "a_n", "a_left", "a_words", "n", "left", "words", "a_start", "start")

    @lean
    def compare(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                an, al, bn, bl = (batch.column(k).to_numpy() for k in (2, 3, 5, 6))
                (x, at, x_end), (y, there, y_end) = _flat(batch.column(4), al), _flat(batch.column(7), bl)
                out = np.zeros((4, batch.num_rows), np.int32)
                keep = np.zeros(batch.num_rows, bool)
                w = np.flatnonzero((an == UNIT) & (bn == UNIT))
                u, v = (z[p[w][:, None] + np.arange(UNIT)] for z, p in ((x, at), (y, there)))
                equal = (u == v).all(axis=1)
                e = w[equal]
                left = _alike(x, at[e] - 1, y, there[e] - 1, np.minimum(al[e], bl[e]), -1)
                right = _alike(x, at[e] + UNIT, y, there[e] + UNIT, np.minimum(x_end[e] - at[e], y_end[e] - there[e]) - UNIT, 1)
                out[:, e], keep[e] = np.stack((-left, UNIT + right, -left, UNIT + right)), True
                near = w[~equal][_similar(u[~equal], v[~equal], similarity)]
                lines = (an != UNIT) | (bn != UNIT)
                same = np.flatnonzero(lines & (an == bn) & (al == 0) & (bl == 0) & (x_end - at == an) & pc.equal(batch.column(4), batch.column(7)).to_numpy(zero_copy_only=False))
                out[1, same], out[3, same], keep[same], lines[same] = an[same], bn[same], True, False
                for k in (*near.tolist(), *np.flatnonzero(lines).tolist()):
                    if got := _reach(x[at[k] - al[k] : x_end[k]], al[k], an[k], y[there[k] - bl[k] : y_end[k]], bl[k], bn[k], similarity):
                        out[:, k], keep[k] = got, True
                hit = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(hit) for c in (0, 1, 8, 9)), *(pa.array(c[keep]) for c in out), pa.array(bn[keep] == UNIT)], ["a", "b", "a_start", "b_start", "a_from", "a_to", "b_from", "b_to", "unit"])

    return joined.mapInArrow(compare, LINK)


def _shingled(members: DataFrame) -> DataFrame:
    """id, root, ``shingles`` of lines: the distinct shingles of ``words`` as bytes, 32 bits of each, sorted."""

    @lean
    def run(batches):
        for batch in batches:
            n, left = (batch.column(k).to_numpy() for k in ("n", "left"))
            x, at, _ = _flat(batch.column("words"), left)
            made: list = []
            for begin in range(0, batch.num_rows, 1024):
                part = np.arange(begin, min(begin + 1024, batch.num_rows))
                count = n[part].astype(np.int64) - SHINGLE + 1
                row = np.repeat(np.arange(len(part)), count)
                place = np.repeat(at[part] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                hashes = shingles(x[at[part[0]] : at[part[-1]] + n[part[-1]]], SHINGLE)[place - at[part[0]]] >> np.uint64(32)  # rows stand in order
                both = np.unique(row.astype(np.uint64) << np.uint64(32) | hashes)
                raw, ends = both.astype(np.uint32).tobytes(), 4 * np.cumsum(np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(part)))
                made += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "root")), pa.array(made, pa.binary())], ["id", "root", "shingles"])

    return members.mapInArrow(run, "id long, root long, shingles binary")


def sub_bands(members: DataFrame, similarity: float, most_slots: int = 1 << 20) -> DataFrame:
    """bucket, id, root: ``members`` (id, root, shingles; an id may come again) dealt to sub-bands by their rarest shingles among all members.

    Of a set of u shingles, similar sets share at least ceil(similarity * u); so, in whatever order, one of its first
    u - ceil(similarity * u) + 1. Rarest first, sets that only share what is common don't meet. How often shingles are is counted in a
    table of a bounded number of slots by their hashes, which makes an order of no less use; what is alone in its slot has no mate and is left out.
    """
    one = members.select("id", "root", "shingles").dropDuplicates(["id"])
    total = one.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    slots = 1 << min(most_slots.bit_length() - 1, max(16, (total // 2).bit_length()))

    @lean
    def count(batches):
        often = np.zeros(slots, np.int64)
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            often += np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        some = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(often[some])], ["slot", "often"])

    counted = one.select("shingles").mapInArrow(count, "slot long, often long").groupBy("slot").agg(F.sum("often").alias("often")).toArrow()
    often = np.zeros(slots, np.uint64)
    often[counted["slot"].to_numpy()] = counted["often"].to_numpy()  # as many rows as there are slots at most
    shared = one.sparkSession.sparkContext.broadcast(often)

    @lean
    def run(batches):
        for batch in batches:
            row, subs = [], []
            for k, raw in enumerate(batch.column("shingles").to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                many = shared.value[(h & np.uint64(slots - 1)).astype(np.int64)]
                first = np.lexsort((h, many))[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]
                first = first[many[first] > 1]
                row += [k] * len(first)
                subs.append(h[first])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*subs, np.empty(0, np.uint64)]).view(np.int64)), *(batch.column(c).take(take) for c in ("id", "root"))], ["bucket", "id", "root"])

    return stored(one.mapInArrow(run, "bucket long, id long, root long"), "sub-bands")


def _met(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, id) that join the components of each bucket's ``members`` (bucket, id, root). ``sets``: id, shingles.

    Exact for all pairs of two blocks at once: shared shingles are counted by a matrix product over the shingles that more than one
    member has. Only links come out, and no more than join what was apart in the group.
    """

    def links(group: pa.RecordBatch) -> list[tuple[int, int]]:
        sets = [np.frombuffer(b, np.uint32) for b in group.column("shingles").to_pylist()]
        ids, roots, own = group.column("doc_id").to_pylist(), group.column("root").to_pylist(), group.column("own").to_numpy()
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        size = np.array([len(s) for s in sets], dtype=np.float32)
        kinds, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        keep = often[column] > 1
        place = np.cumsum(often > 1) - 1
        row, column, wide = row[keep], place[column[keep]], int((often > 1).sum())
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        for at in range(0, wide, 4096):
            part = (column >= at) & (column < at + 4096)
            m = np.zeros((len(sets), min(4096, wide - at)), dtype=np.float32)
            m[row[part], column[part] - at] = 1
            both += m[left] @ m[right].T
        hit = both >= similarity * (size[left][:, None] + size[right][None, :] - both) - 1e-4
        root = group.column("root").to_numpy()
        hit &= root[left][:, None] != root[right][None, :]
        up = {r: r for r in roots}

        def top(r):
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        out = []
        for i, k in np.argwhere(hit).tolist():
            i, k = int(left[i]), int(right[k])
            if i != k and (a := top(roots[i])) != (b := top(roots[k])):
                up[a] = b
                out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
        return out

    @lean
    def compare(batches):
        made: list[tuple[int, int]] = []
        for group in runs_of(batches, ["bucket", "x", "y"]):
            if group.num_rows > 1:
                made += links(group)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in made], pa.int64()) for k in (0, 1)], ["a", "id"])

    dealt = dealt_blocks(members.withColumnRenamed("id", "doc_id"), BLOCK).join(sets.withColumnRenamed("id", "doc_id"), "doc_id").select("bucket", "x", "y", "own", "doc_id", "root", "shingles").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "doc_id")
    return dealt.mapInArrow(compare, "a long, id long").distinct()


def _wide(batches):
    """Shingles in 64 bits, as sub-bands take them; the low bits, which choose slots, are mixed ones already."""
    for batch in batches:
        made = [np.frombuffer(x, np.uint32).astype(np.uint64).tobytes() for x in batch.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), pa.array(made, pa.binary())], ["id", "root", "shingles"])


def _apart_links(company: DataFrame, roots: DataFrame, lines: DataFrame, similarity: float) -> DataFrame | None:
    """Links between lines that stand apart in a band after each was verified against one other; None if there are none."""
    with scope() as paths:
        members = stored(apart(company.select("bucket", F.col("id").alias("doc_id")), roots).withColumnRenamed("doc_id", "id"), "apart")
        if members.isEmpty():
            return None
        one = stored(_shingled(lines.select("id", "n", "left", "words").join(stored(members.select("id", "root").distinct(), "apart-lines"), "id")), "shingles")
        sizes = stored(members.groupBy("bucket").agg(F.count("*").alias("many")).filter(F.col("many") > LARGE).select("bucket"), "large")
        if not sizes.isEmpty():
            large = dealt_join(members, sizes, "bucket").select("id").distinct()
            dealt = sub_bands(one.join(large, "id").mapInArrow(_wide, "id long, root long, shingles binary"), similarity)
            dealt = apart(dealt.select("bucket", F.col("id").alias("doc_id")), roots).withColumnRenamed("doc_id", "id")
            members = members.join(F.broadcast(sizes), "bucket", "left_anti").unionByName(dealt.select(members.columns))
        pairs = stored(_met(members.select("bucket", "id", "root"), one.select("id", "shingles"), similarity), "pairs")
        links = None
        if not pairs.isEmpty():
            heads = lines.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
            links = stored(_linked(pairs.join(lines.drop("a"), "id"), stored(heads, "heads"), similarity), "more-links")
    remove(lines.sparkSession, [p for p in paths if links is None or p != links._stored_at])
    return links


def _run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, by doubling."""
    both = lambda a, b: mix64(a * _C ^ b)
    h, size = mix64(words), 1
    while 2 * size <= width:
        h, size = both(h[: max(0, len(h) - size)], h[size:]), 2 * size
    return both(h[: max(0, len(h) - (width - size))], h[width - size :]) if width > size else h


def _long_runs(links: DataFrame, around: DataFrame, min_run: int) -> DataFrame | None:
    """node, from, to, first: runs of ``min_run`` words around paragraphs of which a partner's shorter passage may have hidden some."""
    units = around.filter(F.col("n") == UNIT)
    short = links.filter(F.col("unit") & (F.col("b_to") - F.col("b_from") < min_run)).select(F.col("a").alias("root")).distinct()
    several = units.groupBy("root").agg(F.count("*").alias("members")).filter("members > 2").select("root")
    which = stored(several.join(short, "root"), "short")
    if which.isEmpty():
        return None
    want = min_run - UNIT

    @lean
    def run(batches):
        for batch in batches:
            ids, start, left = (batch.column(c).to_numpy().astype(np.int64) for c in ("id", "start", "left"))
            words, at, end = _flat(batch.column("words"), left)
            low, high = start - np.minimum(left, want), start - np.maximum(0, want - (end - at - UNIT))
            node = ids >> BITS
            follows = np.flatnonzero((node[1:] == node[:-1]) & (start[1:] >= start[:-1]))  # the one before has had its runs
            low[follows + 1] = np.maximum(low[follows + 1], high[follows] + 1)
            count = np.maximum(0, high - low + 1)
            row = np.repeat(np.arange(len(ids)), count)
            place = np.arange(len(row)) - (np.cumsum(count) - count)[row] + low[row]
            keys = _run_hashes(words, min_run)[at[row] - start[row] + place] if len(row) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array((node[row] << BITS) + place)], ["bucket", "id"])

    held = dealt_join(units.select("root", "id", "start", "left", "words"), which, "root").select("id", "start", "left", "words")
    each = stored(held.mapInArrow(run, "bucket long, id long"), "runs")
    at = F.col("id").bitwiseAND((1 << BITS) - 1).cast("int")
    again = stored(company_of(each, runs=True).select(node_of("id").alias("node"), at.alias("from"), (at + F.col("n") - 1 + min_run).alias("to"), "first"), "again")
    release(each)
    return again


def _line_repeats(company: DataFrame, links: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """node, from, to, first: lines of components that aren't in the first document of theirs, as far as their links reach."""
    links = stored(links.filter("not unit"), "line-links")
    roots = stored(components(links.select("a", "b")), "roots")
    if (more := _apart_links(company, roots, lines, similarity)) is not None:
        links, roots = links.unionByName(more), stored(extended(roots, more), "roots")
    sides = links.select(*(F.col(f"a{c}").alias(c.strip("_") or "node") for c in ("", "_start", "_from", "_to"))).unionByName(links.select(*(F.col(f"b{c}").alias(c.strip("_") or "node") for c in ("", "_start", "_from", "_to"))))
    reach = sides.groupBy("node").agg(F.first("start").alias("start"), F.min("from").alias("from"), F.max("to").alias("to"))
    several = stored(reach.join(roots, "node").withColumnRenamed("node", "id"), "several")
    first = stored(several.groupBy("root").agg(F.min(placed("id", "start")).alias("first")), "passages")
    found = dealt_join(several, first, "root").filter(node_of("id") != node_of("first"))
    return found.select(node_of("id").alias("node"), (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"), "first")


def repeats(docs: DataFrame, min_run: int = MIN_RUN, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version (a hash of the text), cut: the runs of words (from, to, and where the first repeat in it first occurs) that repeat an earlier document's."""
    if min_run < UNIT + 10:
        raise ValueError(f"min_run must be {UNIT + 10} words or more")
    with scope() as paths:
        out = _repeats(docs, min_run, similarity, id_col, text_col)
    remove(docs.sparkSession, [p for p in paths if p != out._stored_at])
    return out


def _repeats(docs: DataFrame, min_run: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null").withColumn("version", F.xxhash64("text")).select("doc_id", "version", "text")
    signed = stored(_signed(rows, min_run, similarity).withColumn("m", F.monotonically_increasing_id()), "paragraphs")
    if not signed.groupBy("doc_id", "version").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        rows, twice = rows.dropDuplicates(["doc_id", "version"]), signed
        signed = stored(twice.groupBy("doc_id", "version").agg(F.min_by(F.struct("starts", "sizes", "keys", "of"), "m").alias("x")).select("doc_id", "version", "x.*").withColumn("m", F.monotonically_increasing_id()), "paragraphs")
        release(twice)
    ranks = _ranked(signed)
    numbered = signed.join(small(ranks.select(F.col("row").alias("m"), "node")), "m")
    members = numbered.select("node", F.explode(F.arrays_zip("keys", "of")).alias("x")).select(F.col("x.keys").alias("bucket"), (F.shiftleft("node", BITS) + F.col("x.of")).alias("id"))
    company = stored(company_of(members), "company")
    # A paragraph of UNIT words is in one band, whose first is its partner. Of a line's, one of another document that it shares most bands with;
    # only what is first in some band (``head``) can be one.
    is_line, other = F.col("bucket").bitwiseAND(1) == 1, node_of("first") != node_of("id")
    units = company.filter(~is_line).select("id", F.when(other, F.col("first")).alias("a"), (F.col("first") == F.col("id")).alias("head"), F.col("first").alias("root"))
    in_lines = company.filter(is_line)
    partner = in_lines.groupBy("id", "first").agg(F.count("*").alias("n")).withColumn("other", other)
    partner = partner.groupBy("id").agg(F.max_by(F.when(F.col("other"), F.col("first")), F.struct("other", "n", -F.col("first"))).alias("a"), F.max(F.col("first") == F.col("id")).alias("head"))
    units = units.unionByName(partner.withColumn("root", F.lit(None).cast("long")))
    units = stored(units.groupBy(node_of("id").alias("node")).agg(F.sort_array(F.collect_list(F.struct("id", "a", "head", "root"))).alias("units")), "units")
    place = lambda u: u["id"].bitwiseAND((1 << BITS) - 1).cast("int")
    wanted = numbered.select("node", "doc_id", "version", "starts", "sizes").join(units, "node")
    wanted = stored(wanted.select("doc_id", "version", F.transform("units", lambda u: F.struct(u["id"].alias("id"), u["a"].alias("a"), u["head"].alias("head"), u["root"].alias("root"), F.get("starts", place(u)).alias("start"), F.get("sizes", place(u)).alias("n"))).alias("units")), "wanted")
    release(signed, units)
    around = stored(_around(rows, wanted, min_run - UNIT), "around")
    release(wanted)
    links = stored(_linked(around.filter("a is not null"), around.filter("head"), similarity), "links")
    # Repeats: as far as paragraphs agree with the first document's, lines with any of their component's, and longer runs that these hid.
    found = links.filter("unit").select(node_of("b").alias("node"), (F.col("b_start") + F.col("b_from")).alias("from"), (F.col("b_start") + F.col("b_to")).alias("to"), placed("a", "a_start").alias("first"))
    if not in_lines.isEmpty():
        found = found.unionByName(stored(_line_repeats(in_lines, links, around.filter(F.col("n") != UNIT), similarity), "line-repeats"))
    release(company)
    if (hidden := _long_runs(links, around, min_run)) is not None:
        found = found.unionByName(hidden)
    release(around)
    lists = found.groupBy("node").agg(F.collect_list(F.struct("from", "to", "first")).alias("found"))

    @lean
    def join_runs(batches):
        for batch in batches:
            pieces = batch.column(1).flatten()
            row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
            begin, end = (pieces.field(k).to_numpy().astype(np.int64) for k in ("from", "to"))
            order = np.lexsort((end, begin, row))
            row, begin, end, pieces = row[order], begin[order], end[order], pieces.take(pa.array(order))
            wide = int(end.max(initial=0)) + GAP + 2
            reach = np.maximum.accumulate(end + row * wide)  # rows one after the other, too far apart to touch
            new = np.append(True, begin[1:] + row[1:] * wide > reach[:-1] + GAP)[: len(row)]
            first = np.flatnonzero(new)
            begin, row = begin[first], row[first]
            end = (reach[np.append(first[1:], len(reach)) - 1] if len(first) else reach[:0]) - row * wide
            long = end - begin >= min_run
            of = pieces.field("first").to_numpy()[first[long]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[long])), pa.array(begin[long], pa.int32()), pa.array(end[long], pa.int32()), pa.array(of >> BITS), pa.array((of & ((1 << BITS) - 1)).astype(np.int32))], ["node", "from", "to", "first", "start"])

    runs = stored(lists.mapInArrow(join_runs, "node long, `from` int, `to` int, first long, start int"), "joined-runs")
    runs = dealt_join(runs, ranks.select(F.col("node").alias("first"), F.col("doc_id").alias("first_id")), "first")
    cuts = runs.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("from", "to", F.struct(F.col("first_id").alias("doc_id"), "start").alias("of")))).alias("cut"))
    return stored(cuts.join(small(ranks.select("node", "doc_id", "version")), "node").select("doc_id", "version", "cut"), "cuts")


def cut_repeats(docs: DataFrame, min_run: int = MIN_RUN, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", cuts_col: str = "cuts") -> DataFrame:
    """``docs`` with repeated passages cut from the text, and ``cuts_col`` (a longer name if that is taken): where they stood (characters) and where they first
    occur (document and word). A cut takes the punctuation and space after its last word along, so that what stood before and after join."""
    cuts = repeats(docs, min_run, similarity, id_col, text_col)
    key, version, cut, name = (free_name(docs, n) for n in ("__id", "__version", "__cut", cuts_col))
    cuts = cuts.select(F.col("doc_id").alias(key), F.col("version").alias(version), F.col("cut").alias(cut))
    rows = docs.withColumn(version, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn(key, F.col(id_col))
    rows = rows.join(small(cuts), [key, version], "left").select(*docs.columns, cut)
    at = rows.columns.index(text_col)
    id_kind = docs.schema[id_col].dataType.simpleString()
    kind = f"array<struct<start:int,`end`:int,of:struct<doc_id:{id_kind},start:int>>>"

    @lean
    def run(batches):
        for batch in batches:
            texts, runs = batch.column(at), batch.column(len(batch.schema) - 1)
            where = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False)).tolist()
            made, spans = {}, [[] for _ in range(batch.num_rows)]
            for k in where:
                made[k], spans[k] = without(texts[k].as_py(), runs[k].as_py())
            if made:
                changed = np.zeros(batch.num_rows, bool)
                changed[list(made)] = True
                texts = pc.replace_with_mask(texts, pa.array(changed), pa.array(made.values(), texts.type))
            span_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("of", runs.type.value_type.field("of").type)]))
            columns = [texts if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, span_kind)], [*batch.schema.names[:-1], name])

    from pyspark.sql.types import StructType, _parse_datatype_string

    return rows.mapInArrow(run, StructType([*docs.schema.fields]).add(name, _parse_datatype_string(kind)))


_after = re.compile(r"[^\w\s]*\s*")


def without(text: str, runs: list[dict]) -> tuple[str, list[dict]]:
    """The text without the runs of words, and the characters that went."""
    words = [m.span() for m in WORD.finditer(text)]
    spans, kept, last = [], [], 0
    for r in runs:
        start = words[r["from"]][0] if r["from"] else 0
        end = _after.match(text, words[r["to"] - 1][1]).end() if r["to"] < len(words) else len(text)
        spans.append({"start": start, "end": end, "of": r["of"]})
        kept.append(text[last:start])
        last = end
    return "".join([*kept, text[last:]]), spans
