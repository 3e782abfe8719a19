"""Near-duplicates by order MinHash, verified by banded alignment.

A document's words give five-word shingles, each labelled with how often it has come before in the text.
A sketch is the ``minima`` smallest of them under one hash order, kept in the order of the text; a document has
``sketches`` of them. Documents that share a sketch agree not only on shingles but on their order, so they are likely
close in edit distance. Candidates are verified by an alignment of their words inside a band as wide as
the edits allowed: two documents are linked if edits <= (1 - ``similarity``) * words of the longer.

Classes are the connected components of links, the least id naming each:

1. Texts with the same words form one group; only the group's least row goes on, so copies make no pairs.
2. Each group is verified against one other: of those that are first in buckets it is in, the one it shares most buckets with.
   Whole families of near copies become one component here, with one pair for each member.
3. What still stands apart in a bucket is compared with all else there, in blocks of bounded size: all members, by
   counts of words at once. All pairs of several components whose counts allow so few edits are verified there and join components.

Defined cases: null and empty texts, and texts without words, are a class together (as copies of the empty text); texts under five
words have one shingle; rows of the same id and text are one document, rows that only share an id are documents of their own, each in its
text's class (the id is then in both; the result has a row for each row); rows without an id are in no class and never dropped; ids are of
any type that has an order; ties go to the least id; very long texts are sketched and aligned whole (one task holds two of them); an empty
table gives an empty one. Only the id and the text are read, other columns are passed on whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, dealt_join, free_name, id_text, lean, mix64, release, runs_of, shingles, small, stored
from .components import components

WORD = re.compile(r"\w+")
SKETCHES, MINIMA, SIMILARITY = 32, 3, 0.8
#: Documents of one bucket that are compared in a task with as many others, and the bins that their words are counted in before.
BLOCK, BINS = 256, 512
#: Edits that the narrow band allows at first.
BAND = 32
_seeds = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def labelled(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of k-word shingles with their occurrence numbers."""
    h = shingles(words, k)
    if len(h) < 2:
        return h
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])
    if new.all():
        return h
    starts = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = np.empty_like(h)
    out[order] = np.where(nth > 0, mix64(s + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), s)
    return out


def sketch(words: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    """The document's sketches, a 64-bit key each."""
    h = labelled(words)
    n = len(h)
    keys = np.empty(SKETCHES, np.uint64)
    take = min(minima, n)
    for at in range(0, SKETCHES, 8):  # eight orders at a time: a long text's hashes fit in cache
        m = (h[None, :] ^ _seeds[at : at + 8, None]) * np.uint64(0x9E3779B97F4A7C15)
        m ^= m >> np.uint64(32)
        m *= np.uint64(0xD6E8FEB86659FD93)
        where = np.sort(np.argpartition(m, take - 1, axis=1)[:, :take], axis=1) if n > take else np.tile(np.arange(n), (len(m), 1))
        key = np.full(len(m), n if n < minima else minima, np.uint64) + np.arange(at, at + len(m), dtype=np.uint64) * np.uint64(977)
        for j in range(take):
            key = mix64(key * np.uint64(31) + h[where[:, j]])
        keys[at : at + 8] = key
    return keys


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if it is at most ``most``, else ``most + 1``.

    First inside a narrow band of diagonals: the furthest word that each reaches with a number of edits, where runs of equal words
    are skipped at once by a table of where the diagonal's next difference is. Near copies end there. What needs a wider band
    is aligned by columns of bits, one big integer for a column, until ``most`` can't be kept.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    lo = 0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    lo = int(differ[0]) if len(differ) else short
    a, b = a[lo:], b[lo:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    hi = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    if max(n, m) - _common(a, b) > most:
        return most + 1
    band = min(most, max(BAND, abs(n - m)))
    if (2 * band + 1) * n <= 4_000_000:
        d = _banded(a, b, band)
        if d <= band or band == most:
            return min(d, most + 1)
    return _by_columns(a, b, most)


def _by_columns(a: np.ndarray, b: np.ndarray, most: int) -> int:
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    full, last = (1 << n) - 1, 1 << (n - 1)
    at: dict[int, int] = {}
    for k, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << k
    more, less, score = full, 0, n  # where a column rises and falls from its top down; its lowest value
    for left, w in zip(range(len(b) - 1, -1, -1), b.tolist(), strict=True):
        same = at.get(w, 0) | less
        diagonal = ((((same & more) + more) ^ more) | same) & full
        up, down = less | (full & ~(more | diagonal)), more & diagonal
        score += bool(up & last) - bool(down & last)
        if score - left > most:
            return most + 1
        up = (up << 1 | 1) & full
        less, more = up & diagonal, (down << 1 | (full & ~(up | diagonal))) & full
    return min(score, most + 1)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words the two have in common, with repeats: no alignment keeps more."""
    u, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    return int(np.minimum(np.bincount(inverse[: len(a)], minlength=len(u)), np.bincount(inverse[len(a) :], minlength=len(u))).sum())


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    n, m = len(a), len(b)
    diagonals = np.arange(-band, band + 1)  # of b's place less a's
    width = len(diagonals)
    padded = np.concatenate((np.zeros(band, np.uint64), b, np.zeros(band + n + 1, np.uint64)))
    view = np.lib.stride_tricks.sliding_window_view(padded, n)[:width]  # row k: b along diagonal k - band
    column = np.arange(n)[None, :] + diagonals[:, None]
    stop = np.where((view == a[None, :]) & (column >= 0) & (column < m), n, np.arange(n)[None, :]).astype(np.int32)
    stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    stop = np.concatenate((stop, np.full((width, 1), n, np.int32)), axis=1)
    slide = lambda at: stop[np.arange(width), np.clip(at, 0, n)]
    far = np.full(width + 2, -1, dtype=np.int64)  # place in a that each diagonal reaches; -1: none yet
    far[band + 1] = slide(np.zeros(width, np.int64))[band]
    goal = m - n + band + 1
    limit_b = m - diagonals
    for d in range(band + 1):
        if d:
            mid, left, right = far[1:-1], far[:-2], far[2:]
            # one word changed, one of b left out, one of a left out
            step = np.maximum(np.maximum(np.where(mid >= 0, mid + 1, -1), left), np.where(right >= 0, right + 1, -1))
            step = np.where((step >= 0) & (step >= -diagonals), np.minimum(np.minimum(step, n), limit_b), -1)
            ok = (step >= 0) & (step + diagonals >= 0)
            far[1:-1] = np.where(ok, np.maximum(step, slide(step)), -1)
        if 1 <= goal <= width and far[goal] >= n:
            return d
    return band + 1


def _word_hashes(text: str, hasher: WordHasher) -> np.ndarray:
    return hasher(WORD.findall(text.lower()))


def _sketched(rows: DataFrame) -> DataFrame:
    """doc_id, version, h1, h2 (a 128-bit digest of the word sequence), n (words), keys of each row (doc_id, version, text)."""

    @lean
    def run(batches):
        import xxhash

        hasher = WordHasher()
        for batch in batches:
            h1, h2, n, keys = [], [], [], []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(2).slice(at, 256).to_pylist():
                    words = _word_hashes(text, hasher)
                    d = xxhash.xxh3_128_intdigest(words.tobytes())
                    h1.append((d & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    h2.append((d >> 64) - (1 << 63))
                    n.append(len(words))
                    k = sketch(words) if len(words) else np.empty(0, np.uint64)
                    keys.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "version", "h1", "h2", "n", "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, version long, h1 long, h2 long, n int, keys array<long>")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of ids in ``pairs`` whose texts' alignment is within the band. ``docs``: doc_id, text of all of them, an id once. Both are stored."""
    joined = dealt_join(pairs, docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    joined = dealt_join(joined, docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    @lean
    def align(batches):
        hasher = WordHasher()
        last, words = None, None
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for k, (x, y) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if x != last:
                        last, words = x, _word_hashes(x, hasher)
                    other = _word_hashes(y, hasher)
                    most = int((1 - similarity) * max(len(words), len(other)) + 1e-9)
                    if edits(words, other, most) <= most:
                        keep.append(at + k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(align, f"a {kind}, b {kind}")


def may_be_near(one: np.ndarray, others: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Which of ``others`` (counts of words in bins, a row each) may be within the edits of ``one``: words in common are at most what bins have in common, so none that is gets lost."""
    longer = np.maximum(one.sum(), others.sum(axis=1))
    return longer - np.minimum(one, others).sum(axis=1) <= ((1 - similarity) * longer + 1e-9).astype(np.int64)


def apart(company: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, doc_id, root of all members of each bucket that holds several components: any of them may be the one that a member of another is near."""
    own = stored(company.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "own")
    several = own.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    return dealt_join(own, stored(several, "several"), "bucket")


def _met(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the components of each bucket's ``members`` (bucket, doc_id, root, keys), found in blocks. ``texts``: doc_id, text.

    Texts come along, so a pair is verified where it is met and never is a row: only links come out, and no more than join what was
    apart in the block. Two of one component are not compared; others are in the first bucket that they share and not again.
    """
    dealt = dealt_blocks(members).join(texts, "doc_id")

    def links(group: pa.RecordBatch, hasher: WordHasher) -> list[tuple]:
        n = group.num_rows
        keys = group.column("keys").flatten().to_numpy().reshape(n, -1)
        ids, own, root = group.column("doc_id").to_pylist(), group.column("own").to_numpy(), group.column("root").to_numpy(zero_copy_only=False)
        x, y, bucket = (group.column(c)[0].as_py() for c in ("x", "y", "bucket"))
        which = int(np.flatnonzero(keys[0] == bucket)[0])
        text, words, roots = group.column("text").to_pylist(), {}, group.column("root").to_pylist()
        up = {r: r for r in roots}

        def top(r):
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        counts, size = np.zeros((n, BINS), np.int32), np.zeros(n, np.int64)

        def of(k):
            if k not in words:
                words[k] = _word_hashes(text[k], hasher)
                counts[k], size[k] = np.bincount((words[k] % np.uint64(BINS)).astype(np.int64), minlength=BINS), len(words[k])
            return words[k]

        out, right = [], np.flatnonzero(own == y)
        for i in np.flatnonzero(own == x).tolist():
            j = right[right > i] if x == y else right
            j = j[root[j] != root[i]]
            if which and len(j):
                j = j[~(keys[j, :which] == keys[i, :which]).any(axis=1)]
            for k in (i, *j.tolist()) if len(j) else ():
                of(k)
            j = j[may_be_near(counts[i], counts[j], similarity)]
            for k in j[np.argsort(np.abs(size[j] - size[i]), kind="stable")].tolist():
                if top(roots[i]) != top(roots[k]):
                    a, b = of(i), of(k)
                    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
                    if edits(a, b, most) <= most:
                        up[top(roots[i])] = top(roots[k])
                        out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
        return out

    @lean
    def verify(batches):
        hasher, made, kind = WordHasher(), [], None
        for group in runs_of(batches, ["bucket", "x", "y"]):
            kind = group.schema.field("doc_id").type
            if group.num_rows > 1:
                made += links(group, hasher)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in made], kind) for k in (0, 1)], ["a", "b"])

    kind = members.schema["doc_id"].dataType.simpleString()
    dealt = dealt.select("bucket", "x", "y", "own", "doc_id", "root", "keys", "text").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return dealt.mapInArrow(verify, f"a {kind}, b {kind}").distinct()


def dealt_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``members`` dealt into pairs of blocks (x, y) of their buckets, about ``block`` members each by a hash (``own``). A member of a bucket of B
    goes to B / block groups, and no group holds many more than two blocks. A component that is larger than half a block has blocks of its own, the
    last ones, which don't meet each other: its members go to as many groups as the rest of the bucket has blocks."""
    members = stored(members, "members")
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("large"))
    alone = (F.col("n") > block) & (F.col("large.n") > block // 2)
    of = lambda n: F.ceil(n / block).cast("int")
    sizes = sizes.select("bucket", F.when(alone, F.col("large.root")).alias("large"), of(F.when(alone, F.col("n") - F.col("large.n")).otherwise(F.col("n"))).alias("rest"), F.when(alone, of(F.col("large.n"))).otherwise(0).alias("more"))
    dealt = dealt_join(members, stored(sizes, "sizes"), "bucket").withColumn("is_large", F.coalesce(F.col("root") == F.col("large"), F.lit(False)))
    dealt = dealt.withColumn("own", F.when(F.col("is_large"), F.col("rest") + F.expr("pmod(xxhash64(doc_id), more)")).otherwise(F.expr("pmod(xxhash64(doc_id), rest)")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") - 1 + F.when(F.col("is_large"), 0).otherwise(F.col("more")))))
    return dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("large", "rest", "more", "is_large", "other")


def _links(docs: DataFrame, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's text (doc_id, version, node), each text's first row (node, doc_id, version), and the links (a, b) of texts; all stored."""
    rows = id_text(docs, id_col, text_col).filter("doc_id is not null").withColumn("version", F.xxhash64("text")).select("doc_id", "version", "text")
    signed = stored(_sketched(rows).withColumn("same", F.struct("h1", "h2", "n")).drop("h1", "h2"), "sketches")
    group = signed.groupBy("same").agg(F.min(F.struct("doc_id", "version")).alias("head"))
    group = stored(group.select("same", "head.*", F.monotonically_increasing_id().alias("node")), "texts")
    copies = stored(dealt_join(signed.select("doc_id", "version", "same"), group.select("same", "node"), "same").drop("same"), "copies")
    heads = stored(signed.filter("n > 0").select("doc_id", "version", "keys").join(group.select("doc_id", "version", "node"), ["doc_id", "version"]).dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "keys"), "heads")
    repeated = not signed.groupBy("doc_id", "version").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    release(signed)
    first = group.select("node", "doc_id", "version")

    def texts(nodes: DataFrame) -> DataFrame:
        """doc_id (a node), text."""
        wanted = small(stored(first.join(nodes, "node"), "wanted"))
        found = rows.join(wanted, ["doc_id", "version"]).select(F.col("node").alias("doc_id"), "text")
        return stored(found.dropDuplicates(["doc_id"]) if repeated else found, "wanted-texts")

    # One partner each: the first of most of its buckets.
    buckets = stored(heads.select("doc_id", F.explode("keys").alias("bucket")), "buckets")
    firsts = buckets.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = stored(dealt_join(buckets, stored(firsts, "firsts"), "bucket"), "shared")  # rows of buckets with company
    release(buckets)
    partner = shared.filter("first <> doc_id").groupBy("doc_id", "first").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("a"))
    pairs = stored(partner.select("a", F.col("doc_id").alias("b")), "partners")
    held = texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    links = stored(verified(pairs, held, similarity), "links")
    release(held)
    members = apart(shared.select("bucket", "doc_id"), components(links)).join(heads, "doc_id")
    members = stored(members, "members")
    more = stored(_met(members, texts(members.select(F.col("doc_id").alias("node")).distinct()), similarity), "links")
    return copies, group.select("node", "doc_id", "version"), links.unionByName(more)


def near_links(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b: verified pairs of different texts' first ids. They join all that is near: classes are their connected components."""
    _, first, links = _links(docs, similarity, id_col, text_col)
    a, b = first.select(F.col("node").alias("a"), F.col("doc_id").alias("one")), first.select(F.col("node").alias("b"), F.col("doc_id").alias("two"))
    return dealt_join(dealt_join(links, a, "a"), b, "b").select(F.col("one").alias("a"), F.col("two").alias("b"))


def _classes(docs: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, version, copy_of, and ``head``, the class's first (doc_id, version), of every row that has an id."""
    copies, first, links = _links(docs, similarity, id_col, text_col)
    named = stored(first.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    heads = stored(named.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("head")), "classes")
    known = stored(dealt_join(named, heads, "root").select("node", F.col("doc_id").alias("copy_of"), "head"), "known")
    return dealt_join(copies, known, "node").drop("node")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its class), copy_of (the least id with the same words) of every row; both null where the id is."""
    out = _classes(docs, similarity, id_col, text_col).select("doc_id", F.col("head.doc_id").alias("class_id"), "copy_of")
    none = id_text(docs, id_col, text_col).filter("doc_id is null")
    return out.unionByName(none.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of")))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row (by id) of each class of ``docs``; one where that is repeated. Rows without an id stay."""
    classes = stored(_classes(docs, similarity, id_col, text_col).select("doc_id", "version", "head"), "row-classes")
    id_name, version = (free_name(docs, n) for n in ("__id", "__version"))
    gone = classes.filter((F.col("doc_id") != F.col("head.doc_id")) | (F.col("version") != F.col("head.version"))).select(F.col("doc_id").alias(id_name), F.col("version").alias(version)).distinct()
    rows = docs.withColumn(id_name, F.col(id_col)).withColumn(version, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = rows.join(small(stored(gone, "gone")), [id_name, version], "left_anti")
    if not classes.groupBy("doc_id", "version").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        kept = kept.filter(F.col(id_name).isNotNull()).dropDuplicates([id_name, version]).unionByName(kept.filter(F.col(id_name).isNull()))
    return kept.select(*docs.columns)
