import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm.packing import best_fit, pack, places, plan
from pagelake.llm.token_counts import token_counts, whole_tokens
from pagelake.llm.token_files import Block, pack_bits, read_document, read_token_files, unpack_bits, write_block, write_token_files
from pagelake.llm.tokenizing import Encoder

from .helpers import documents, odd_rows, texts

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module", params=[BYTE, WORD])
def enc(request):
    return Encoder(request.param, bound=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r'a'sdtrevmll1²é.-|$É<>İ日́\xa0 ", max_size=40), max_size=4))
def test_ids_are_the_librarys(texts):
    for path in (BYTE, WORD):
        e = _cached(path)
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in e.ids(texts)] == want


_encoders = {}


def _cached(path):
    return _encoders.setdefault(path, Encoder(path, bound=40))


def test_a_full_memo_changes_nothing(enc):
    rnd = random.Random(1)
    lines = [" ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(40)) for _ in range(30)]
    for line in lines:
        assert np.frombuffer(enc.ids([line])[0], "<u4").tolist() == enc.tokenizer.encode(line, add_special_tokens=False).ids


def test_whole_tokens_encode_alone_as_one():
    whole = whole_tokens(BYTE)
    e = _cached(BYTE)
    assert len(whole) > 40_000 and all(len(e.tokenizer.encode(t, add_special_tokens=False).ids) == 1 for t in list(whole)[:2000])


def test_counts(spark):
    e = _cached(BYTE)
    got = sorted(tuple(r) for r in token_counts(documents(spark), BYTE, limit=100).collect())
    want = []
    for r in odd_rows():
        n = len(e.tokenizer.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 100))
    assert got == sorted(want)
    assert token_counts(documents(spark, []), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.data())
def test_bits_round_trip(width, ids, data):
    ids = np.array([i % (1 << width) for i in ids], dtype=np.uint32)
    raw = pack_bits(ids, width)
    assert len(raw) == -(-len(ids) * width // 8)
    a = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - a))
    assert unpack_bits(raw, width, a, n).tolist() == ids[a : a + n].tolist()


def test_block_random_access():
    docs = [np.arange(5), np.array([7]), np.arange(300) % 31]
    b = Block(write_block(docs, 9))
    assert [b.document(k).tolist() for k in range(3)] == [d.tolist() for d in docs]
    with pytest.raises(ValueError):
        Block(b"none" + bytes(20))


def test_token_files(spark, tmp_path):
    e = _cached(WORD)
    write_token_files(documents(spark), str(tmp_path / "t"), WORD, shards=3, block_ids=500)
    at, want = 0, []
    for r in sorted(odd_rows(), key=lambda r: (r[0], r[1] or "")):
        ids = [*e.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in read_token_files(spark, str(tmp_path / "t")).collect()) == sorted(want)
    got = read_document(spark, str(tmp_path / "t"), 7)
    assert [g.tolist() for g in got] == [[*e.tokenizer.encode(texts()[7], add_special_tokens=False).ids, 2]]
    assert len(read_document(spark, str(tmp_path / "t"), 14)) == 2
    write_token_files(documents(spark, []), str(tmp_path / "none"), WORD)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
def test_plans_hold_every_piece_once(histogram):
    made = plan(histogram, 64)
    held = defaultdict(int)
    for pattern, times in made:
        assert sum(pattern) <= 64 and times > 0
        for n in pattern:
            held[n] += times
    assert held == histogram
    first = defaultdict(int)
    for n, rank, _, _ in zip(*places(made), strict=True):
        assert rank == first[n] or rank > first[n]
        first[n] = rank


def test_best_fit_is_best_fit():
    assert sorted(best_fit({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)) == [((5, 3, 2), 1), ((6, 4), 1)]


def test_packing(spark):
    e = _cached(BYTE)
    got = pack(documents(spark), BYTE, capacity=256).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append((r.start, r.length, r.ids_crc32, r.piece))
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t in texts().items():
        ids = [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]
        times = sum(r[0] == i for r in odd_rows())
        total += times * len(ids)
        head = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(head, len(ids) + 1, 256)]
        assert sorted(docs[i]) == sorted([(a, b - a, crc(ids[a:b]), k) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] * times)  # noqa: B905
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    assert len(sequences) <= -(-total // 256) + 3
    assert pack(documents(spark, []), BYTE).count() == 0
