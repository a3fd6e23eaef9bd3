import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from corpus import SCHEMA, awkward_texts, rows

from fleetscope.llm.queries import op13_sequence_packing
from fleetscope.llm.sequence_packing import WordCoder, _Search, best_fit, least_sequences, pack_documents, pack_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
EXACT = tokenizers.Tokenizer.from_file(PATH)


def counted(lengths, limit):
    return np.bincount(lengths, minlength=limit + 1).tolist()


def fewest(lengths, limit):
    """Smallest number of sequences by exhaustive search."""

    @cache
    def least(rest):
        if not rest:
            return 0
        first, others = rest[0], rest[1:]
        best = len(rest)
        for subset in range(1 << len(others)):
            inside = [x for k, x in enumerate(others) if subset >> k & 1]
            if first + sum(inside) <= limit:
                best = min(best, 1 + least(tuple(x for k, x in enumerate(others) if not subset >> k & 1)))
        return best

    return least(tuple(sorted(lengths, reverse=True)))


def check(sequences, lengths, limit):
    assert Counter(x for s in sequences for x in s) == Counter(lengths)
    assert all(0 < sum(s) <= limit for s in sequences)


def test_small_packings_are_optimal():
    rng = random.Random(4)
    for _ in range(150):
        limit = rng.choice([7, 10, 20, 50])
        lengths = [rng.randrange(1, limit + 1) for _ in range(rng.randrange(1, 10))]
        sequences = pack_lengths(counted(lengths, limit), limit)
        check(sequences, lengths, limit)
        assert len(sequences) == fewest(lengths, limit)
        assert least_sequences(counted(lengths, limit), limit) <= len(sequences)


def test_search_beats_best_fit():
    rng = random.Random(6)
    instances = [counted([rng.randrange(10, 60) for _ in range(12)], 100) for _ in range(200)]
    gained = [len(best_fit(c, 100)) - len(pack_lengths(c, 100)) for c in instances]
    assert min(gained) >= 0 and sum(gained) >= 10


def test_large_packings_are_close_to_the_bound():
    rng = np.random.default_rng(2)
    apart = rng.integers(500, 1100, 4000).tolist()
    for shape in (np.minimum(2047, rng.lognormal(6.5, 1, 4000)), np.array(apart), rng.integers(1, 60, 4000), rng.integers(670, 680, 300)):
        lengths = np.maximum(1, shape.astype(int)).tolist()
        counts = counted(lengths, 2048)
        sequences = pack_lengths(counts, 2048)
        check(sequences, lengths, 2048)
        assert len(sequences) <= len(best_fit(counts, 2048))
        if lengths != apart:  # two or three of these fill a sequence, which the bound does not know
            assert len(sequences) <= 1.01 * least_sequences(counts, 2048) + 1


def test_dominated_fillings():
    search = _Search(counted([9, 5, 4, 3, 1, 1], 12), 12)
    assert search.dominated([3], 1)  # 4 fits in its place
    assert search.dominated([3, 1], 0)  # 4 instead of both
    assert not search.dominated([5], 0)
    search = _Search(counted([9, 4, 3, 1], 12), 12)
    assert search.dominated([1], 1) is False and search.dominated([], 1)  # 1 fits beside
    search.best = [[]] * 3
    search.take(9)
    assert list(search.fillings(3)) == [([3], 0)]
    search.take(3)
    assert list(search.fillings(5)) == [([4, 1], 0)]


def brute(text, limit):
    ids = [*EXACT.encode(text or "", add_special_tokens=False).ids, 0]
    return [(k, i, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, i in enumerate(range(0, len(ids), limit)) if (p := ids[i : i + limit])]


def assert_packed(got, limit):
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


TEXTS = ["Caf\u00e9 CAFE\u0301 \u03a3\u0391\u03a3 don't I'LL", "a\u00a0b\u2003c\x1cd\x85e", "<|endoftext|> and <|startoftext|>x", "\u0301 lone mark", "12345 $$$!?", "word " * 5000, "x" * 9000]


def test_words_encode_as_the_whole_tokenizer():
    coder = WordCoder(open(PATH, encoding="utf-8").read())
    assert coder.by_words
    rng = random.Random(5)
    letters = "aZ\u00c9\u00e9\u00df\u00d7\u00f7\u00aa\u00b51\u00b2'sdt.,$<|>/w \n\t\r\x0b\x00\x1c\u0085\u00a0\u0301\u03a3\u0130\u4e2d\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)] + [*TEXTS, "a</w>b </w>", "'S it'S don'T 'll'VE"]
    ids, first = coder.encode(texts)
    for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert ids[a:b].tolist() == EXACT.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("limit,block", [(2048, 4000), (64, 20)])
def test_pieces_and_packing(spark, limit, block):
    data = rows(TEXTS + awkward_texts())
    got = pack_documents(spark.createDataFrame(data, SCHEMA).repartition(3), PATH, limit=limit, block=block).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((i, *p) for i, t, *_ in data for p in brute(t, limit))
    n = assert_packed(got, limit)
    bound = -(-sum(r.length for r in got) // limit)
    assert n <= bound + max(2, bound // 50)


def test_ids_are_kept_on_request(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, None), (7, "three")], "doc_id long, text string")
    got = pack_documents(df, PATH, keep_ids=True).collect()
    assert sorted(r.ids for r in got) == sorted([*EXACT.encode(t or "", add_special_tokens=False).ids, 0] for t in ("one two", "one two", None, "three"))
    assert assert_packed(got, 2048) == 1
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_equal_rows_spread_over_blocks(spark):
    df = spark.range(3000).selectExpr("5L AS doc_id", "'the same words in every row' AS text")
    got = pack_documents(df, PATH, limit=64, block=300).collect()
    length = got[0].length
    assert len(got) == 3000 and assert_packed(got, 64) <= -(-3000 // (64 // length)) + 1


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op13_sequence_packing(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((i, *p) for i, t in texts.items() for p in brute(t, 2048))
    assert assert_packed(got, 2048) == -(-sum(r.length for r in got) // 2048)
