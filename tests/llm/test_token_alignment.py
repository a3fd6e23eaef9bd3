import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from corpus import SCHEMA, awkward_texts, rows

from fleetscope.llm import token_alignment
from fleetscope.llm.queries import op12_token_alignment
from fleetscope.llm.token_alignment import CSR, TwoTokenizers, align_documents, byte_letters, runs_of, score_alignments

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = tokenizers.Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
LETTERS = byte_letters()
TEXTS = ["<|endoftext|> plain <s> text", "a\u2581b", "caf\u00e9 \ufb01 x\u00b2", "\u65e5\u672c\u8a9e and \U0001f600", "two  spaces ", "same same same", "same same same", "tab\tnew\nline", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30, "long words " * 3000]


def brute(texts):
    """Plain loops: per text the links, groups and pairs, then the counts of the whole."""
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        want = (" " + text).encode()
        a = A.encode(" " + text, add_special_tokens=False).ids
        b = B.encode(text)
        a_tokens = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
        b_tokens = [bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if b"".join(a_tokens) != want or b"".join(b_tokens) != want:
            found.append(None)
            continue
        spans = lambda tokens: [(sum(map(len, tokens[:k])), sum(map(len, tokens[: k + 1]))) for k in range(len(tokens))]
        if len(a) < 500:
            a_spans, b_spans = spans(a_tokens), spans(b_tokens)
        else:
            cum = lambda tokens: list(zip(np.cumsum([0, *map(len, tokens)])[:-1].tolist(), np.cumsum(list(map(len, tokens))).tolist(), strict=True))
            a_spans, b_spans = cum(a_tokens), cum(b_tokens)
        links, j = [], 0
        for i, (s, e) in enumerate(a_spans):
            while b_spans[j][1] <= s:
                j += 1
            k = j
            while k < len(b_spans) and b_spans[k][0] < e:
                links.append((i, k, min(e, b_spans[k][1]) - max(s, b_spans[k][0])))
                k += 1
        cuts = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        groups, i, j = [], 0, 0
        for cut in cuts:
            one, other = [], []
            while i < len(a) and a_spans[i][1] <= cut:
                one.append(a[i])
                i += 1
            while j < len(b) and b_spans[j][1] <= cut:
                other.append(b[j])
                j += 1
            groups.append((one, other))
        found.append((a, b, links, groups))
    counts = Counter((f[0][i], f[1][j]) for f in found if f for i, j, _ in f[2])
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, "", 0, 0))
            continue
        a, b, links, groups = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        linked = [counts[a[i], b[j]] for i, j, _ in links]
        best = sum(counts[a[i], b[j]] == highest[b[j]] for i, j, _ in links)
        out.append((len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), text, best, sum(linked)))
    return found, out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "n_best", "count_sum")


@pytest.mark.parametrize("run,chunk", [(1_000_000, 8_000_000), (300, 2_000)])
def test_matches_brute_force(spark, monkeypatch, run, chunk):
    monkeypatch.setattr(token_alignment, "RUN", run)
    monkeypatch.setattr(token_alignment, "CHUNK", chunk)
    data = rows(TEXTS + awkward_texts())
    _, expected = brute([r[1] for r in data])
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in score_alignments(spark.createDataFrame(data, SCHEMA), A_PATH, B_PATH).collect()}
    assert got == dict(enumerate(expected))


def test_links_and_groups(spark):
    data = rows(TEXTS + awkward_texts()[:30])
    found, expected = brute([r[1] for r in data])
    got = align_documents(spark.createDataFrame(data, SCHEMA), A_PATH, B_PATH)
    assert got.columns[-4:] == ["a_ids", "b_ids", "links", "groups"]
    for r in got.collect():
        a, b, links, _ = found[r.doc_id] or ([], [], [], [])
        assert (r.a_ids, r.b_ids, [tuple(x) for x in r.links], r.groups) == (a, b, links, expected[r.doc_id][5])


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "x y"), (None, "x y"), (4, "x y"), (4, None)], "doc_id long, text string")
    got = score_alignments(df, A_PATH, B_PATH).collect()
    assert sorted((r.doc_id is None, *(r[c] for c in COLUMNS)) for r in got) == sorted((i is None, *e) for i, e in zip([None, None, 4, 4], brute(["x y", "x y", "x y", None])[1], strict=True))
    assert score_alignments(df.limit(0), A_PATH, B_PATH).count() == 0
    assert score_alignments(df.where("text is null"), A_PATH, B_PATH).count() == 1


def test_products_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(3)
    for block in (1, 7, 4_000_000):
        monkeypatch.setattr(token_alignment, "BLOCK", block)
        for _ in range(40):
            n, m, k = rng.integers(1, 9, 3)
            dense = [rng.integers(0, 3, (n, m)) * (rng.random((n, m)) < 0.4), rng.integers(0, 3, (m, k)) * (rng.random((m, k)) < 0.4)]
            sparse = []
            for d in dense:
                row, column = np.nonzero(d)
                sparse.append(CSR(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(d)))]), column, d[row, column], d.shape[1]))
            out = np.zeros((n, k), int)
            for row, column, value in sparse[0].product(sparse[1]):
                out[row, column] += value
            assert (out == dense[0] @ dense[1]).all()
            assert (sparse[0].met(sparse[1]) == ((dense[0] > 0).astype(int) @ (dense[1] > 0).astype(int)).sum(1)).all()
            back = sparse[0].transposed()
            twice = back.transposed()
            assert (twice.columns == sparse[0].columns).all() and (twice.values == sparse[0].values).all() and back.height == m


def test_byte_letters():
    assert sorted(LETTERS.values()) == list(range(256))
    coder = TwoTokenizers(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    assert coder.a_bytes[A.encode(" the", add_special_tokens=False).ids[0]] == b" the"


def test_runs_keep_every_row():
    import pyarrow as pa

    column = pa.array(["a" * 5, None, "b" * 20, "", "c" * 3, "d" * 3])
    assert list(runs_of(column, 8)) == [(0, 2), (2, 3), (3, 6)]
    assert list(runs_of(pa.array([], pa.string()), 8)) == []


def test_query_columns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    _, expected = brute([texts[i] for i in ids])
    got = {r.doc_id: r for r in op12_token_alignment(spark, sf_dir).collect()}
    assert sorted(got) == ids
    for i, e in zip(ids, expected, strict=True):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_shared, r.n_best, r.count_sum) == (*e[:5], *e[6:])
        assert r.groups_sha256 == (hashlib.sha256(e[5].encode()).hexdigest() if e[5] else "")
