import random

import public_tokenizers
import sentencepiece
from corpus import SCHEMA, awkward_texts, rows
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from fleetscope.llm.queries import op4_token_counts
from fleetscope.llm.token_counts import CountViterbi, count_tokens, read_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def exact():
    """The tokenizer library itself, told to read the vocabulary as a unigram model."""
    proto = model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_never_below_the_library_and_equal_where_scores_are():
    counter, library = CountViterbi(read_pieces(PATH)), exact()
    score, same = dict(read_pieces(PATH)), 0
    rng = random.Random(2)
    for _ in range(3000):
        text = " ".join("".join(rng.choice("aeinorstlh") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6)))
        theirs = library.encode(text, out_type=str)
        n, ours = counter.count(text)
        assert ours >= sum(score[p] for p in theirs), text
        if ours == sum(score[p] for p in theirs):
            same += 1
            assert n == len(theirs), text
    assert same > 2000


def brute(pieces, text):
    """All segmentations by a plain left-to-right programme over the whole text."""
    score = {}
    for piece, value in pieces:
        score[piece] = value
    unknown = min(score.values()) - 10
    text = "▁" + text.replace(" ", "▁") if text else ""
    best = [(0.0, 0)] + [None] * len(text)
    longest = max(map(len, score))
    for start in range(len(text)):
        single = text[start] in score
        for end in range(start + 1, min(len(text), start + longest) + 1):
            piece = text[start:end]
            if piece in score:
                c = (best[start][0] + score[piece], best[start][1] + 1)
            elif end == start + 1 and not single:
                c = (best[start][0] + unknown, best[start][1] + len(piece.encode()))
            else:
                continue
            if best[end] is None or c[0] > best[end][0]:
                best[end] = c
    return best[-1][1], best[-1][0]


def test_ties_unknowns_and_whole_texts():
    pieces = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("▁▁", -5.0), ("bb", -1.5)]
    counter, rng = CountViterbi(pieces), random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("aabb \né") for _ in range(rng.randint(0, 14)))
        assert counter.count(text) == brute(pieces, text), text


def test_documents(spark):
    data = rows(awkward_texts())
    counter = CountViterbi(read_pieces(PATH))
    got = {r.doc_id: (r.n_tokens, r.score) for r in count_tokens(spark.createDataFrame(data, SCHEMA), PATH).collect()}
    assert got == {r[0]: counter.count(r[1] or "") for r in data}
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_query_on_the_whole_table(spark, sf_dir):
    """Every whole text against the plain programme, which looks at each start and each piece length."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = read_pieces(PATH)
    got = {r.doc_id: (r.n_tokens, r.score) for r in op4_token_counts(spark, sf_dir).collect()}
    assert sorted(got) == sorted(texts)
    for doc_id, text in texts.items():
        n, score = brute(pieces, text)
        assert got[doc_id][0] == n and abs(got[doc_id][1] - score) < 1e-6 * max(1.0, abs(score))
