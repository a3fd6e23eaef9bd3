import random
import re

from corpus import SCHEMA, awkward_texts, rows

from fleetscope.llm.pii_spans import BASE, base_spans, crf_spans, find_personal_data, luhn, training_sentences, trained_weights
from fleetscope.llm.queries import op6_pii_spans

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text, digits = text or "", lambda s: re.sub(r"[^0-9]", "", s)
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(spans)


def test_base_spans_match_brute_force():
    rng = random.Random(9)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (415) 555 1234", "+49.", "é", " ", "12", ".", "-", "00000000255.1.1.1", "u@h.i@j.k"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert base_spans(text) == brute(text), text


def test_crf_recovers_held_out_entities():
    weights, right, total = trained_weights(), 0, 0
    for text, gold in training_sentences(300, seed=99):
        base = base_spans(text)
        found = {*base, *crf_spans(weights, text, base)}
        total += 1
        right += found == gold
    assert right / total > 0.9, right / total


def test_entities_with_words_of_letters_are_one_candidate():
    weights = trained_weights()
    ibans = ["GB29 NWBK 6016 1331 9268 19", "NL91 ABNA 0417 1643 00", "DE89 3704 0044 0532 0130 00", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    mails = ["jo.do [AT] firm [DOT] org", "jo (At) firm (dot) org", "x" * 90 + " [at] " + "y" * 90 + " [dot] org"]
    for entity, kind in [(e, 5) for e in ibans] + [(e, 0) for e in mails]:
        for before, after in (("", ""), ("please use ", " from now on"), ("some text, iban: ", ".\nNext line 12 (at) noon")):
            text = before + entity + after
            base = base_spans(text)
            assert (len(before), kind, len(before) + len(entity)) in [*base, *crf_spans(weights, text, base)], text


def test_documents_addresses_and_names():
    weights = trained_weights()
    for text, entity, kind in [
        ("her passport P4830192 has run out", "P4830192", 6),
        ("he lives 221 Baker Street since May", "221 Baker Street", 7),
        ("signed Dr. Maria Lopez in haste", "Dr. Maria Lopez", 8),
    ]:
        at = text.index(entity)
        assert crf_spans(weights, text, base_spans(text)) == [(at, kind, at + len(entity))], text
    for text in ("the item KM202131 is sold out", "12 Grand Royal trains left", "Mr and Mrs went home", "in 1984 Orwell wrote"):
        assert crf_spans(weights, text, base_spans(text)) == [], text


def test_long_texts_take_time_in_proportion():
    """Many base spans and one long unbroken stretch; twice the text takes about twice the time."""
    import time

    weights = trained_weights()

    def seconds(n):
        text = "mail a.b@c.de or 555-123-4567 now " * n + "1-" * n + "x" * 50 * n
        began = time.process_time()
        base = base_spans(text)
        found = crf_spans(weights, text, base)
        assert len(base) >= n and len(found) >= n
        return time.process_time() - began

    seconds(200)
    assert seconds(4000) < 6 * seconds(1000) + 0.5


def test_query_and_awkward_rows(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op6_pii_spans(spark, sf_dir).collect():
        base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[1] for s in base) for k in range(4))
        assert {f"{BASE[k]}:{s}:{e}" for s, k, e in base} <= set(r.spans.split(","))
    data = rows(awkward_texts())
    for r in find_personal_data(spark.createDataFrame(data, SCHEMA)).collect():
        assert [tuple(s) for s in r.base] == brute(data[r.doc_id][1])
    assert find_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
