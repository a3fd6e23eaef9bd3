"""Small corpora with the awkward cases, and plain-Python references."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, hash string"


def rows(texts, langs=("en", None), sources=("a", "b", None)):
    """Rows with extra columns whose names clash with the operators' own."""
    return [
        (i, t, langs[i % len(langs)], sources[i % len(sources)], len(t or ""), "extra", "extra")
        for i, t in enumerate(texts)
    ]


def awkward_texts(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "Gamma", "d", "é", "ümlaut", "x#", "12", "😀", "a|b"]
    texts = [None, "", " ", "\t\n", "one", "one", " one ", "a b c d", "a  b\nc\td", "x" * 5000, "w " * 3000]
    for _ in range(n):
        k = rng.choice([1, 3, 5, 8, 20, 60, 200])
        words = [rng.choice(vocabulary) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(k)]
        if rng.random() < 0.4:
            words += words[: rng.randrange(1, 40)]
        seps = [" ", "  ", "\n", "\t", "\x0b"]
        texts.append("".join(w + rng.choice(seps) for w in words))
    texts += texts[-10:]
    return texts
