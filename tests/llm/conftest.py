import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SYLLABLES = {"en": ["th", "er", "ing", "and", "on", "re"], "de": ["sch", "ein", "ung", "heit", "ver", "ß"], "fr": ["eau", "oi", "ment", "é", "qu", "aux"]}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, component string, _hash string"


def prose(rng, lang, words):
    out = []
    for k in range(words):
        w = "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
        out.append(w.capitalize() + ("." if rng.random() < 0.2 else "") if rng.random() < 0.15 else w)
        out.append("\n" if rng.random() < 0.05 else " ")
    return "".join(out).strip()


def rows(n=160, seed=5):
    """Documents with copies, near copies, shared lines and passages, junk, secrets, and odd rows."""
    rng = random.Random(seed)
    passage = prose(rng, "en", 60).replace("\n", " ")
    texts = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        x = prose(rng, lang, rng.choice([3, 20, 80, 200]))
        kind = k % 8
        if kind == 1 and texts:
            x, lang = texts[-1]
        elif kind in (2, 3) and texts:
            x, lang = texts[max(0, len(texts) - 2)]
            w = x.split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            x = " ".join(w)
        elif kind == 4:
            x = x + "\n" + passage + "\n" + x[:30]
        elif kind == 5:
            x = " ".join([rng.choice(["Foo", "BAR!!", "x***"])] * rng.randint(20, 90))
        elif kind == 6:
            x = f"{x} password={'a1' * rng.randint(3, 12)} AKIA{'Z9' * rng.randint(4, 9)} {'0f' * rng.randint(6, 12)} https://host.example/x token: 'Zk93jd0Q-x'"
        texts.append((x, lang))
    out = [(k, x, lang, f"src{k % 3}", len(x)) for k, (x, lang) in enumerate(texts)]
    odd = [None, "", " \n\t ", "a", "one two three four", "\n\n", "<|endoftext|> x", "é" * 50 + "\n" + "É" * 50, "tab\tsplit\x0bwords\x0chere\r\n" * 8, "long " * 30_000, "y" * 20_000, "don't  stop now 𝕏 1² it's", passage]
    out += [(n + k, x, None, None, None) for k, x in enumerate(odd)]
    out += [out[3], out[3], (None, "null id " * 9, "en", None, None), (None, passage, None, None, 1), (-7, out[1][1], "en", "s", 2)]
    return [(*r, 0.5, "clash", "clash") for r in out]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows(), DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def pairs(documents):
    """Distinct (doc_id, text) with an id."""
    return sorted({(r[0], r[1]) for r in documents.select("doc_id", "text").collect() if r[0] is not None}, key=lambda r: r[0])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
