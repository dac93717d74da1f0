"""Small documents with copies, near copies, shared passages, odd characters and missing values."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(n):
        kind = i % 10
        own = [rng.choice(words) for _ in range(rng.randint(25, 160))]
        if kind == 3 and i > 10:
            texts.append(texts[i - 10])
        elif kind == 4 and i > 10:
            copy = texts[i - 11].split(" ") if texts[i - 11] else own
            copy[len(copy) // 2] = "changed"
            texts.append(" ".join(copy))
        elif kind == 5:
            texts.append(" ".join(own[:20]) + "\n" + passage + "\n" + " ".join(own[20:]))
        elif kind == 6:
            texts.append("\n".join([" ".join(own[:12])] * 9))
        else:
            texts.append(" ".join(own))
    texts += ["", None, " \t\n", "one", "One TWO", "<|endoftext|> I'm 2 ½ ﬁ́", "x" * 5000, "na " * 3000]
    return [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows=None):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
