"""Small document tables with the awkward cases: nulls, blanks, copies, ties, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n_words string, words int, line string, block int"


def sample_texts(seed: int = 5, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma", "déjà", "Éa", "über", "the", "of", "a", "x1", "foo-bar", "ñu", "😀", "co"]

    def prose(k: int) -> str:
        out = []
        for _ in range(k):
            out.append(rng.choice(vocabulary) if rng.random() < 0.5 else f"w{rng.randrange(400)}")
            out.append(rng.choice([" ", " ", " ", "\n", "\t ", "  "]))
        return "".join(out)

    texts: list[str | None] = [None, "", "   \n\t", "one", "one two three", "one two three", "!!!", "\n\n\n"]
    base = prose(120)
    shared = prose(40)
    for k in range(n):
        kind = k % 6
        if kind == 0:
            texts.append(prose(rng.randrange(5, 200)))
        elif kind == 1:
            words = base.split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(prose(30) + shared + prose(30))
        elif kind == 3:
            texts.append("same line here\nanother same line\nthird same line\n" + prose(20))
        elif kind == 4:
            texts.append("no no no no no no " * rng.randrange(2, 9) + prose(15))
        else:
            texts.append(base)
    return texts


def document_rows(texts: list[str | None]) -> list[tuple]:
    sources = ["a", "b", None, "c", "a", "a"]
    return [(k, text, "en", sources[k % 6], len(text or ""), True, "x", 3, "y", 9) for k, text in enumerate(texts)]


def documents(spark, texts=None, partitions: int = 3):
    rows = document_rows(sample_texts() if texts is None else texts)
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def by_id(df, key: str = "doc_id") -> dict:
    return {row[key]: row for row in df.collect()}
