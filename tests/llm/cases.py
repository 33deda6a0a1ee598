"""Small documents with nulls, empty and long texts, ties, repeats and columns with clashing names."""

import itertools

SCHEMA = "doc_id long, text string, lang string, row string, size string, n string, token string, slot string, kept string, length string, gone string"


def rows(texts):
    """texts: (doc_id, text) pairs."""
    return [(d, t, *["x"] * 9) for d, t in texts]


def table(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def words(seed, n):
    state = seed * 7919 + 13
    out = []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append("w%d" % (state % 5000))
    return out


def odd():
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    long = words(2, 6000)
    return [
        (1, None), (2, ""), (3, "   \n "), (4, "One"), (5, "one"), (6, "two words"), (7, " ".join(base)), (8, " ".join(base)), (9, " ".join(near)),
        (9, " ".join(near)), (10, " ".join(long)), (11, " ".join(long[:5990] + ["tail"])), (None, " ".join(base)), (12, "ÄÖ ß <|endoftext|> don't ’tis 中文"), (13, " ".join(itertools.repeat("same", 300))),
    ]
