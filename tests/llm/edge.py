"""A small table with every awkward case, and brute-force versions of the operators."""

import random

WORDS = "the of and a in to is an for it ca da bo ti ra mu lo".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n long, class string, token string, label string, hits string, rank int, row string, left string"


def texts():
    r = random.Random(5)
    base = [" ".join(r.choices(WORDS, k=r.choice([3, 12, 40, 90]))) for _ in range(12)]
    near = []
    for _ in range(25):
        words = r.choice(base[4:8] + [" ".join(f"w{k}" for k in range(80))]).split()
        for _ in range(r.choice([1, 2, 5])):
            words[r.randrange(len(words))] = r.choice(WORDS)
        near.append(" ".join(words))
    passage = " ".join(f"p{k}" for k in range(30))
    return [*base, *near, base[5], base[5].upper(), base[5], "", None, " \t\n", "one", "One", "two words", f"x {passage} y", f"{passage} z\n{passage}", "é ü  ß\x0bpär t", "a-b'c <|endoftext|> 12,5 don't", "long " * 5000 + "tail", "%%% ### line\nline\nline"]


def documents(spark, extra=True):
    rows = [(k * 3 % 61, t, 7, "x", "y", "z", None, 1, "r", "l") for k, t in enumerate(texts())]
    rows += [rows[4], rows[4], (None, "null id with the words of the table and more", *rows[0][2:]), (0, "another text with the id zero", *rows[0][2:])]
    df = spark.createDataFrame(rows, SCHEMA)
    return df if extra else df.select("doc_id", "text")


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def space_words(text, lower=False):
    text = text or ""
    return [w.decode() for w in (text.translate(LOWER) if lower else text).encode().split()]


def key(row):
    return tuple((x is None, x) if not isinstance(x, (list, dict)) else (False, repr(x)) for x in row)
