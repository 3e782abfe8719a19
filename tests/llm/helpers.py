"""Small documents for every odd case."""

import random

LONG = " ".join(f"word{k % 977}" for k in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, shard int, bucket long, n int, words string"


def odd_rows():
    """Null, empty, blank, short, long and repeated texts, repeated rows, null columns; columns that clash with inner names."""
    rnd = random.Random(5)
    vocabulary = [a + b for a in "ka lo mi nu ré so tu".split() for b in "ba de fi go hu".split()]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, passage = prose(300), prose(60)
    near = base.split()
    near[40], near[200] = "changed", "words"
    texts = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: base, 6: base, 7: " ".join(near), 8: base.upper(), 9: LONG, 10: prose(20) + "\n" + passage + "\n" + prose(30), 11: passage + "\n" + prose(40), 12: prose(35) + "\n" + passage, 13: "日本語 テキスト <|endoftext|> é é ﬁ ½", 14: prose(80)}
    rows = [(i, t, None if i % 2 else "en", None, None, 0.5, "x", 1, 2, 3, "w") for i, t in texts.items()]
    return rows + [rows[4], rows[13]]  # the rows of 5 and 14 stand twice


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def texts(rows=None):
    return {r[0]: r[1] or "" for r in (odd_rows() if rows is None else rows)}
