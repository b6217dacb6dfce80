"""Small documents with copies, near copies, shared passages, odd rows and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, shard int, `key` string, task int, _score string, _lines int, rank string"


def texts(seed: int = 1, n: int = 40) -> list[tuple]:
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "ba ke lo mi nu sé tu".split() for b in "rin sol ta vex zo".split()]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, line = say(70), "All rights reserved."
    rows = []
    for i in range(n):
        t = say(r.randint(30, 120))
        if i % 5 == 0:
            t += "\n" + passage
        if i % 3 == 0:
            t += "\n  " + (line if i % 2 else line.upper())
        rows.append((i + 10, t))
    base = rows[3][1]
    rows += [(100 + k, base) for k in range(4)]
    rows += [(200 + k, base.replace(base.split()[5], "changed", 1)) for k in range(3)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one two"), (304, "one two"), (305, "\n" * 5), (306, "a" * 3000), (307, "It's <|endoftext|> '' 've £ 中文 😀 x"), (None, base), (None, None), (308, say(9000)), (310, base), (310, base)]
    return rows


def frame(spark, rows: list[tuple] | None = None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(d, t, "en", "src", None, "x", 1, None, 2, "s", 3, "r") for d, t in rows], SCHEMA)
