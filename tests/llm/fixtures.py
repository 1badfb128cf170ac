"""Small documents with what real tables have: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

WORDS = "the of and light river stone under morning walked slowly nobody remembers green hills beyond seven doors opened quietly while rain fell harder than before".split()
SCHEMA = "doc_id long, text string, lang string, source string, score double, bad int, taken int, start long, h long, id int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        s = [r.choice(WORDS) + r.choice(["", "", r.choice("abcdefgh") * r.randint(1, 3)]) for _ in range(r.randint(3, 14))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
        if r.random() < 0.3:
            out[-1] += "\n"
    return " ".join(out[:n])


def documents(extra: list[tuple] = ()) -> list[tuple]:
    """(doc_id, text, lang, source) rows."""
    rows = [(i, prose(i, 30 + 7 * (i % 9)), ("en", "de")[i % 2], f"s{i % 5}") for i in range(40)]
    passage = prose(999, 60)
    rows += [(100 + i, f"{prose(200 + i, 12)} {passage} {prose(300 + i, 9)}", "en", "s1") for i in range(4)]
    rows += [(200 + i, rows[3][1], "de", f"s{i}") for i in range(5)]  # copies
    rows += [(300, None, "en", "s1"), (301, "", None, None), (302, " \n\t ", "en", None), (303, "!!! 123 ???", "de", "s2"), (304, "one", "en", "s3"), (305, "Two words", None, "s3")]
    rows += [(None, prose(5, 40), "en", "s0"), (None, None, None, None), (306, "word " * 20_000, "en", "s4"), (307, "x" * 60_000, "en", "s4"), (308, "naïve café ☕ über 漢字 " * 40, "de", "s0")]
    rows += [(309, prose(309, 50), "en", "s2")] * 2  # a repeated row
    return rows + list(extra)


def frame(spark, rows=None):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3, 4, 5) for r in (documents() if rows is None else rows)], SCHEMA)
