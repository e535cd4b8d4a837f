"""Small documents with every odd case: nulls, blanks, repeated rows, a long text, clashing column names."""

from __future__ import annotations

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "score double, fp bigint, bucket int, key string, line string, row int, places string, chunk string, shard int"
)
WORDS = "the river ran past old stones while children sang of boats and bright windows under rain".split()


def prose(seed: int, words: int) -> str:
    """Invented text that depends on its number alone."""
    out, x = [], seed * 7919 + 17
    for i in range(words):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 16 & 15 if (x >> 16 & 15) < len(WORDS) else 0] + ("ing" if x >> 9 & 3 == 0 else ""))
        if i % 11 == 10:
            out[-1] += ".\n" if x >> 5 & 1 else ","
    return " ".join(out)


def documents() -> list[tuple[int | None, str | None]]:
    rows: list[tuple[int | None, str | None]] = [(i, prose(i, 30 + i % 50)) for i in range(1, 60)]
    rows += [
        (100, None), (101, ""), (102, " "), (103, "\n\n \t\n"), (104, "One"), (105, "one two"), (106, "Ünïcödé ÄÖ ▁ sign x"),
        (107, prose(5, 35)), (108, prose(5, 35)), (109, prose(5, 35).upper()), (110, prose(77, 6000)),
        (111, "x" * 3000), (112, "a  b   c \n d"), (113, "trailing  "), (114, "zero\x00byte \x1c end"),
        (2, prose(2, 32)), (2, prose(2, 32)), (3, "same id another text"), (None, "no id here"), (None, None),
    ]
    rows += [(200 + i, f"shared line of many\n{prose(300 + i, 12)}\n  Shared LINE of many\t") for i in range(12)]
    rows += [(300 + i, prose(9, 400) + f" tail{i}") for i in range(6)]
    return rows


def frame(spark, rows=None):
    """The documents as a frame with other columns whose names the operators use inside."""
    rows = documents() if rows is None else rows
    extra = (1.5, 7, 3, "k", "l", 1, "p", "c", 2)
    return spark.createDataFrame([(i, t, "en", "s", 5, *extra) for i, t in rows], SCHEMA).repartition(3)
