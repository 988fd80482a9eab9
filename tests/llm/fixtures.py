"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghiklmnoprstuw") for _ in range(r.randrange(2, 9))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        start = i == 0 or out[-1].endswith(".")
        out.append((w.capitalize() if start else w) + ("." if r.random() < 0.1 else ""))
    return " ".join(out)


def odd_documents(spark):
    """Documents with every awkward case, and an extra column whose name clashes in another case."""
    base, passage = prose(300, 1), prose(70, 2) + "."
    rows = [
        (1, base), (2, base), (3, base.replace(base.split()[150], "changed", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "One two"), (7, "One two"),
        (8, prose(40, 3) + ".\n" + passage + "\n" + prose(30, 4)), (9, prose(50, 5) + ". " + passage + " " + prose(30, 6)), (None, prose(25, 7)), (10, "word " * 30_000),
        (11, "é à ü " * 20 + prose(30, 8)), (12, "Released under the MIT License.\n" + prose(30, 9)), (13, "#$% " * 40), (14, "THE END!! " * 15),
    ]
    df = spark.createDataFrame([(i, t, None if i == 5 else "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.selectExpr("*", "'x' AS N_TOKENS", "1 AS Component_Id", "2 AS kept", "3 AS _row", "4 AS score", "5 AS removed_units")


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
