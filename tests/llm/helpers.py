"""Small tables with everything that is awkward."""

import random

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, h string, fp long, bin int, spans string, target double, id string, __group string"


def awkward(spark, n=60, seed=3):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["élan", "straße", "日本"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 30, 80])))
        rows.append([i, text, "en", f"s{rng.randrange(4)}", len(text)])
    rows[1][1], rows[2][1], rows[3][1], rows[4][1] = None, "", " \t\n", None
    rows[5][0], rows[6][0], rows[7][3], rows[8][3] = None, None, None, None
    rows[9][1] = " ".join(rng.choice(words) for _ in range(9000))
    rows[10] = [None] * 5
    rows += [list(rows[20])] * 4 + [[100 + i, rows[21][1], "en", "s1", 1] for i in range(6)]
    return spark.createDataFrame([tuple(r) + (7, 1, "x", 5, 2, "y", 0.5, "z", "g") for r in rows], EXTRA)


def nothing(spark):
    return spark.createDataFrame([], EXTRA)
