import random

WORDS = ["alpha", "Beta", "gamma", "DELTA", "eps", "zéta", "漢字", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", "\n"]) if rng.random() < 0.1 else "") for _ in range(n))


def documents(spark, rows, extra=True):
    """Rows (doc_id, text); with columns whose names clash with inner ones."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    return spark.createDataFrame([(i, t, 1, "h", None, "d") for i, t in rows], "doc_id bigint, text string, fp bigint, h string, n bigint, digest string")


def tricky(rng=None):
    """Documents with nulls, empties, long texts, ties and repeated rows."""
    rng = rng or random.Random(1)
    rows = [(i, text(rng, rng.randrange(1, 60))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "  \n "), (43, rows[3][1]), (44, rows[3][1].upper()), (45, text(rng, 5000)), (None, rows[4][1]), (46, None)]
    rows += [rows[5], rows[5], (47, rows[6][1] + " extra")]
    return rows
