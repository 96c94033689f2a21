"""Documents that are hard on operators: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

WORDS = [a + b + c for a in ("be", "ta", "mo", "ri") for b in ("lan", "sto", "ver", "qu") for c in ("do", "é", "x", "ng")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASH = ("id", "key", "h", "n", "fp", "component_id", "node", "row", "rank", "size", "target", "taken", "kept", "part", "__id", "__c0", "a.b", "found_mask", "all_spans", "masked", "score", "chunk")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=1, n=40):
    """Tuples of SCHEMA."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = ".\n".join(sentence(rng, rng.randint(4, 30)) for _ in range(rng.randint(1, 8)))
        rows.append((i, text, rng.choice(["en", "de"]), f"src{rng.randint(0, 3)}"))
    long = sentence(rng, 60)
    rows += [
        (n, None, "en", "src0"),
        (n + 1, "", "en", None),
        (n + 2, " \n\t ", None, "src1"),
        (n + 3, rows[3][1], "en", "src0"),  # a copy
        (n + 4, rows[3][1] + " " + sentence(rng, 1), "en", "src0"),  # a near copy
        (n + 5, f"{sentence(rng, 20)} {long} {sentence(rng, 20)}", "de", "src2"),
        (n + 6, f"{sentence(rng, 3)} {long}", "de", "src2"),
        (n + 7, "Hello TEST one", "en", "src3"),
        (n + 8, " ".join(["same words again"] * 40), "en", "src3"),
        (n + 9, sentence(rng, 6000), "de", "src3"),  # a long one
        (n + 10, "mail jo.x@ex-a.org. or +1 (555) 555-0199, 10.0.0.1 and 4111 1111 1111 1111 é 😀 x@y a@b.c_d@e.f 999.1.1.1", "en", "src0"),
        (n + 11, "*** ### $$$ " * 30, "en", "src1"),
    ]
    rows.append(rows[5])  # a repeated row
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def frame(spark, rows=None, clash=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH))) if clash else df
