"""Small tables with the awkward rows that every operator must take."""

import random

LONG = " ".join(f"wort{i * i % 997} punkt," for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, bands string, row string"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def rows() -> list[tuple]:
    texts = [
        prose(120, 1), prose(120, 1), prose(120, 2), None, "", "   \n\t", "one", "one two three", prose(60, 3) + "\n" + "same line here\n" * 30,
        "ÄÖÜ straße ñandú 日本語 🙂 don't", "  x　", "a" * 70_000, " " * 9_000 + "x", LONG, "<|endoftext|> text", prose(120, 4),
    ]
    out = [(k, t, "en" if k % 2 else None, f"src{k % 3}" if k % 5 else None, None, 1, "x", "y") for k, t in enumerate(texts)]
    return [*out, out[0], (None, prose(80, 5), "en", "src0", 3, 2, "x", "y"), (None, None, None, None, None, None, None, None)]


def table(spark, part=None):
    return spark.createDataFrame(rows() if part is None else part, SCHEMA)
