"""Small tables with the odd cases that every operator must take."""

LONG = " ".join(f"word{k % 977} tail{k}" for k in range(30000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from the slow old cat that sleeps by the warm fire all day long",
    "The quick brown fox jumps over the lazy dog and runs away from the slow old cat that sleeps by the warm fire all day long",
    "THE quick brown fox jumps over the lazy dog and runs away from the slow old cat that sleeps by the warm fire all day long",
    "", "", None, None, "one", "two words", "a b c", "été naïve ÉTÉ straße 中文 字 😀 mixed", " \t\n ", "x  y\n\n z   w", LONG, LONG + " more", "<|endoftext|> a <|endoftext|>  b",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size long, extra string, seen int, count int, row string, key string, at int, pattern string, hash long"


def documents(spark, texts=TEXTS):
    """Null ids, repeated rows, null sources, and columns whose names operators use themselves."""
    rows = [(k if k % 7 != 5 else None, t, "en", f"s{k % 3}" if k % 5 else None, None, 0.5, 1, 2, "e", 7, 8, "r", "k", 9, "p", 3) for k, t in enumerate(texts)]
    rows += rows[:2] + [rows[7]]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
