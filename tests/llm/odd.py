"""Odd tables that every operator must take: nulls in all columns, empty and long texts, ties, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "A" * 50_000


def rows():
    plain = [(i, f"The number {i} of the house and the street is what they say it was.\nShared line of all.\n" + "and so on " * (i % 7), "en", f"s{i % 3}", 10) for i in range(30)]
    french = [(100 + i, f"Le chat {i} de la maison est dans la rue avec des amis et une fleur.\nShared line of all.", "fr", f"s{i % 3}", 10) for i in range(30)]
    odd = [
        (None, None, None, None, None), (None, "text without id", None, "s1", None), (7, None, "en", "s1", 0), (200, "", "en", None, 0), (201, "", None, "s2", None),
        (202, "   \n\n ", "fr", "s2", 5), (203, "12345 !!! ###", "en", "s0", 3), (204, LONG, "en", "s0", 1), (205, "same", "en", "s0", 4), (205, "same", "en", "s0", 4),
        (206, "same", "fr", "s9", 4), (207, "é́ 日本語 \x00   <|endoftext|>", None, "", 9),
    ]
    return plain + french + odd


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
