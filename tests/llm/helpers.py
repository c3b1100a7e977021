import random

SYLLABLES = {"en": "the an of ing tion er ha wh ly st".split(), "fr": "le eau oi ç é ré ment que ou ai".split(), "de": "sch ung heit ü der ein ge ß tz ver".split()}


def sentence(r: random.Random, lang: str = "en", n: int | None = None) -> str:
    words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n or r.randint(5, 12))]
    return " ".join(words).capitalize() + "."


def text(r: random.Random, lang: str = "en", sentences: int = 8) -> str:
    return " ".join(sentence(r, lang) for _ in range(sentences))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """Rows of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def odd_rows(r: random.Random):
    """Nulls, blanks, a very long text, repeated rows and null ids."""
    long = text(r, "en", 4000)
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "!!! ??? ...", "fr", "b"), (5, long, "en", "a"), (6, "x" * 50_000, "en", "a"),
        (7, "The same.", "en", "a"), (7, "The same.", "en", "a"), (None, text(r), "en", None), (None, None, None, None), (8, "a\u0000b \U0001f600 \u0001 z", "en", "c"),
    ]
