"""Small tables with awkward rows, and plain readings of the word and line rules."""

import random
import re

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size long, target double, copies long, shard int, rank long, kind string, start long, end long, n_words long, "
    "rule string, kept boolean, labels string, key string, row string, level int, line string, first string"
)
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward_texts():
    """Null, empty, blank, short, long, repeated and nearly repeated texts."""
    rng = random.Random(4)
    base, other = sentence(rng, 60), sentence(rng, 80)
    edited = base.split()
    edited[30] = "zz"
    far = base.split()
    far[::6] = ["yy"] * len(far[::6])
    return [
        None,
        "",
        " \t\n \r ",
        "one",
        "One two\x0bthree",
        "ONE TWO THREE",
        base,
        base.upper(),
        base,
        " ".join(edited),
        " ".join(far),
        other,
        f"{other}\n{other}\n\nshort line\nshort line",
        sentence(rng, 20_000),
        "word " * 3_000,
        "x" * 100_000,
        "é ñ 漢字 " * 30,
        "### *** $$$ a b c d e f g h i j k l <|> | & %",
    ]


def documents(spark, texts=None, more=()):
    texts = awkward_texts() if texts is None else texts
    rows = [(i, text, "en", (None, "s1", "s2")[i % 3], None) for i, text in enumerate(texts)]
    rows += [(None, "text without an id and with seven words", None, None, None), *more]
    width = len(DOC_SCHEMA.split(", "))
    return spark.createDataFrame([(*row, *[None] * (width - len(row))) for row in rows], DOC_SCHEMA)


def none_of(df):
    return df.limit(0)
