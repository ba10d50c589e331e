"""Small tables with nulls, empty and long texts, repeated rows and clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 4000
WORD = "x" * 200_000
BASE = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in this forest tonight"
EN = "this is the house of the old man and his dog with a very long story that nobody has ever told to them"
DE = "das ist das haus von dem alten mann und seinem hund mit einer sehr langen geschichte die niemand erzählt hat"
FR = "ceci est la maison du vieil homme et de son chien avec une très longue histoire que personne ne leur a racontée"
ES = "esta es la casa del hombre viejo y de su perro con una historia muy larga que nadie les ha contado nunca"


def edge_rows():
    rows = [
        (1, BASE, "en", "s", 1),
        (2, BASE, "en", "s", 1),
        (3, BASE + "\n" + BASE, "en", None, None),
        (4, None, "en", "s", 0),
        (5, "", None, "s", 0),
        (6, " \t\n ", "de", "s", 3),
        (7, LONG, "en", "s", len(LONG)),
        (8, "naïve 中文 🎉 \x00 é", "fr", "s", 1),
        (9, BASE.replace("quick", "quiet"), "en", "s", 1),
        (10, WORD, "en", "s", 1),
        (11, "12345 67890 !!!", "en", "s", 1),
        (None, BASE, "en", "s", 1),
        (12, None, None, None, None),
        (13, EN, "en", "s", 1),
        (14, DE, "de", "s", 1),
        (15, FR, "fr", "s", 1),
        (17, ES, "es", "s", 1),
        (9, BASE.replace("quick", "quiet"), "en", "s", 1),
    ]
    return rows


def edge_documents(spark):
    """The rows with extra columns named as the operators name theirs."""
    extra = "fp, component_id, key, a, b, ids, decoded, line_no, keep, half, lang_pred, score, start, length, path, license".split(", ")
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.selectExpr("*", *(f"'clash' AS {c}" for c in extra)).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
