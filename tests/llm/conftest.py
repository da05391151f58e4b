import pytest

WORDS = "the of and to in that is was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find any new work part take get place made live where after back little only round man year came show every good me give our under name very through just form".split()  # noqa: E501


def prose(n, seed):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, node string, key string, score string, ids string, part string, first string, n_lines string, n_deleted string, rejected string, held string, hot string, copies string, ranges string, slot string, doc string, text_key string, gone string, _class string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]), with further columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), *["x"] * 19) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null and empty texts, nulls in other columns, a very long text, a text in one line of one word, copies, repeated rows."""
    base = prose(300, 1)
    rows = [(1, base), (2, None), (3, ""), (4, base), (5, "   \n\n "), (6, "word"), (7, prose(60_000, 2)), (8, "x" * 200_000), (9, base), (9, base), (10, "日本語 テキスト\nです。 é à ü ß"), (11, "... !!! 123"), (None, prose(40, 3)), (12, "a\n" * 5000)]
    return make_docs([(*r, None if r[0] == 4 else "en") for r in rows])
