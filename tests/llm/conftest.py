import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, id long, row string, spans int, size int, win string, mark int, part int"


def small_docs(seed=0):
    """Texts with copies, near copies, shared passages, nulls, blanks and odd characters."""
    rng = random.Random(seed)
    words = {
        "en": "the quick brown fox jumps over a lazy dog while seven wizards brew strong tea and sing loudly near old rivers".split(),
        "de": "der schnelle braune fuchs springt über einen faulen hund während sieben zauberer starken tee kochen und laut singen".split(),
    }
    rows, passage = [], " ".join(f"shared{k}" for k in range(60))
    for k in range(60):
        lang = "en" if k % 2 else "de"
        body = [rng.choice(words[lang]) + rng.choice(["", "", "s", ".", "xy"]) for _ in range(rng.randint(1, 90))]
        rows.append((k, " ".join(body), lang))
    for k in range(60, 75):  # exact copies, some in other case
        text = rows[k % 5][1]
        rows.append((k, text.upper() if k % 3 == 0 else text, rows[k % 5][2]))
    for k in range(75, 85):  # one word changed
        body = rows[40][1].split() + rows[41][1].split() * 3
        body[k % len(body)] = f"changed{k}"
        rows.append((k, " ".join(body), "en"))
    for k in range(85, 92):
        rows.append((k, f"start{k} {passage} end{k}\tä—ö\n{k}", "en"))
    rows += [(92, None, "en"), (93, "", None), (94, " \n\t ", "de"), (95, "12 34 !!", None), (96, "x", "en"), (97, "word " * 30000, "en"), (98, "日本語 テキスト " * 3, None), (99, "ａ\u0000b c", "de")]
    return rows


def widen(rows):
    """The same rows with columns whose names clash with those that operators use."""
    return [(i, t, lang, f"src{(i or 0) % 3}", 7, "r", 1, 2, "w", 3, 4) for i, t, lang in rows]


@pytest.fixture(scope="session")
def rows():
    return small_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(widen(rows), DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Rows repeated whole and a null id."""
    again = [r for r in rows if r[0] in (3, 62, 85, 92)]
    return spark.createDataFrame(widen([*rows, *again, (None, rows[1][1], "en")]), DOCS).repartition(3)
