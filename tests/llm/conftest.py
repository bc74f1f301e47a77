import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, _id int, _gone int, _mix_source string, n_tokens int, budget_level int, key string, hash string, sig binary, node long, h long, tokens int, bucket int, rank int, score double, kind string, block int"


def extra(i):
    return (i, 7, 8, "x", 9, 10, "k", "h", b"s", 11, 12, 13, 14, 15, 1.5, "kind", 16)


@pytest.fixture(scope="session")
def rows():
    """Documents with all that is awkward: nulls in every column, empty and long texts, ties, copies, repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeiorstn") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = ["\n".join(prose(rng.randint(3, 30)) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    passage = prose(70)
    run = "\n".join(prose(12) for _ in range(8))
    near = texts[0].split(" ")
    texts += [texts[0], texts[0], " ".join([*near[:20], "changed", *near[21:]]), texts[3] + "\n" + passage, passage + "\n" + texts[4], run + "\n" + prose(9), prose(8) + "\n" + run, run]
    texts += [None, "", " \n\t ", "?!", "\n\n\n", prose(30_000), "x" * 200_000, "é ñ \U0001f600 \x00 tab\tend", "same\nsame\nsame\nsame\nsame\nsame"]
    out = [(k * 3, t, "en", f"s{k % 4}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    out += [(None, texts[5], None, None, None), (None, None, None, None, None), (2_000, texts[6], None, None, 1), (2_001, "only one", "en", None, 8)]
    out += [out[2], out[2], (out[3][0], "other text of the same id", "en", "s1", 25), (-5, prose(40), "en", "hot", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *extra(k)) for k, r in enumerate(rows)], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
