from __future__ import annotations

import random

import pytest

WORDS = ["".join(p) for p in __import__("itertools").product("bdfgklmnprst", "aeiou", "nrst")]


class Fixture:
    """Small tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

    def __init__(self, spark):
        self.spark = spark
        self.rng = random.Random(11)

    def prose(self, n: int) -> str:
        return " ".join(self.rng.choice(WORDS) for _ in range(n))

    def texts(self) -> list[str | None]:
        base = self.prose(150)
        near = base.split()
        near[70] = "changed"
        passage = self.prose(60)
        out = [None, "", " \n ", "one", "two words", base, base, " ".join(near), base.upper()]
        out += [f"{self.prose(40)} {passage} {self.prose(30)}" for _ in range(3)]
        out += [self.prose(self.rng.randint(1, 400)) for _ in range(25)]
        out += [self.prose(9000), "x" * 5000, "名前 " * 40, "tab\tand\x0bmore\r\nlines  two space \x1c end", "<|endoftext|> it's I'll"]
        return out

    def documents(self):
        rows = [(k, t, "en", None if k % 7 == 0 else f"src{k % 4}", len(t or ""), 1, 2.0, "z", k) for k, t in enumerate(self.texts())]
        rows += [rows[20], rows[5], (None, "a null id with words of its own", "en", "src1", 3, 1, 1.0, "z", 1)]
        names = "doc_id long, text string, lang string, source string, n_chars long, size int, target double, slot string, piece int"
        return self.spark.createDataFrame(rows, names)

    def empty(self):
        return self.documents().limit(0)


@pytest.fixture(scope="session")
def made(spark):
    return Fixture(spark)


@pytest.fixture(scope="session")
def docs(made, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    made.documents().repartition(3).write.parquet(path)
    return made.spark.read.parquet(path)


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()
