import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import json_files, json_pieces

SIGNS = ["a", ",", "[", "]", "{", "}", '"', "\\", "é", "\n", " ", ":", "\t"]


def text(rng):
    return "".join(rng.choice(SIGNS) for _ in range(rng.randrange(6)))


def documents(rng):
    scalar = lambda: rng.choice([1, -2.5, True, False, None, text(rng), "x"])
    record = lambda: {k: rng.choice([scalar(), scalar(), [1, {"q": ",]"}], {"w": [text(rng)]}]) for k in rng.sample(["t", "speed", "a,b", 'q"'], rng.randrange(1, 5))}
    records = [record() for _ in range(rng.randrange(1, 30))]
    yield "records", records
    yield "records", {"meta": text(rng), "info": {"a": [1, 2], "b": {}}, "data": records, "more": [{"z": 1}]}
    yield "columns", {"t": [scalar() for _ in range(9)], "meta": "x", "a": [text(rng) for _ in range(5)], "empty": [], "o": {"p": 1}}
    yield "columns", [[1, text(rng)], [2, "b", None], [text(rng)]]
    yield "columns", [text(rng), 5, None, "b", True]


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


@pytest.mark.parametrize("seed", range(1))
def test_pieces_equal_the_whole_document(spark, tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        for n, (kind, value) in enumerate(documents(rng)):
            path = str(tmp_path / f"{n}.json")
            with open(path, "w", encoding="utf-8") as f:
                json.dump(value, f, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
            read = json_files.read_json_records if kind == "records" else json_files.read_json_columnar
            monkeypatch.setattr(json_files, "WHOLE_BYTES", 1 << 30)
            want = read(spark, path)
            monkeypatch.setattr(json_files, "WHOLE_BYTES", 0)
            got = read(spark, path)
            assert got.columns == want.columns, (kind, n)
            assert rows(got) == rows(want), (kind, n)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_document_is_many_tasks_work(spark, tmp_path):
    path = str(tmp_path / "big.json")
    with open(path, "w") as f:
        json.dump([{"t": i, "v": f"a,{i}]"} for i in range(20_000)], f)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = json_pieces.elements(spark, path)
        assert spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions() >= 8
        assert found.count() == 20_000 and found.agg(F.max("row_idx"), F.countDistinct("row_idx")).first()[:] == (19_999, 20_000)
        assert json.loads(found.filter("row_idx = 12345").first()["text"]) == {"t": 12345, "v": "a,12345]"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
