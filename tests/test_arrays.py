"""JSON arrays read in splits, and imports that stop half way."""

import json
import random

import pytest

from earshot.sources import arrays


def texts(seed, n):
    r = random.Random(seed)
    odd = ["}", "{", '"', "\\", "\\\"", "],[", "ü", "\n", "}}}", '\\"}', "日本", "a" * 90]
    return [{"n": i, "song": "".join(r.choices(odd, k=r.randint(0, 6))), "deep": {"x": [{"y": r.choice(odd)}] * r.randint(0, 3)}, "none": None} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_of_files_in_many_splits(spark, tmp_path, indent):
    (tmp_path / "in").mkdir()
    want = {}
    for k, n in enumerate((40, 0, 1, 300)):
        rows = texts(k, n)
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(k % 2)))
        want |= {(f"{k}.json", i): row for i, row in enumerate(rows)}
    (tmp_path / "in" / "object.json").write_text('{"a": [{"b": 1}]}')
    (tmp_path / "in" / "empty.json").write_text("")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700b", "40b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            found = arrays.array_elements(spark, str(tmp_path / "in"))
            got = [((r.file.rsplit("/", 1)[1], r.element), json.loads(r.text)) for r in found.collect()]
            assert len(got) == len(want) and dict(got) == want
            if size == "700b":
                assert found.where("element >= 0").select("file").rdd.getNumPartitions() > 20
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_objects_as_columns(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1, "s": "x"}, {"s": 5}, 7, {"n": "no"}]')
    got = sorted(map(tuple, arrays.read_objects(spark, str(tmp_path / "a.json"), "n long, s string").collect()), key=str)
    assert got == [(1, "x"), (None, "5"), (None, None)]


def test_an_import_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"n": i} for i in range(25)]))
    (tmp_path / "b.json").write_text(json.dumps([{"n": 100 + i} for i in range(7)]))
    elements = arrays.array_elements(spark, str(tmp_path / "*.json"))
    seen = []

    def take(rows, step):
        if len(seen) == 1 and step == 1:
            seen.append(None)
            raise RuntimeError("stopped")
        seen.append((step, sorted(json.loads(r.text)["n"] for r in rows.collect())))

    folder = str(tmp_path / "job")
    with pytest.raises(RuntimeError, match="stopped"):
        arrays.import_in_steps(elements, folder, 10, take)
    assert arrays.import_in_steps(elements, folder, 10, take) == 2 and arrays.import_in_steps(elements, folder, 10, take) == 0
    assert [x for x in seen if x] == [(0, [*range(10), *range(100, 107)]), (1, [*range(10, 20)]), (2, [*range(20, 25)])]
    assert arrays.import_in_steps(elements.limit(0), str(tmp_path / "nothing"), 10, take) == 0
