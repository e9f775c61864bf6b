"""Records that the borders of byte ranges cut in every place, against readers of whole files."""

from __future__ import annotations

import csv
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.sources import loaders
from factloom.sources.ranges import csv_records, json_records


@pytest.fixture
def cut(spark):
    """Ranges of so many bytes."""

    def to(n: int) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield to
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


ODD = ['plain', 'a "quoted" word', 'back\\slash', 'ends in \\', '\\" both', 'brace } and { and ] [', '}"{', 'line\nfeed', 'comma, "x", }', 'é漢\U0001f600 ﬁ', '', '"', '\\\\"}', '\r\n\r\n', ' ' * 30]


def games(n: int) -> list[dict]:
    rng = np.random.default_rng(n)
    return [{"k": i, "t": [ODD[j] for j in rng.integers(0, len(ODD), 4)], "m": {ODD[j] + "x": {"deep": ODD[-j]} for j in rng.integers(0, len(ODD), 2)}} for i in range(n)]


@pytest.mark.parametrize("size", [7, 16, 61, 300, 10**6])
def test_json_arrays(spark, tmp_path, cut, size):
    cut(size)
    made = games(12 if size < 20 else 40)
    for k, (name, style) in enumerate({"a.json": {}, "b.json": {"indent": 2, "ensure_ascii": False}}.items()):
        (tmp_path / name).write_text(json.dumps(made[k::2], **style), encoding="utf-8")
    got = json_records(spark, str(tmp_path / "*.json")).orderBy("file", "start", "seq").collect()
    assert [json.loads(r.text) for r in got] == made[0::2] + made[1::2]


@pytest.mark.parametrize("size", [5, 16, 61, 300, 10**6])
def test_quoted_csv(spark, tmp_path, cut, size):
    cut(size)
    rng = np.random.default_rng(size)
    rows = [["Ref", "MR"]] + [[ODD[j] for j in rng.integers(0, len(ODD), 2)] for _ in range(12 if size < 20 else 60)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n" if size % 2 else "\n").writerows(rows)
    (tmp_path / "x.csv").write_bytes(b"\xef\xbb\xbf" + out.getvalue().encode())
    got = csv_records(spark, str(tmp_path / "x.csv")).orderBy("file", "start", "seq").collect()
    assert [next(csv.reader(io.StringIO(r.text, newline=""))) for r in got] == [r for r in rows]


def test_empty_files(spark, tmp_path):
    for name, text in (("a.json", "[]"), ("b.json", " [ ]\n"), ("c.json", "")):
        (tmp_path / name).write_text(text)
    assert json_records(spark, str(tmp_path / "*.json")).count() == 0
    (tmp_path / "x.csv").write_text("")
    assert csv_records(spark, str(tmp_path / "x.csv")).count() == 0
    (tmp_path / "y.csv").write_text("mr,ref\n")
    assert loaders.load(spark, "e2e", str(tmp_path / "y.csv"), "dev").count() == 0


def test_corpora_do_not_depend_on_the_ranges(spark, tmp_path, cut):
    box = {"PLAYER_NAME": {"10": 'B "Two" }', "2": "A\\One"}, "TEAM_CITY": {"10": "Y", "2": "X"}, "PTS": {"10": "7", "2": "12"}}
    game = {"home_city": "X", "home_name": "Home", "vis_city": "Y", "vis_name": "Vis", "home_line": {"TEAM-PTS": "12"}, "vis_line": {"TEAM-PTS": "7"}, "box_score": box}
    (tmp_path / "x.json").write_text(json.dumps([game | {"summary": ["Game", str(i), '"}{"']} for i in range(30)]))
    lines = [f'"name[A{i % 7}], area[x, ""y""]","Line {i}\nof ""two"" }}"' for i in range(30)]
    (tmp_path / "x.csv").write_text("mr,ref\n" + "\n".join(lines))
    found = []
    for size in (40, 10**6):
        cut(size)
        ex = loaders.load(spark, "rotowire", str(tmp_path / "x.json"), "test")
        e2e = loaders.load(spark, "e2e", str(tmp_path / "x.csv"), "dev")
        found.append((sorted(map(str, ex.collect())), sorted(map(str, e2e.collect())), ex.count(), e2e.count()))
    assert found[0] == found[1] and found[0][2:] == (30, 7)
    whole = spark.read.schema(loaders.GAME).json(str(tmp_path / "x.json"), multiLine=True)
    assert [r.references for r in ex.orderBy("pos").collect()] == [[" ".join(r.summary)] for r in whole.collect()]
    assert spark.read.csv(str(tmp_path / "x.csv"), header=True, multiLine=True, escape='"').select(F.count("ref")).first()[0] == e2e.select(F.sum(F.size("references"))).first()[0]
