import pytest
from conftest import dicts

from plumbline import assess_data_quality
from plumbline.operators.duplicates import duplicate_positions, with_row_position
from plumbline.plans import quality as Q


def items(report):
    return {r["item"]: r["score"] for r in dicts(report.item_scores)}


def missing_points(spark, rates, n=1000):
    """Total and pattern points for columns with the given missing counts per 1000 rows."""
    df = spark.createDataFrame(
        [(i, f"c{i}", int(round(r * n)), n) for i, r in enumerate(rates)],
        "pos int, variable string, missing_count bigint, n_rows bigint",
    )
    row = Q.missing_score(Q.missing_rates(df)).first()
    return row["total_points"], row["pattern_points"]


@pytest.mark.parametrize(
    "rates,points",
    [
        ([0.0], (15, 10)),
        ([0.049], (15, 10)),
        ([0.05], (12, 10)),
        ([0.099], (12, 10)),
        ([0.10], (8, 8)),
        ([0.199], (8, 8)),
        ([0.20], (4, 5)),
        ([0.299], (4, 5)),
        ([0.30], (4, 2)),
        ([0.399], (4, 2)),
        ([0.40], (0, 2)),
        ([0.24, 0, 0, 0, 0, 0], (15, 5)),  # one bad column costs pattern points
    ],
)
def test_missing_bands(spark, rates, points):
    assert missing_points(spark, rates) == points


def test_air_like_table(table):
    n = 50
    cols = {"Ozone": [None if i % 4 == 0 else float(i) for i in range(n)]}
    cols |= {f"m{k}": [float(i * k + 1) for i in range(n)] for k in range(1, 6)}
    schema = "Ozone double, " + ", ".join(f"m{k} double" for k in range(1, 6))
    report = assess_data_quality(table(cols, schema))
    assert items(report)["missing"] == 20  # 15 for the total, 10 - 5 for the pattern
    assert dicts(report.top_missing)[0]["variable"] == "Ozone"
    bands = {r["variable"]: r["band"] for r in dicts(report.column_report)}
    assert bands == {"Ozone": "red"} | {f"m{k}": "none" for k in range(1, 6)}


def test_passengers_relaxes_duplicates(table):
    n = 80
    cols = {
        "Class": [["1st", "2nd", "3rd"][i % 3] for i in range(n)],
        "Survived": [["No", "Yes"][i % 2] for i in range(n)],
    }
    report = assess_data_quality(table(cols, "Class string, Survived string"))
    row = report.duplicate_table.first()
    assert (row["duplicate_count"], row["raw_score"], row["score"], row["relaxed"]) == (74, 0, 12, True)
    codes = [r["warning"] for r in dicts(report.warnings)]
    assert codes == ["duplicates_relaxed", "outliers_skipped"]
    assert items(report) == {
        "missing": 25,
        "type_format": 20,
        "duplicate": 12,
        "outlier": 15,
        "structure": 10,
        "categorical": 10,
        "basic": 5,
    }
    kinds = [(r["priority"], r["kind"]) for r in dicts(report.findings)]
    assert sorted(kinds) == [(4, "duplicate"), (5, "warning"), (5, "warning")]


def test_nulls_are_told_apart_in_row_keys(table):
    df = table({"a": [None, "x", "x", None], "b": ["x", None, None, "x"]}, "a string, b string")
    assert Q.duplicate_counts(Q.frame_of(df)) == (4, 2)


def test_duplicate_positions_with_one_huge_group(spark):
    df = spark.range(300).selectExpr("id", "if(id % 3 = 0, 'hot', concat('v', id % 50)) AS t")
    got = {r["id"] for r in duplicate_positions(df, ["id"]).collect()}
    seen, want = set(), set()
    for i in range(300):
        t = "hot" if i % 3 == 0 else f"v{i % 50}"
        want |= {i} if t in seen else set()
        seen.add(t)
    assert got == want


def test_row_positions_follow_file_order(spark, tmp_path):
    spark.range(0, 1000, 1, 7).write.parquet(str(tmp_path / "t"))
    df = with_row_position(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(r["position"] for r in df.collect()) == list(range(1, 1001))


def test_type_issue_edges(table):
    n = 100
    cols = {
        "n80": [str(i) if i < 80 else "x" for i in range(n)],
        "n79": [str(i) if i < 79 else "x" for i in range(n)],
        "comma": [f"1,{i:03d}" for i in range(n)],
        "d80": [f"2024-01-{i % 28 + 1:02d}" if i < 80 else "x" for i in range(n)],
        "d79": [f"2024-01-{i % 28 + 1:02d}" if i < 79 else "x" for i in range(n)],
        "words": [f"w{i}" for i in range(n)],
    }
    report = assess_data_quality(table(cols, ", ".join(f"{c} string" for c in cols)))
    got = {r["variable"]: r["issue"] for r in dicts(report.type_issues)}
    assert got == {
        "n80": "should_be_numeric",
        "n79": "mixed_number_text",
        "comma": "should_be_numeric",
        "d80": "should_be_date",
        "d79": "mixed_date",
    }
    assert items(report)["type_format"] == 5  # 5 of 6 columns suspect, no special values


def test_names_structure_and_force_danger(spark, table):
    df = table({"x": list(range(12)), "y": [1] * 12, "z": list(range(12))}, "x int, y int, z int")
    report = assess_data_quality(df.toDF("x", " ", "x"))
    assert items(report)["basic"] == 2
    assert [r["problem"] for r in dicts(report.name_problems.orderBy("position"))] == [
        "repeated_name",
        "blank_name",
        "repeated_name",
    ]
    assert dicts(report.structure_problems) == [{"pos": 1, "variable": " ", "problem": "excluded"}]
    assert "name_problems" in [r["warning"] for r in dicts(report.warnings)]

    empty = assess_data_quality(spark.createDataFrame([], "a int"))
    row = empty.score.first()
    assert (row["force_danger"], row["final_status"]) == (True, "danger")
    nothing = assess_data_quality(spark.range(5).select())
    assert items(nothing)["structure"] == 0 and nothing.score.first()["force_danger"]
    few = assess_data_quality(table({"x": [1, 2, 3]}, "x int"))
    assert items(few)["basic"] == 3


def test_categories_and_special_values(table):
    n = 100
    nan = float("nan")
    cols = {
        "top90": ["a"] * 90 + ["b"] * 10,
        "top89": ["a"] * 89 + ["b"] * 11,
        "x": [nan] + [float(i) for i in range(n - 1)],
    }
    report = assess_data_quality(table(cols, "top90 string, top89 string, x double"))
    got = {r["variable"]: r["problem"] for r in dicts(report.category_quality)}
    assert got == {"top90": "dominant_category", "top89": ""}
    assert items(report)["type_format"] == 15  # the only numeric column has a special value
    assert {r["variable"] for r in dicts(report.format_issues)} == {"x"}
    assert sorted(r["recommendation"] for r in dicts(report.recommendations)) == ["handle_missing"]


def test_clean_table_has_no_findings(table):
    n = 40
    cols = {"x": [i * 1.5 for i in range(n)], "g": ["ab"[i % 2] for i in range(n)]}
    report = assess_data_quality(table(cols, "x double, g string"))
    assert report.score.first()["total_score"] == 100
    assert [r["kind"] for r in dicts(report.findings)] == ["none"]
    assert dicts(report.major_issues)[0]["item"] == "none"
    assert set(report.tables()) >= {"score", "findings", "box_summary"}


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr(
        "id % 37 AS a", "if(id % 11 = 0, NULL, id * 1.5D) AS b", "concat('g', id % 4) AS c"
    )
    a = dicts(assess_data_quality(df.repartition(1)).item_scores)
    b = dicts(assess_data_quality(df.orderBy("c", "a").repartition(9)).item_scores)
    assert a == b
    assert all(0 <= r["score"] <= r["max_score"] for r in a)
