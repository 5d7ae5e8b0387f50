"""Files: discovery, loading, bad files, saving, overwriting."""

import json

import pytest
from pyspark.sql import functions as F

from discourse_spark.plans.corpus import posts
from discourse_spark.sources import posts as IO


@pytest.fixture
def root(tmp_path):
    files = {
        "twitter/b.csv": 'tweet,created_at\n"they never, ""ever""\nlearn",2024-01-02\nhi,2024-01-03\n',
        "twitter/a.CSV": "id,body\n1,an infestation here\n",
        "imported/done.csv": (
            "text,othering_predicted,othering_score,toxicity,matched_patterns\n"
            "x,1.0,2,bad,\"['flood', 'swarm']\"\ny,,,0.5,\n"
        ),
        "zeta/notes.txt": "no table\n",
    }
    for name, content in files.items():
        path = tmp_path / "datasets" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (tmp_path / "datasets" / "broken").mkdir()
    (tmp_path / "datasets" / "broken" / "bad.parquet").write_text("not parquet")
    return str(tmp_path / "datasets")


def test_discovery_order(spark, root, tmp_path):
    groups = IO.discover_datasets(spark, root, default=f"{tmp_path}/dataset_final.csv")
    assert list(groups) == ["Default", "Broken", "Twitter", "Imported"]
    assert [name for name, _ in groups["Twitter"]] == ["a.CSV", "b.csv"]
    assert IO.discover_datasets(spark, f"{tmp_path}/nowhere") == {}


def test_load_skips_and_reports_bad_files(spark, root):
    loaded, errors = IO.load_labelled(spark, root)
    assert len(errors) == 1 and errors[0].startswith("Broken  ·  bad.parquet")
    rows = {(r.dataset, r.text): r for r in loaded.collect()}
    assert len(rows) == 5
    quoted = rows[("Twitter  ·  b.csv", 'they never, "ever"\nlearn')]
    assert quoted.matched_patterns == ["they_never"] and str(quoted.post_date)[:10] == "2024-01-02"
    assert rows[("Twitter  ·  a.CSV", "an infestation here")].othering_predicted == 1
    done, hole = rows[("Imported  ·  done.csv", "x")], rows[("Imported  ·  done.csv", "y")]
    assert (done.othering_predicted, done.toxicity, done.pronoun_type) == (1, None, "unknown")
    assert done.matched_patterns == ["flood", "swarm"]
    assert (hole.othering_predicted, hole.toxicity, hole.othering_score) == (0, 0.5, 0.0)
    only, _ = IO.load_labelled(spark, root, only=["Twitter  ·  b.csv"])
    assert only.count() == 2


def test_completeness(spark, tmp_path):
    headers = {"full/a.csv": "has_othering,othering_predicted,pronoun_type,toxicity", "raw/b.csv": "emotion,topic"}
    for name, header in headers.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(header + "\n")
    rows = {r.dataset: tuple(r)[1:] for r in IO.dataset_completeness(spark, str(tmp_path)).collect()}
    assert rows == {"Full  ·  a.csv": (True, True, False, False), "Raw  ·  b.csv": (False, False, True, False)}


def test_write_modes(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "i int, p array<string>")
    for path in (f"{tmp_path}/t.csv", f"{tmp_path}/t.parquet"):
        assert not IO.write_table(df, path, dry_run=True)
        assert IO.write_table(df, path)
        assert not IO.write_table(df.limit(1), path)
        assert IO.read_posts(spark, path).count() == 2
        assert IO.write_table(df.limit(1), path, overwrite=True)
        assert IO.read_posts(spark, path).count() == 1
    assert IO.read_posts(spark, f"{tmp_path}/t.csv").first().p == "['a', 'b']"


def test_whole_texts_survive_csv(spark, sf_dir, tmp_path):
    source = posts(spark, sf_dir).select("post_id", "text")
    IO.write_table(source, f"{tmp_path}/p.csv")
    again = IO.read_posts(spark, f"{tmp_path}/p.csv", source.schema)
    trouble = source.withColumn("h", F.xxhash64("text")).exceptAll(again.withColumn("h", F.xxhash64("text")))
    assert trouble.count() == 0


@pytest.mark.parametrize("header,first,want", [
    ("text,body,text,likes,TEXT", "a,b,c,d,e", {"text": "a", "body": "b", "likes": "d"}),
    ("x0,x1,x2", "a,b,c", {"x0": "a", "x1": "b", "x2": "c"}),
    (",b,", "a,b,c", {"_c0": "a", "b": "b", "_c2": "c"}),
    ("Body,body", "a,b", {"Body": "a"}),
    ("p,q,p,q,q4", "a,b,c,d,e", {"p": "a", "q": "b", "q4": "e"}),
])
def test_the_first_of_equal_headers_stays(spark, tmp_path, header, first, want):
    (tmp_path / "t.csv").write_text(f"{header}\n{first}\n")
    df = IO.read_posts(spark, f"{tmp_path}/t.csv")
    assert [r.asDict() for r in df.collect()] == [want] and df.columns == list(want)


def test_calendar_dates_are_coerced(spark, tmp_path):
    (tmp_path / "c.csv").write_text('date,title,category,country,region,source\n2024-01-02,"A, b",c,X,r,s\nsoon,t,c,X,r,s\n')
    rows = IO.read_calendar_events(spark, f"{tmp_path}/c.csv").collect()
    assert [(str(r.date), r.title) for r in rows] == [("2024-01-02", "A, b"), ("None", "t")]


def test_metrics_json(spark, tmp_path):
    df = spark.range(1).select(F.lit("m").alias("model_name"), F.array(F.array(F.lit(1), F.lit(2))).alias("cm"))
    IO.write_metrics_json(df, f"{tmp_path}/m")
    (part,) = (tmp_path / "m").glob("part-*.json")
    assert json.loads(part.read_text()) == {"model_name": "m", "cm": [[1, 2]]}


def test_a_large_table_is_laid_out_in_more_than_one_file(spark):
    from discourse_spark.plans.source_queries import few_files

    assert [few_files(spark.range(0, 100, 1, n)).rdd.getNumPartitions() for n in (1, 4, 12, 48)] == [1, 1, 3, 12]
