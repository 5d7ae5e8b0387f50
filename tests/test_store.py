"""The keyed store and results per text: killed, repeated and racing writes, restarts."""

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from discourse_spark.operators import classifier as C
from discourse_spark.operators import scoring as M
from discourse_spark.operators.store import KeyedStore

# workers cannot import test modules
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"{tmp_path}/store", "k", buckets=4)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int")


def content(store):
    return sorted((r.k, r.v) for r in store.read().collect())


def test_repeated_writes_add_nothing(spark, store):
    assert store.version() == 0 and store.read() is None
    rows = frame(spark, ("a", 1), ("b", 2), ("b", 2), (None, 3))
    assert store.add(rows) == 1 and store.add(rows) == 1
    assert store.add(frame(spark, ("a", 9), ("c", 4))) == 2
    assert content(store) == [("a", 1), ("b", 2), ("c", 4)]
    assert sorted(r.k for r in store.read(1).collect()) == ["a", "b"]
    assert store.add(rows.limit(0)) == 2


def test_a_killed_write_leaves_nothing(spark, store):
    store.add(frame(spark, ("a", 1)))
    commit, store._commit = store._commit, lambda version, folder: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        store.add(frame(spark, ("b", 2)))
    store._commit = commit
    assert content(store) == [("a", 1)]
    # a manifest cut off with its writer uses up a number and names nothing
    Path(store.path, "manifest", "v0000000002").write_text("_commit=c12")
    assert content(store) == [("a", 1)] and store.add(frame(spark, ("b", 2))) == 3
    assert content(store) == [("a", 1), ("b", 2)]


def test_racing_writers_leave_one_row_a_key(spark, store):
    store.add(frame(spark, ("a", 1)))
    other, commit = KeyedStore(spark, store.path, "k", buckets=4), store._commit

    def late(version, folder):
        store._commit = commit
        other.add(frame(spark, ("b", 2), ("c", 3)))
        return commit(version, folder)

    store._commit = late
    assert store.add(frame(spark, ("b", 7), ("d", 4))) == 3
    assert content(store) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_look_ups_read_their_buckets(spark, store):
    store.add(frame(spark, *[(str(i), i) for i in range(50)]))
    found = store.look_up(frame(spark, ("7", 0), ("7", 0), ("none", 0)))
    assert [tuple(r) for r in found.collect()] == [("7", 7)]
    folders = list(Path(store.path, "data").glob("*/_bucket=*"))
    assert len(folders) == 4


class Noting:
    """Scores by length, notes each text in a file, and fails on ``boom`` while ``broken`` is there."""

    def __init__(self, folder):
        self.folder = Path(folder)

    def __call__(self, texts):
        if "boom" in texts and (self.folder / "broken").exists():
            raise ValueError("no")
        with (self.folder / "noted").open("a") as out:
            out.writelines(f"{text}|\n" for text in texts)
        return [{"toxic": float(len(text))} for text in texts]

    def noted(self):
        lines = (self.folder / "noted").read_text().split("|\n")[:-1]
        (self.folder / "noted").write_text("")
        return sorted(lines)


def test_scoring_goes_on_where_it_ended(spark, tmp_path):
    scorer, path = Noting(tmp_path), f"{tmp_path}/scores"
    texts = [f"text number {i}" for i in range(30)] + ["boom", "", None, "text number 3"] + ["hot"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "post_id long, clean_text string")
    (tmp_path / "broken").touch()

    def run(rows):
        return M.score_resumable(rows, path, lambda: scorer, {"toxic": "toxicity"}, ranges=8)

    with pytest.raises(RuntimeError, match="1 of 8 ranges failed"):
        run(df)
    first = scorer.noted()
    assert len(first) == len(set(first)) and "boom" not in first and len(first) > 15
    (tmp_path / "broken").unlink()
    scored = {r.post_id: r.toxicity for r in run(df).collect()}
    assert scored == {i: float(len(t or "")) for i, t in enumerate(texts)}
    second = scorer.noted()
    assert sorted(first + second) == sorted({t or "" for t in texts})
    more = df.unionByName(spark.createDataFrame([(99, "late"), (100, "hot")], df.schema))
    assert run(more).count() == len(texts) + 2 and scorer.noted() == ["late"]


def test_a_failing_range_is_tried_again(spark, tmp_path):
    scorer = Noting(tmp_path)
    (tmp_path / "broken").touch()

    class Healing(Noting):
        def __call__(self, texts):
            try:
                return super().__call__(texts)
            except ValueError:
                (self.folder / "broken").unlink()
                raise

    df = spark.createDataFrame([(1, "boom"), (2, "fine")], "post_id long, clean_text string")
    scored = M.score_resumable(df, f"{tmp_path}/s", lambda: Healing(tmp_path), {"toxic": "toxicity"}, ranges=2, tries=2)
    assert sorted(tuple(r) for r in scored.collect()) == [(1, "boom", 4.0), (2, "fine", 4.0)]


def test_embeddings_by_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (None, "bb")], "post_id long, clean_text string")
    encode = lambda: lambda texts: [[len(t), 1] for t in texts]
    got = C.embed_once(df, f"{tmp_path}/e", encode)
    assert sorted((r.clean_text, list(r.embedding)) for r in got.collect()) == [
        ("a", [1, 1]), ("a", [1, 1]), ("bb", [2, 1]), ("bb", [2, 1])]
    edited = C.embed_once(df.withColumn("clean_text", F.lit("ccc")), f"{tmp_path}/e", encode)
    assert {tuple(r.embedding) for r in edited.collect()} == {(3, 1)}
    empty = C.embed_once(df.limit(0), f"{tmp_path}/none", encode)
    assert empty.columns == ["post_id", "clean_text", "embedding"] and empty.count() == 0
