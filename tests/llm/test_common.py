import pytest


def test_a_run_releases_its_own_tables(spark):
    from keelson.llm import common

    theirs = common.stored(spark.range(3), "theirs")
    with common.Scratch() as outer:
        with common.Scratch() as run:
            mine = common.stored(theirs, "mine")
            gone = common.stored(mine, "gone")
            assert gone.count() == 3
            assert run.release(spark, keep=mine) == 1
        assert len(outer.paths) == 1  # what a run keeps is the outer one's
        assert theirs.count() == mine.count() == 3
        assert outer.release(spark) == 1
    assert theirs.count() == 3


def test_local_folders_in_local_mode_only(spark):
    from keelson.llm import common

    class Unset:
        def get(self, key, default=None):
            return default

    class Context:
        applicationId = "test"

        def __init__(self, master):
            self.master = master

    class Session:
        conf = Unset()

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("spark://somewhere:7077", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(RuntimeError):
            common.shared_folder(Session(master))
    assert common.shared_folder(Session("local[4]")).startswith("file:///") and common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_parted_never_loses_an_id(spark):
    from keelson.llm import common

    before, common.SLOTS = common.SLOTS, 2  # a filter that is nearly full
    docs = spark.range(500).selectExpr("CASE WHEN id = 7 THEN NULL ELSE id - 250 END AS doc_id", "id AS _bits", "id AS `_slot`")
    maybe, rest = common.parted(docs, spark.range(-250, 250, 50).toDF("doc_id"))
    common.SLOTS = before
    assert maybe.columns == rest.columns == docs.columns and maybe.count() + rest.count() == 500
    ids = {r.doc_id for r in maybe.collect()}
    assert set(range(-250, 250, 50)) <= ids and None not in ids and rest.filter("doc_id % 50 = 0").count() == 0
