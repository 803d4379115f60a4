"""Written steps and the scopes that delete them."""

from pathlib import Path

from weft.storage import CLEANUP, Scratch, materialise, remove, shared_root


def folders(spark):
    root = Path(shared_root(spark).removeprefix("file://"))
    return {p.name for p in root.iterdir()} if root.exists() else set()


def test_steps_are_read_back_and_removed(spark):
    before = spark.conf.get(CLEANUP, None)
    step = materialise(spark.range(10).withColumnRenamed("id", "a b"), "step")
    assert sorted(r[0] for r in step.collect()) == list(range(10)) and step.columns == ["a b"]
    assert spark.conf.get(CLEANUP, None) == before
    made = folders(spark)
    remove(step, spark)
    assert len(folders(spark)) == len(made) - 1


def test_scopes_keep_what_they_are_told(spark):
    before = folders(spark)
    with Scratch(spark) as outer:
        with Scratch(spark) as inner:
            kept, other = materialise(spark.range(3), "kept"), materialise(spark.range(4), "other")
            inner.keep(kept)
            assert other.count() == 4
        assert kept.count() == 3 and len(folders(spark) - before) == 1
        assert outer.paths
    assert folders(spark) == before


def test_a_failing_scope_deletes_too(spark):
    before = folders(spark)
    try:
        with Scratch(spark):
            materialise(spark.range(3), "step")
            raise ValueError
    except ValueError:
        pass
    assert folders(spark) == before
