from quernel import session


def test_materialized_tables_are_released(spark):
    kept = session.materialize(spark.range(5), "t")
    assert kept.count() == 5
    files = kept.inputFiles()
    session.release(spark)
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_shared_folder_is_set_once(spark):
    first = session.shared_dir(spark)
    assert first and session.shared_dir(spark) == first and spark.sparkContext.getCheckpointDir()
