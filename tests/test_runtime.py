import zipfile

from moraine import runtime


def test_written_steps_lie_in_the_shared_folder(spark):
    df = runtime.materialize(spark.range(5), "test")
    assert df.count() == 5 and all(f.startswith(runtime.shared_dir(spark).removeprefix("file://")) or runtime.shared_dir(spark) in f for f in df.inputFiles())


def test_package_is_sent_once(spark):
    runtime.ship(spark)
    path = spark.sparkContext._moraine
    runtime.ship(spark)
    assert spark.sparkContext._moraine == path
    assert "moraine/runtime.py" in zipfile.ZipFile(path).namelist()
