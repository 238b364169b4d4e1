"""Versions of a vector collection."""

import os

import pytest

from qcorpus.sources import sinks as SK


def vectors(spark, ids, x=1.0):
    return spark.createDataFrame([(i, [x, float(i)]) for i in ids], "id long, embedding array<double>")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_readers_keep_their_version_while_another_is_written(spark, tmpdir_path):
    path = f"{tmpdir_path}/v"
    assert SK.vector_versions(spark, path) == []
    with pytest.raises(ValueError):
        SK.read_vector_version(spark, path)
    assert SK.write_vector_version(vectors(spark, range(5)), path) == 1
    reader = SK.read_vector_version(spark, path)
    assert SK.write_vector_version(vectors(spark, range(3, 9), 2.0), path) == 2
    assert ids(reader) == ids(SK.read_vector_version(spark, path, 1)) == list(range(5))
    assert ids(SK.read_vector_version(spark, path)) == list(range(3, 9))


def test_a_failed_write_leaves_no_version(spark, tmpdir_path):
    path = f"{tmpdir_path}/v"
    SK.write_vector_version(vectors(spark, range(4)), path)
    with pytest.raises(ValueError, match="duplicate"):
        SK.write_vector_version(vectors(spark, [1, 1]), path)
    os.close(os.open(f"{path}/versions/0000000002.json", os.O_CREAT))  # another writer's, not filled yet
    assert SK.vector_versions(spark, path) == [1] and ids(SK.read_vector_version(spark, path)) == [0, 1, 2, 3]
    assert SK.write_vector_version(vectors(spark, range(2)), path) == 3  # the number taken is left to its writer
    assert SK.vector_versions(spark, path) == [1, 3]


def test_an_empty_collection_is_a_version(spark, tmpdir_path):
    path = f"{tmpdir_path}/v"
    assert SK.write_vector_version(vectors(spark, [0]).limit(0), path) == 1
    assert SK.read_vector_version(spark, path).count() == 0
