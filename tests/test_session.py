"""Staged tables: those of a block go when it ends, those that leave it stay."""

import os
from urllib.parse import urlparse

import pytest

from tagtrail.session import lasting, passing, shared_dir, staged


def folders(spark):
    return set(os.listdir(urlparse(shared_dir(spark)).path))


def test_tables_of_a_block_are_deleted(spark):
    before = folders(spark)
    with passing(spark):
        inner = staged(spark.range(5), "inner")
        with passing(spark):
            deeper = staged(inner.where("id > 1"), "deeper")
            between = lasting(deeper, "between")
        out = lasting(between.where("id > 2"), "out")
        assert len(folders(spark) - before) == 3
    assert {f.split("-")[0] for f in folders(spark) - before} == {"out"} and out.count() == 2


def test_a_block_that_fails_leaves_nothing(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), passing(spark):
        staged(spark.range(5), "inner")
        raise ZeroDivisionError
    assert folders(spark) == before
    assert staged(spark.range(3), "own").count() == 3 and len(folders(spark) - before) == 1
