"""Staged tables of operators that nest, fail or run side by side."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from quillmint.llm.exact_dedup import exact_duplicates
from quillmint.llm.minhash_dedup import near_duplicates
from quillmint.llm.secrets import labelled_samples, with_secrets
from quillmint.llm.staging import shared_dir, stage, tidy
from quillmint.llm.substring_dedup import repeated_passages
from tests.llm.helpers import documents, frame


def folders(spark, name):
    return sorted(p.name for p in Path(shared_dir(spark).removeprefix("file:"), "quillmint").glob(f"{name}-*"))


def test_operators_side_by_side(spark):
    docs = frame(spark, documents(120))
    jobs = [near_duplicates, exact_duplicates, repeated_passages, lambda d: with_secrets(d, labelled_samples(d))]
    alone = [sorted(map(str, job(docs).collect())) for job in jobs]
    with ThreadPoolExecutor(8) as pool:
        together = list(pool.map(lambda job: sorted(map(str, job(docs).collect())), jobs * 2))
    assert together == alone * 2


def test_only_what_the_result_reads_stays(spark):
    @tidy
    def inner(df):
        stage(df, "inner-unread")
        return stage(df, "inner-read").where("id > 1")

    @tidy
    def outer(df):
        a, b = inner(df), inner(df)
        return stage(b, "outer-read").join(a, "id")

    names = ("inner-unread", "inner-read", "outer-read")
    before = [len(folders(spark, n)) for n in names]  # the folder may hold earlier runs' results
    assert outer(spark.range(5)).count() == 3
    assert [len(folders(spark, n)) - b for n, b in zip(names, before, strict=True)] == [0, 1, 1]


def test_a_failed_operator_leaves_nothing(spark):
    @tidy
    def fails(df):
        stage(df, "of-a-failure")
        raise RuntimeError("on purpose")

    with pytest.raises(RuntimeError):
        fails(spark.range(3))
    assert folders(spark, "of-a-failure") == []
