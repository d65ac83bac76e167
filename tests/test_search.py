"""The trigram index finds what a scan finds, reading the query's buckets only."""

import random

import pytest
from pyspark.sql import functions as F

from petrograph.operators.lookups import entity_texts, search_entities
from petrograph.operators.search import TrigramIndex, query_grams
from tests.conftest import SF0001


@pytest.fixture(scope="module")
def index(spark):
    texts = entity_texts(spark, SF0001)
    odd = spark.createDataFrame([("x", "1", None), ("x", "2", ""), ("x", "3", "aaaa"), ("x", "4", "ÀÉ ünï 日本語"), ("x", "4", "aaaa")],
                                "kind string, id string, text string")
    found = TrigramIndex(texts.unionByName(odd), buckets=16)
    yield found
    found.drop()


def test_search_equals_a_scan(spark, index):
    rng = random.Random(3)
    texts = [r.text for r in index.texts.where("text is not null").collect()]
    queries = ["", "e", "Er", "aaa", "日本語", "éü", "no such", "ERROR event #1", "aaaaa"]
    for _ in range(25):
        t = rng.choice(texts)
        a = rng.randrange(max(len(t), 1))
        queries.append(t[a:a + rng.randint(1, 9)].swapcase())
    for q in queries:
        low = q.lower()
        want = sorted(str(r) for r in index.texts.where(F.lower("text").contains(low)).collect())
        assert sorted(str(r) for r in index.search(q).collect()) == want, q


def test_index_equals_the_query(spark, index):
    got = index.search("ERROR").where("kind <> 'x'")
    assert got.exceptAll(search_entities(spark, SF0001)).isEmpty() and got.count() == search_entities(spark, SF0001).count() > 0


def test_only_the_buckets_of_the_query_are_read(spark, index):
    # Spark prunes buckets either way, but tells so in the plan of a bucketed scan only.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    plan = index.candidates("rror")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert query_grams("rror") == ["rro", "ror"] and plan.count("SelectedBucketsCount: 1 out of 16") == 2
