"""The best base URL against brute force, with tokens that many or all names hold."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.facts import best_base_url, common_scores


def brute(endpoints, names, least=4):
    split = lambda text: [t for t in re.split("[^a-z0-9]+", (text or "").lower()) if len(t) >= least]
    out = set()
    for key, hint in endpoints:
        counts = Counter(split(hint))
        scores = sorted(((sum(counts[t] for t in set(split(n))), n) for n in set(names) if n), reverse=True)
        if scores and scores[0][0] and (len(scores) == 1 or scores[0][0] > scores[1][0]):
            out.add((key, scores[0][1], scores[0][0]))
    return out


@pytest.mark.parametrize("common", [0, 1, 2, 1000])
def test_best_base_url_is_brute_force(spark, common):
    rng = random.Random(common)
    words = ["service", "orders", "billing", "stock", "users", "base", "remote", "abc", "x1y2"]
    names = [".".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(40)] + [None, "", "service.url", "Service.Url"]
    endpoints = [(k, " ".join(rng.choices(words + ["noise", "Orders/"], k=rng.randint(0, 6)))) for k in range(120)] + [(900, None), (901, "service service service"), (902, "url")]
    got = best_base_url(spark.createDataFrame(endpoints, "endpoint long, hint string"), spark.createDataFrame([(n,) for n in names], "name string"), common=common).collect()
    assert {tuple(r) for r in got} == brute(endpoints, names) and len(got) == len(set(got))


def test_base_url_with_a_token_everywhere(spark):
    """4,000 endpoints and 4,000 names share a token; the own token decides, and the shared one meets once."""
    n = 4000
    endpoints = spark.range(n).select(F.col("id").alias("endpoint"), F.concat(F.lit("service token"), "id").alias("hint"))
    names = spark.range(n).select(F.concat(F.lit("service.token"), "id").alias("name"))
    got = best_base_url(endpoints, names)
    assert got.count() == n and got.where("score = 2 and name = concat('service.token', endpoint)").count() == n
    # a third of the endpoints have the shared token alone: all names tie there
    some = endpoints.withColumn("hint", F.when(F.col("endpoint") % 3 == 0, F.lit("service")).otherwise(F.col("hint")))
    assert best_base_url(some, names).where("endpoint % 3 <> 0").count() == best_base_url(some, names).count() == endpoints.where("endpoint % 3 <> 0").count()


def test_common_tokens_are_joined_for_survivors_alone(spark):
    """Sets with the rarer token score 2 or more; the token of all sets counts 1 and is not joined again."""
    sets = spark.createDataFrame([(["all", f"c{k}"], f"n{k}", 1) for k in range(50)] + [(["all"], "m", 1)], "shared array<string>, name string, names long")
    points = spark.createDataFrame([([(9, f"c{k}", 1), (51, "all", 1)],) for k in range(50)], "points array<struct<held:long,token:string,n:long>>")
    got = common_scores(points, sets).collect()
    assert len(got) == 50 and {r.score for r in got} == {2}
    heavy = spark.createDataFrame([([(9, "c3", 1), (51, "all", 5)],)], "points array<struct<held:long,token:string,n:long>>")
    assert common_scores(heavy, sets).count() == 1
