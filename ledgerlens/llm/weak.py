"""Weak supervision on vote patterns: expectation-maximisation in SQL functions.

A voter says "1" (positive), "0" (negative) or "-" (abstains, which tells
nothing); the votes on an item are a code, one character for each voter.  The model is a mixture of
classes with votes independent inside a class: the first class is the positive
one, all others are negative (ways to be negative, such as one for each rule
that can fail alone).  Items are first counted by code, so the model reads at
most ``3 ** voters`` rows for each group however many items there are, and runs
as one aggregate expression over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Start:
    """Where the model starts and what its pseudo-counts pull towards: the
    share of every class and, voter by voter, the chance that a vote there is
    positive.  ``anchor`` holds the chances of the positive class near their
    start with the weight of that many times the votes seen: without it, a way
    to fail that shows in one voter only could not be told from an error of
    that voter."""
    shares: tuple[float, ...]
    chances: tuple[tuple[float, ...], ...]
    pseudo: float = 10.0
    anchor: float = 0.0
    rounds: int = 30


def two_classes(voters: int, share: float, if_positive: float, if_negative: float, pseudo: float = 10.0) -> Start:
    return Start((share, 1 - share), ((if_positive,) * voters, (if_negative,) * voters), pseudo)


def one_failure_each(voters: int, share: float, if_positive: float, failing: float, passing: float,
                     pseudo: float = 10.0, anchor: float = 0.0) -> Start:
    """A negative class for each voter, in which that voter fails."""
    ways = tuple(tuple(failing if j == k else passing for j in range(voters)) for k in range(voters))
    return Start((share,) + ((1 - share) / voters,) * voters, ((if_positive,) * voters,) + ways, pseudo,
                 anchor)


def vote(positive: Column, negative: Column) -> Column:
    """A vote from two conditions; unknown conditions abstain."""
    return F.when(negative, "0").when(positive, "1").otherwise("-")


def _said(code: Column, j: int) -> Column:
    return F.substr(code, F.lit(j + 1), F.lit(1))


def _responsible(code: Column, model: Column, start: Start) -> Column:
    """Probability of every class given the votes."""
    voters = len(start.chances[0])
    joint = []
    for k in range(len(start.shares)):
        log = F.log(F.get(model["shares"], F.lit(k)))
        for j in range(voters):
            chance = F.get(F.get(model["chances"], F.lit(k)), F.lit(j))
            log = log + F.when(_said(code, j) == "1", F.log(chance)).when(_said(code, j) == "0", F.log(1 - chance)).otherwise(0.0)
        joint.append(log)
    # A one-element transform binds a value that is used more than once.
    bind = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    scaled = lambda logs: F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return bind(F.array(*joint), lambda logs: bind(scaled(logs), lambda p: bind(
        F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(p, lambda x: x / total))))


def posteriors(items: DataFrame, start: Start, code: str = "code", group: str | None = None) -> DataFrame:
    """(group, code, n, posterior): the codes of ``items`` with the probability
    that an item with these votes is positive; a model for each group."""
    by = [group] if group else []
    voters = len(start.chances[0])
    counts = items.groupBy(*by, code).agg(F.count(F.lit(1)).alias("n"))
    pattern = F.struct(F.col(code).alias("code"), F.col("n").cast("double").alias("n"))
    rows = counts.groupBy(*by).agg(F.sort_array(F.collect_list(pattern)).alias("patterns")).where(F.size("patterns") > 0)
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    first = F.struct(numbers(start.shares).alias("shares"),
                     F.array(*[numbers(table) for table in start.chances]).alias("chances"))

    def add(patterns: Column, value) -> Column:
        return F.aggregate(patterns, F.lit(0.0), lambda acc, x: acc + value(x))

    def maximise(e: Column) -> Column:
        """e: patterns with n and the probabilities r of the classes."""
        total = add(e, lambda x: x["n"])
        shares, tables = [], []
        for k, (share, table) in enumerate(zip(start.shares, start.chances)):
            part = lambda x, k=k: x["n"] * F.get(x["r"], F.lit(k))
            mass = add(e, part)
            shares.append((mass + start.pseudo * share) / (total + start.pseudo))
            chances = []
            for j, chance in enumerate(table):
                yes = add(e, lambda x, j=j: F.when(_said(x["code"], j) == "1", part(x)).otherwise(0.0))
                votes = add(e, lambda x, j=j: F.when(_said(x["code"], j) != "-", part(x)).otherwise(0.0))
                held = start.pseudo + votes * (0.0 if k else start.anchor)
                chances.append((yes + held * chance) / (votes + held))
            tables.append(F.array(*chances))
        return F.struct(F.array(*shares).alias("shares"), F.array(*tables).alias("chances"))

    def once(model: Column, _: Column) -> Column:
        expected = F.transform("patterns", lambda x: F.struct(
            x["code"].alias("code"), x["n"].alias("n"), _responsible(x["code"], model, start).alias("r")))
        return F.element_at(F.transform(F.array(expected), maximise), 1)

    fitted = rows.withColumn("model", F.aggregate(F.sequence(F.lit(1), F.lit(start.rounds)), first, once))
    out = fitted.select(*by, "model", F.inline("patterns"))
    return out.select(*by, "code", F.col("n").cast("long").alias("n"),
                      F.get(_responsible(F.col("code"), F.col("model"), start), F.lit(0)).alias("posterior"))
