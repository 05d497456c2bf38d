"""Decisions: candidate scores, shares, first-in-order choices, stable rankings, binary and rubric judgments.

A question has at most 256 candidates, so a candidate set is one array in one row: it is checked against
that bound and sent to every task, and each state's scores are an array beside it. Scoring a table of
states thus shuffles nothing, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vectors import dot, let, softmax, total
from .overlap import MOST_TOKENS, best_ask, stated

MAX_CANDIDATES, MAX_QUESTIONS, MAX_TEXT, MAX_REQUEST, MAX_ID = 256, 32, 65_536, 262_144, 128


def candidate_array(candidates: DataFrame, *columns: str) -> DataFrame:
    """One row: candidates in order of `ord`, as structs of ord, id and the named columns."""
    some = candidates.limit(MAX_CANDIDATES + 1)
    one = some.agg(F.array_sort(F.collect_list(F.struct("ord", "id", *columns))).alias("candidates"))
    ok = (F.size("candidates") >= 1) & (F.size("candidates") <= MAX_CANDIDATES)
    return one.select(F.when(ok, F.col("candidates")).otherwise(F.raise_error(F.lit(f"a question has 1 to {MAX_CANDIDATES} candidates"))).alias("candidates"))


def candidate_rows(candidates: DataFrame, *columns: str) -> DataFrame:
    """The same as rows: ord, id and the named columns; over the bound is an error, not a cut."""
    return candidate_array(candidates, *columns).select(F.inline("candidates"))


def beside(states: DataFrame, candidates: DataFrame, *columns: str) -> DataFrame:
    """Each state with the array of all candidates."""
    return states.crossJoin(F.broadcast(candidate_array(candidates, *columns)))


def score(states: DataFrame, candidates: DataFrame, scorer: Callable[[Column], Column], *columns: str) -> DataFrame:
    """Adds `shares`: ord, id, score and prob of each candidate. scorer(candidate) gives a score's column."""
    return with_shares(beside(states, candidates, *columns), scorer)


def with_shares(both: DataFrame, scorer: Callable[[Column], Column]) -> DataFrame:
    shares = let(
        F.transform("candidates", lambda c: scorer(c).cast("double")),
        lambda scores: let(
            softmax(scores),
            lambda probs: F.transform(
                "candidates",
                lambda c, i: F.struct(c["ord"].alias("ord"), c["id"].alias("id"), F.get(scores, i).alias("score"), F.get(probs, i).alias("prob")),
            ),
        ),
    )
    return both.withColumn("shares", shares).drop("candidates")


def best(states: DataFrame, candidates: DataFrame, scorer: Callable[[Column], Column], key: str, *columns: str) -> DataFrame:
    """key, choice, score: each state's best candidate of any number of them; the first in order wins ties.

    Candidates are cut into blocks of at most 256, and the best of the blocks' best stays.
    """
    from .running import running

    dense = running(candidates.withColumn("one", F.lit(1)), "ord", {"one": "seq"})
    block = F.floor((F.col("seq") - 1) / MAX_CANDIDATES)
    blocks = dense.groupBy(block.alias("block")).agg(F.collect_list(F.struct("ord", "id", *columns)).alias("candidates"))
    top = F.array_max(F.transform("candidates", lambda c: F.struct(scorer(c).cast("double").alias("score"), (-c["ord"]).alias("o"), c["id"].alias("id"))))
    per = states.crossJoin(blocks).select(key, top.alias("top")).groupBy(key).agg(F.max("top").alias("top"))
    return per.select(key, F.col("top.id").alias("choice"), F.col("top.score").alias("score"))


def score_vectors(states: DataFrame, candidates: DataFrame, vector: str, factor: float) -> DataFrame:
    """Scores are factor times the dot product of a state's and a candidate's `vector`."""
    return score(states, candidates, lambda c: F.lit(factor) * dot(F.col(vector), c["vector"]), "vector")


def choice(shares: Column) -> Column:
    """The id with the highest score; the first in order wins ties."""
    return F.array_max(F.transform(shares, lambda s: F.struct(s["score"], -s["ord"], s["id"].alias("id"))))["id"]


def ranking(shares: Column) -> Column:
    """All shares, best first; ties stay in order."""
    keyed = F.transform(shares, lambda s: F.struct((-s["score"]).alias("k"), s["ord"].alias("ord"), s["id"].alias("id"), s["score"].alias("score"), s["prob"].alias("prob")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["ord"].alias("ord"), s["id"].alias("id"), s["score"].alias("score"), s["prob"].alias("prob")))


def ranked_ids(shares: Column) -> Column:
    return F.transform(ranking(shares), lambda s: s["id"])


def prob_of(shares: Column, id_: Column | str) -> Column:
    id_ = F.lit(id_) if isinstance(id_, str) else id_
    return let(id_, lambda wanted: F.get(F.filter(shares, lambda s: s["id"] == wanted), F.lit(0))["prob"])


def expected_level(shares: Column) -> Column:
    """A rubric's value: the mean index under the shares."""
    return total(F.transform(shares, lambda s, i: i.cast("double") * s["prob"]))


def legacy_confidence(shares: Column) -> Column:
    """The highest share less the mean of the others, at least 0 and at most 1."""
    top = F.array_max(F.transform(shares, lambda s: s["prob"]))
    rest = (total(F.transform(shares, lambda s: s["prob"])) - top) / F.nullif(F.size(shares) - 1, F.lit(0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), top - F.coalesce(rest, F.lit(0.0))))


def noul_candidates(instructions: Column, false_text: Column, true_text: Column) -> Column:
    """A binary question as candidates: false first; generated texts where none or an empty one is given."""
    no = F.coalesce(F.nullif(false_text, F.lit("")), F.concat(F.lit("No. This is false: "), instructions))
    yes = F.coalesce(F.nullif(true_text, F.lit("")), F.concat(F.lit("Yes. This is true: "), instructions))
    return F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("false").alias("id"), F.concat(F.lit("false: "), no).alias("text")),
        F.struct(F.lit(1).alias("ord"), F.lit("true").alias("id"), F.concat(F.lit("true: "), yes).alias("text")),
    )


def most_shared(states: DataFrame, candidates: DataFrame, key: str, most: int = MOST_TOKENS) -> DataFrame:
    """key, choice, score: the candidate that shares most distinct tokens with each state; the first in order wins ties.

    Both have `t`, distinct tokens; key and ord are whole numbers. Candidates of at most `most` tokens in all are an index in every task, whose
    common tokens form no pairs where a state's best shares more than these (overlap.py); others are met by a shuffle of tokens.
    """
    asks = stated(candidates, "ord", "t", most)
    if asks is not None:
        top = best_ask(states, key, "t", asks).select(F.col("key").alias(key), F.struct(F.col("overlap").alias("n"), (-F.col("ask")).alias("o")).alias("top"))
    else:
        tokens = candidates.select(F.explode("t").alias("token"), "ord")
        met = states.select(key, F.explode("t").alias("token")).join(tokens, "token")
        top = met.groupBy(key, "ord").agg(F.count("*").alias("n")).groupBy(key).agg(F.max(F.struct("n", (-F.col("ord")).alias("o"))).alias("top"))
    first = candidates.agg(F.min("ord").alias("first_"))
    out = states.select(key).join(top, key, "left").crossJoin(F.broadcast(first))
    return out.select(key, F.coalesce(-F.col("top.o"), F.col("first_")).alias("choice"), F.coalesce("top.n", F.lit(0)).cast("double").alias("score"))


def swapped(states: DataFrame) -> DataFrame:
    """The question first: instructions stand where the state stood, and the other way round."""
    return states.withColumns({"state": F.col("instructions"), "instructions": F.col("state")})


def prompt(state: Column, instructions: Column) -> Column:
    return F.concat(strip(state), F.lit("\n\n"), strip(instructions))


def long_shares(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.inline("shares"))


def permitted(states: DataFrame, candidates: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Only candidates that a state may use, as rows; states without any get none and cost no scoring."""
    some = candidate_rows(candidates, *[c for c in candidates.columns if c not in ("ord", "id")])
    return states.join(allowed, key).join(F.broadcast(some), "id")


def encode_distinct(texts: DataFrame, text: str, ord_: str) -> DataFrame:
    """Distinct texts with a stable sequence id, in order of first appearance: encode these, then join back.

    The dense ids come from counts by block of the order, so no task holds all texts.
    """
    # a digest and not the text is what rows are dealt by
    first = texts.groupBy(F.sha2(text, 256).alias("key_")).agg(F.first(text).alias(text), F.min(ord_).alias("first_ord"), F.count("*").alias("rows"))
    from .running import running

    return running(first.withColumn("one", F.lit(1)), "first_ord", {"one": "seq"}).select(text, "first_ord", "rows", (F.col("seq") - 1).cast("long").alias("sequence_id"))
