"""Near copies of texts, verified: links of texts whose word shingles have a Jaccard similarity of 0.8 or more.

A text is the set of its runs of five words. The shingles are ordered by rarity, so that
similar sets must share one of the first, rare shingles of both. Texts with equal sets are
one text to the join. What shares such a shingle is tested by sizes and places, what passes
by all rare shingles of both, by parity bitmaps of the sets, and what is left is verified on the whole sets. No pair is left out, whatever the bits in which
fingerprints of the texts differ. Shingles are made and counted by `shingles`.

Pairs with the first and the previous text that have the same rare shingle come first, of
them the one with the most such shingles, and a few more where it fails: they join almost all of a group of copies. Only
shingles whose texts are then in several groups are looked at again, and only pairs across groups: the rare shingles that
a pair has in common are counted, and rule out almost all pairs before any set travels. Another method may name pairs to be verified ahead of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferrywright.llm import shingles
from ferrywright.llm.common import components, staged
from ferrywright.llm.shingles import PARITY, SHORT_PARITY, parity_names
from ferrywright.session import discard

SIMILARITY = 0.8
# Pairs of a text that are tried early when its likeliest one fails; all others are tried with those across groups.
MORE_EARLY = 3
# Broadcast no more rows than this.
MOST_BROADCAST = 500_000


def _possible(a: str, b: str, t: float) -> Column:
    """Length and positional filters for two rows with a common shingle."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil(F.lit(t / (1 + t)) * (n + m) - F.lit(1e-9))
    place = 1 + F.least(n - F.col(f"{a}.at") - 1, m - F.col(f"{b}.at") - 1) >= need
    return (F.least(n, m) >= F.lit(t) * F.greatest(n, m) - 1e-9) & place


def _prefix_size(n: Column, t: float) -> Column:
    return n - F.ceil(F.lit(t) * n - F.lit(1e-9)).cast("int") + 1


def _differ(maps: list[tuple[Column, Column]]) -> Column:
    """How many shingles two sets differ in at least, by their parity bitmaps."""
    return sum(F.bit_count(x.bitwiseXOR(y)) for x, y in maps)


def _met(placed: DataFrame, t: float) -> DataFrame:
    """A row (a, b, least) for each rare shingle that two rows of two groups have in common, if they may be near copies.

    Every common shingle of a pair is at places that leave room for the others before and
    behind it. The parity bitmaps rule out all rows of a pair or none, so that texts that only
    have a frequent passage in common make no rows.
    """
    n, m = F.col("me.n"), F.col("o.n")
    need = F.ceil(F.lit(t / (1 + t)) * (n + m) - F.lit(1e-9))
    length = F.least(n, m) >= F.lit(t) * F.greatest(n, m) - 1e-9
    before, behind = F.least("me.at", "o.at"), F.least(n - F.col("me.at"), m - F.col("o.at"))
    across = (F.col("me.token") == F.col("o.token")) & (F.col("me.root") < F.col("o.root")) & length & (before + behind >= need)
    differ = _differ([(F.col(f"me.{p}"), F.col(f"o.{p}")) for p in parity_names(SHORT_PARITY)])
    found = placed.alias("me").join(placed.alias("o"), across & (differ <= n + m - 2 * need))
    least = need - F.greatest(n - _prefix_size(n, t), m - _prefix_size(m, t))
    return found.select(F.col("me.row").alias("a"), F.col("o.row").alias("b"), least.alias("least"))


def _across(placed: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of rows of two groups that have enough rare shingles in common to be near copies.

    Up to the lesser of both last rare shingles all that they have in common is counted; the
    text whose last one that is has only its other shingles left.
    """
    found = _met(placed, t)
    return found.groupBy("a", "b", "least").agg(F.count("*").alias("common")).filter("common >= least").select("a", "b")


def _likely(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Those of the pairs (a, b) that their rare shingles do not rule out.

    Up to the lesser of both last rare shingles, those that both texts have are counted; of
    the others they cannot have more in common than the one with fewer has.
    """
    sides = [sets.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("prefix").alias(f"rare_{c}")) for c in "ab"]
    x, y = F.col("rare_a"), F.col("rare_b")
    # A text without words, which another method may name, has no last one: null, and nothing in common.
    end = F.least(F.try_element_at(x, F.lit(-1)), F.try_element_at(y, F.lit(-1)))
    rest = F.least(*[F.col(f"n_{c}") - F.size(F.filter(f"rare_{c}", lambda k: k <= end)) for c in "ab"])
    # Shingles that share a key count as one in the intersection.
    twice = F.greatest(*[F.size(v) - F.size(F.array_distinct(v)) for v in (x, y)])
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9))
    possible = F.size(F.array_intersect(x, y)) + twice + rest >= need
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(possible).select("a", "b")


def _close(pairs: DataFrame, whole: DataFrame, t: float) -> DataFrame:
    """Those of the pairs (a, b) that a parity bitmap of the shingles does not rule out: it bounds their difference."""
    made = whole.select("row", "n", *parity_names(PARITY))
    sides = [made.select(F.col("row").alias(c), *[F.col(m).alias(f"{c}_{m}") for m in made.columns[1:]]) for c in "ab"]
    differ = _differ([(F.col(f"a_{p}"), F.col(f"b_{p}")) for p in parity_names(PARITY)])
    both = F.col("a_n") + F.col("b_n")
    possible = differ <= both - 2 * F.ceil(F.lit(t / (1 + t)) * both - F.lit(1e-9))
    return staged(pairs.join(sides[0], "a").join(sides[1], "b").filter(possible).select("a", "b"), "close_pairs")


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, t: float, counted: bool = False) -> DataFrame:
    """Those of the pairs (a, b) of rows whose shingles reach the threshold; `counted` pairs are as `_across` leaves them."""
    tried = staged(pairs.distinct(), "tried_pairs")
    pairs = tried if counted else staged(_likely(tried, sets, t), "copy_pairs")
    if pairs.isEmpty():
        if not counted:
            discard(tried)
        return pairs
    ends = staged(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "row"), "copy_rows")
    found = rows.join(F.broadcast(ends) if ends.count() <= MOST_BROADCAST else ends, "row")
    whole = staged(shingles.whole(found), "copy_shingles")
    close = _close(pairs, whole, t)
    left = whole.select(F.col("row").alias("a"), F.col("shingles").alias("x"))
    right = whole.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    alike = common >= F.lit(t) * (F.size("x") + F.size("y") - common) - 1e-9
    out = staged(close.join(left, "a").join(right, "b").filter(alike).select("a", "b"), "copy_links")
    discard(tried, pairs, ends, whole, close)
    return out


def _linked_early(pairs: DataFrame, rows: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Links that join most of each group: every text with the one it shares most rare shingles with, and those that
    this leaves alone with the next ones. Whole sets travel with each pair, so few pairs are tried."""
    tried = staged(pairs.groupBy("a", "b").agg(F.count("*").alias("common")), "early_pairs")
    most = tried.groupBy("a").agg(F.max_by("b", F.struct("common", "b")).alias("b"))
    first = _verified(most.select("a", "b"), rows, sets, t)
    alone = tried.join(first.select("a").distinct(), "a", "left_anti").join(most, ["a", "b"], "left_anti")
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("common"), F.desc("b")))
    alone = alone.withColumn("place", place).filter(F.col("place") <= MORE_EARLY)
    second = _verified(alone.select("a", "b"), rows, sets, t)
    out = staged(first.union(second), "early_links")
    discard(tried, first, second)
    return out


def _between_sets(near: DataFrame, sets: DataFrame, same: DataFrame, same_set: list[str]) -> DataFrame:
    """Pairs of rows as pairs (a, b) of the first rows of their sets, a the later one; pairs within a set are left out."""
    of = sets.select("row", *same_set).join(same, same_set).select("row", "first")
    sides = [of.select(F.col("row").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab"]
    pairs = near.select("a", "b").join(sides[0], "a").join(sides[1], "b").filter("first_a <> first_b")
    return pairs.select(F.greatest("first_a", "first_b").alias("a"), F.least("first_a", "first_b").alias("b"))


def groups(rows: DataFrame, t: float = SIMILARITY, near: DataFrame | None = None) -> DataFrame:
    """Columns (row, root) for every row of `rows`, which has row (long, distinct) and text: equal roots are linked.

    The root is a row of the group. Texts without words are one group. `near` may have pairs
    (a, b) of rows that another method takes for near copies: those that are join their
    groups, and are not tried again. All other pairs are tried as without it, so that links
    `near` lacks are found here.
    """
    # Two hashes tell equal sets: one of 64 bits would take some of very many for equal.
    same_set = ["set", "set2"]
    classes = shingles.rarity(rows)
    sets = staged(shingles.sets(rows, classes, t), "shingle_sets")
    classes.destroy()
    # Equal sets are one, the first of them; copies are reduced before the shuffle.
    same = staged(sets.groupBy(*same_set).agg(F.min("row").alias("first")), "same_sets")
    first = sets.join(same.select(F.col("first").alias("row")), "row", "left_semi")
    # A set matches other sets only if it could match one of a shingle more.
    wide = first.filter(F.col("n") >= F.lit(t) * (F.col("n") + 1) - 1e-9)
    tokens = wide.select("row", "n", F.posexplode("prefix").alias("at", "token"))
    # Almost all shingles are in one text only and make no pair; those of several are stored, with the first text
    # that has them and the one before. Plain columns, because a struct would be made ahead of the shuffle.
    by_token = W.partitionBy("token").orderBy("row")
    others = [f.over(by_token).alias(n) for c in ("row", "n", "at") for f, n in ((F.first(c), f"head_{c}"), (F.lag(c), f"last_{c}"))]
    seen = tokens.select("token", "row", "n", "at", *others, F.lead("row").over(by_token).alias("next_row"))
    shared = staged(seen.filter("last_row is not null or next_row is not null").drop("next_row"), "shared_tokens")

    head, last = (F.struct(*[F.col(f"{k}_{c}").alias(c) for c in ("row", "n", "at")]) for k in ("head", "last"))
    met = shared.filter("last_row is not null").select(F.struct("row", "n", "at").alias("me"), F.explode(F.array(head, last)).alias("o"))
    names = F.col("me.row").alias("a"), F.col("o.row").alias("b")
    early = met.filter(_possible("me", "o", t)).select(*names)
    if near is None:
        links = _linked_early(early, rows, sets, t)
    else:
        known = _verified(_between_sets(near, sets, same, same_set), rows, sets, t)
        rest = _linked_early(early.join(known, ["a", "b"], "left_anti"), rows, sets, t)
        links = staged(known.union(rest), "copy_links")
        discard(known, rest)

    roots = staged(components(links), "copy_roots")
    placed = shared.select("token", "row", "n", "at").join(roots.select(F.col("node").alias("row"), "root"), "row", "left")
    placed = placed.withColumn("root", F.coalesce("root", "row"))
    several = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    placed = placed.join(several.select("token"), "token", "left_semi")
    placed = staged(placed.join(sets.select("row", *parity_names(SHORT_PARITY)), "row"), "open_tokens")
    more = None
    if not placed.isEmpty():
        more = _verified(_across(placed, t), rows, sets, t, counted=True)
        if not more.isEmpty():
            roots = staged(components(links.union(more)), "copy_roots")
    of_set = same.join(roots.withColumnRenamed("node", "first"), "first", "left")
    of_set = of_set.select(*same_set, F.coalesce("root", "first").alias("root"))
    out = staged(sets.select("row", *same_set).join(of_set, same_set).select("row", "root"), "copy_groups")
    discard(sets, same, shared, links, placed, roots, *([more] if more is not None else []))
    return out
