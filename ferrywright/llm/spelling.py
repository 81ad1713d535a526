"""Spelling variants: words that differ by one letter, and the form that each stands for.

Near words are found by PartEnum. One inserted, deleted or replaced letter changes the
multiset of a word's letters, read as a vector of bits (letter, occurrence), in one bit for
words of neighbouring lengths and in two, or none, for words of equal length. The letters
are dealt out to PARTS parts; whatever two letters a pair differs in, it agrees in all but
two parts (in all but one for neighbouring lengths). Each word therefore gives a signature
for every choice of parts left out, pairs that share a signature are joined on it, and a
pair counts if its edit distance is one.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywright.llm.common import staged
from ferrywright.session import discard, stage

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
# Words of this many letters, and found this often, take part.
LEAST_LETTERS = 5
LEAST_COUNT = 3
# A form is found at least this many times as often as its variant.
RATIO = 2
# Every 97th word of a text, told by a checksum, loses a letter.
ONE_IN = 97
PARTS = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all texts: runs of letters in lower case, one in ONE_IN of them damaged.

    The letter at crc32(id:run) modulo the run's length is taken out where ONE_IN divides
    the checksum. A null text has no words; a null id counts as empty text.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text).cast("string"), _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    each = docs.select(key.alias("key"), F.explode(runs).alias("run"))
    check = F.crc32(F.concat_ws(":", "key", "run").cast("binary"))
    each = each.select("run", check.alias("check"), F.char_length("run").alias("size"))
    at = (F.col("check") % F.col("size")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    each = each.select(F.when(F.col("check") % ONE_IN == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = each.filter(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def letter_parts(known: DataFrame, parts: int) -> list[str]:
    """The letters of each part, such that every part tells words apart about equally well.

    A letter weighs what it says about a word, the entropy of being in it. There are as many
    rows as letters, 116 at most.
    """
    letters = F.explode(F.array_distinct(F.split("word", "")))
    rows = known.select(letters.alias("letter")).groupBy("letter").agg(F.count("*").alias("n")).collect()
    total = known.count()
    share = {r.letter: r.n / total for r in rows if r.letter}
    weight = {c: -sum(x * math.log2(x) for x in (p, 1 - p) if x) for c, p in share.items()}
    dealt, load = [""] * parts, [0.0] * parts
    for letter in sorted(weight, key=lambda c: (-weight[c], c)):
        k = load.index(min(load))
        dealt[k] += letter
        load[k] += weight[letter]
    return dealt


def _signatures(known: DataFrame, dealt: list[str], left_out: int, size: Column) -> DataFrame:
    """(signature, word, n) for each choice of `left_out` parts, with a size in each signature."""
    everything = "".join(dealt)
    letters = known.withColumn("letters", F.array_join(F.array_sort(F.split("word", "")), ""))
    each = letters.select(
        "word", "n", size.alias("size"),
        # translate drops the letters of other parts; the sorted rest is the part's multiset.
        *(F.xxhash64(F.translate("letters", "".join(c for c in everything if c not in own), "")).alias(f"p{k}")
          for k, own in enumerate(dealt)),
    )
    choices = itertools.combinations(range(len(dealt)), left_out)
    signs = [
        F.xxhash64(F.lit(number), "size", *(f"p{k}" for k in range(len(dealt)) if k not in choice))
        for number, choice in enumerate(choices)
    ]
    return each.select("word", "n", F.explode(F.array(*signs)).alias("signature"))


def near_pairs(known: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b, n_a, n_b) of all pairs of words at edit distance one, each pair once.

    `known` has distinct words with their counts. Any number of parts from three on gives
    the same pairs. Signatures are 64-bit hashes; those that meet by chance fail the test
    of the distance.
    """
    if parts < 3:
        raise ValueError("PartEnum for two differences needs three parts")
    dealt = letter_parts(known, parts)
    size = F.char_length("word")
    near = F.levenshtein(F.col("a"), F.col("b"), 1) == 1

    def side(signed: DataFrame, name: str) -> DataFrame:
        return signed.select("signature", F.col("word").alias(name), F.col("n").alias(f"n_{name}"))

    equal = _signatures(known, dealt, 2, size)
    same = side(equal, "a").join(side(equal, "b"), "signature").filter((F.col("a") < F.col("b")) & near)
    shorter, longer = _signatures(known, dealt, 1, size), _signatures(known, dealt, 1, size - 1)
    other = side(shorter, "a").join(side(longer, "b"), "signature").filter(near)
    columns = ("a", "b", "n_a", "n_b")
    return same.select(*columns).union(other.select(*columns)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form, by doubling the steps until all have arrived.

    A form is at least RATIO times as frequent as its variant, so no chain is longer than
    the logarithm of the largest count, and the rounds are the logarithm of that.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        steps = now.select("word", "root")
        onwards = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = steps.join(onwards, "root", "left")
        moved = stage(further.select("word", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved")), "roots")
        discard(now)
        now = moved
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int = PARTS) -> DataFrame:
    """Per word: word, form, root, n, n_near and form_n.

    The form is the most frequent near word (of equals the first in the order of code
    points) if it is RATIO times as frequent as the word; the root is where the chain of
    forms ends. Repeated rows count each; other columns take no part; an empty table, or
    one without frequent words, gives no rows.
    """
    known = staged(words(docs, id_col, text), "words")
    pairs = staged(near_pairs(known, parts), "near")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("form")).alias("near")).union(
        pairs.select("b", F.struct((-F.col("n_a")).alias("n"), F.col("a").alias("form")))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    is_form = F.col("n_best") >= RATIO * F.col("n")
    found = known.join(best.select("word", "n_near", (-F.col("near.n")).alias("n_best"), "near.form"), "word", "left").select(
        "word",
        F.when(is_form, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("n_best")).alias("form_n"),
    )
    found = staged(found, "forms")
    discard(pairs, known)
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


# The same in DuckDB: crc32 from its polynomial, near words by their texts with one letter out.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) GROUP BY ALL),
checked AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
           lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT *, list_transform(range(0, octet_length(encode(s)), 1),
                                 lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT) AS bytes
        FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs)), crc),
damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
              ELSE run END AS word, n
  FROM checked),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest
        FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS form,
         first(other_n ORDER BY other_n DESC, encode(other)) AS form_n
  FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form,
         CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT chain.word, chain.root FROM chain JOIN forms e ON e.word = chain.root WHERE e.form IS NULL) c
  ON c.word = f.word
"""
