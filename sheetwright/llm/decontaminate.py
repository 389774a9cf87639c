"""Benchmark decontamination, DataFrame functions only: size-partitioned MinHash containment search, exact.

An item is the set of its five-word shingles.  Items are partitioned by set size (powers of two); in a partition of
sizes up to u, an item's signature is its k = u - ceil(t*u) + 1 first shingles in one order of all shingles: those of fewer
items come first, then those of smaller hash.  A text that holds at least the share t of an item's shingles must hold one
of those k, so the search misses nothing, however long the text is.

The texts are probed with the broadcast signatures alone, and no text is shuffled for that.  Only texts that hold a piece
of a signature are shingled again, to be verified by exact containment of the whole items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, forget, materialize

#: Shingles of items that are broadcast at a time (about 100 MB as a hash table): signatures beyond go in blocks, whole items are joined by a shuffle.
BLOCK_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, h): the 64-bit hash of each n-word shingle of df(key, text), repeats and all; shorter texts have none."""
    hashed = df.select(key, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= n)
    at = [lambda i, k=k: F.get("w", i + k) for k in range(n)]
    each = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*[f(i) for f in at]))
    return hashed.select(key, F.explode(each).alias("h"))


def item_table(items: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(item_id, h, n_item, signature): the items' distinct shingles, and whether each belongs to its item's signature."""
    own = shingles(items, "item_id", n).distinct()
    own = own.join(own.groupBy("h").agg(F.count(F.lit(1)).alias("held_by")), "h")
    by = Window.partitionBy("item_id")
    sized = own.withColumn("n_item", F.count(F.lit(1)).over(by)).withColumn("place", F.row_number().over(by.orderBy("held_by", "h")))
    upper = F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("long")
    length = upper - F.ceil(upper * num / den).cast("long") + 1
    return sized.select("item_id", "h", "n_item", (F.col("place") <= length).alias("signature"))


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): items of which a text holds num/den of the shingles or more.

    docs(doc_id, text), items(item_id, text); other columns are ignored.  Words are lower-case runs of letters and
    digits, shingles are distinct and compared as 64-bit hashes of five word hashes.  Items of fewer than n words are
    too short to be evidence and are found nowhere; null and empty texts hold nothing; a null doc_id or item_id takes no
    part.  Rows that share a doc_id are one document with the shingles of all of them, rows that share an item_id one
    item.  Empty tables give an empty result.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    table = materialize(item_table(wanted, n, num, den), "leak-items")
    signature = table.where("signature").select("item_id", "h")
    blocks = max(1, -(-signature.count() // BLOCK_ROWS))
    found = None
    for block in range(blocks):
        part = signature.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block) if blocks > 1 else signature
        hits = shingles(texts, "doc_id", n).join(F.broadcast(part), "h").select("doc_id", "item_id")
        found = hits if found is None else found.unionAll(hits)
    candidates = materialize(found.distinct(), "leak-candidates")
    suspects = shingles(texts.join(few(candidates.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id", n)
    items_of = candidates.join(table.drop("signature"), "item_id")
    shared = suspects.distinct().join(items_of, ["doc_id", "h"])
    out = shared.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.first("n_item").alias("n_item"))
    out = out.where(F.col("n_shared") * den >= F.col("n_item") * num)
    out = materialize(out.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")), "leaks")
    forget(table, candidates)
    return out


def without_items(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows whose text holds an item; all columns stay, and so do rows with a null doc_id."""
    bad = contained_items(docs, items, n, num, den).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(few(bad), docs["doc_id"] == bad["_leak"], "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM d WHERE len(w) >= 5),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM i WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM x JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 80
"""
