"""Exact dedup by deterministic block naming, in DataFrame functions only.

A text, without its white space, is cut into blocks of a fixed number of
UTF-8 bytes. Distinct blocks are sorted by (64-bit key, content); a block's
integer name is its key and its rank among the distinct blocks of that key,
so equal names mean equal blocks, whatever the keys do. Adjacent names are
then paired, and distinct pairs are named in the same way, until every
document has one name. Documents with the same byte length take the same
steps, so (byte length, name) is equal exactly when the texts are equal.

The texts cross the network once, as distinct blocks combined on each task
beforehand; the later levels move names. A key shared by two blocks or pairs
is found by counting distinct contents per key; only such keys need the
contents again, to rank them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.common import SPACES, row_key, stage_table, text_or_empty

BLOCK_BYTES = 4096
_NAME = "struct<key:bigint,rank:int>"


def _key(content: Column, key_bits: int) -> Column:
    h = F.xxhash64(content)
    return h if key_bits >= 64 else F.pmod(h, F.lit(1 << key_bits).cast("long"))


def _ranks(pieces: DataFrame) -> DataFrame | None:
    """Ranks above 0 of distinct (key, content), where a key has several
    contents; None if no key has."""
    distinct = pieces.select("key", "content").distinct()
    clashes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    clashes = stage_table(clashes, "clashes")
    if clashes.isEmpty():
        return None
    rank = F.row_number().over(Window.partitionBy("key").orderBy("content")) - 1
    named = pieces.select("key", "content").join(clashes, "key", "left_semi").distinct()
    return stage_table(named.withColumn("rank", rank.cast("int")).filter("rank > 0"), "ranks")


def _named(rows: DataFrame, pieces: DataFrame, keys: Column, ranks: DataFrame | None) -> DataFrame:
    """``rows`` with ``names``: the keys of its pieces with their ranks."""
    plain = F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(0).alias("rank")).cast(_NAME))
    if ranks is None:
        return rows.withColumn("names", plain)
    ranked = (pieces.join(ranks, ["key", "content"]).groupBy("row")
              .agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("_ranks")))
    return rows.join(ranked, "row", "left").withColumn("names", F.transform(plain, lambda x, i: F.struct(
        x["key"].alias("key"),
        F.coalesce(F.try_element_at(F.col("_ranks"), i.cast("int")), F.lit(0)).alias("rank")).cast(_NAME))
    ).drop("_ranks")


def document_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a number), ``doc_id``,
    ``row_key``, ``n_chars``, ``n_bytes`` and ``text_sha256`` of the text
    without white space, and ``name``.

    ``key_bits`` shortens the sort key, which makes keys clash; results do
    not depend on it. Null texts count as empty; an empty text has a null
    name and length 0.
    """
    text = F.encode(F.translate(text_or_empty(), SPACES, ""), "utf-8")
    count = F.ceil(F.col("n_bytes") / F.lit(block_bytes)).cast("int")

    def block(i: Column) -> Column:
        return F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes))

    def places(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    base = docs.select(
        F.col("doc_id"), row_key(docs).alias("row_key"), F.char_length(text_or_empty()).alias("n_chars"),
        text.alias("body")).withColumn("n_bytes", F.octet_length("body").cast("long"))
    rows = stage_table(base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "row_key", "n_chars", "n_bytes",
        F.sha2("body", 256).alias("text_sha256"),
        F.transform(places(count), lambda i: _key(block(i), key_bits)).alias("keys")), "rows")

    # level 0: blocks of text
    contents = base.select(F.explode(F.transform(places(count), block)).alias("content")).select(
        _key(F.col("content"), key_bits).alias("key"), "content")
    ranks = _ranks(contents)
    pieces = None
    if ranks is not None:
        # rows are numbered by their order in the scan; clashing blocks are found again by content
        pieces = rows.select("row", "doc_id", "row_key", F.posexplode("keys").alias("pos", "key")).join(
            base.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"),
                        F.posexplode(F.transform(places(count), block)).alias("_p", "content")).distinct(),
            F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_k")) & (F.col("pos") == F.col("_p")),
        ).select("row", "pos", "key", "content")
    rows = _named(rows, pieces, F.col("keys"), ranks).drop("keys")

    # upper levels: pairs of adjacent names; an odd last name is paired with null
    longest = rows.agg(F.max(F.size("names"))).first()[0] or 0
    while longest > 1:
        half = F.floor((F.size("names") + 1) / 2).cast("int")
        pair = lambda i: F.struct(
            F.element_at("names", i * 2 + 1).alias("a"), F.try_element_at(F.col("names"), i * 2 + 2).alias("b"))
        rows = stage_table(rows.withColumn("pairs", F.when(F.size("names") > 1, F.transform(places(half), pair))),
                           "pairs")
        pieces = rows.filter("pairs IS NOT NULL").select("row", F.posexplode("pairs").alias("pos", "content"))
        pieces = pieces.withColumn("key", _key(F.col("content"), key_bits))
        ranks = _ranks(pieces)
        done = rows.filter("pairs IS NULL").drop("pairs")
        more = rows.filter("pairs IS NOT NULL").drop("names")
        more = _named(more, pieces, F.transform("pairs", lambda p: _key(p, key_bits)), ranks).drop("pairs")
        rows = done.unionByName(more)
        longest = (longest + 1) // 2
    return rows.withColumn("name", F.try_element_at(F.col("names"), F.lit(1))).drop("names")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """Groups of texts that are equal without white space.

    Returns one row per row of ``docs``: ``doc_id``, ``row_key``, ``keep_id``
    (doc_id of the row that stays: most code points, then smallest doc_id, a
    null doc_id last), ``group_size``, ``kept`` and ``text_sha256``. Of rows
    that repeat each other wholly exactly one can be kept. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = stage_table(document_names(docs, block_bytes, key_bits).select(
        "row", "doc_id", "row_key", "n_chars", "n_bytes", "text_sha256",
        F.col("name.key").alias("key"), F.col("name.rank").alias("rank")), "named")
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"),
                           F.col("doc_id").alias("id"), "row_key", "row"))
    # stored, so that the join below shuffles both sides and a hot group can be split
    groups = stage_table(rows.groupBy("n_bytes", "key", "rank").agg(
        first.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        F.col("n_bytes").alias("_n"), F.col("key").alias("_key"), F.col("rank").alias("_rank"),
        F.col("best.id").alias("keep_id"), F.col("best.row").alias("_row"), "group_size"), "groups")
    on = ((rows["n_bytes"] == groups["_n"]) & rows["key"].eqNullSafe(groups["_key"])
          & rows["rank"].eqNullSafe(groups["_rank"]))
    return rows.join(groups, on).select(
        "doc_id", "row_key", "keep_id", "group_size", (F.col("row") == F.col("_row")).alias("kept"), "text_sha256")
