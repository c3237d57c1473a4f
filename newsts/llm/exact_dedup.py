"""Exact de-duplication by deterministic block naming (operator 10).

Texts are equal when they are identical after deleting white space.  Each
normalised text is cut into fixed-size blocks.  The distinct blocks are sorted
and numbered: a block's *name* is an integer that no other block has.  Then
adjacent names are paired, the distinct pairs are sorted and numbered, and so
on, until each document has one name.  Two documents have the same (level,
name) exactly when their texts are equal.

Block text crosses the network once, reduced to distinct blocks in each map
task.  Names travel back on a 64-bit fingerprint, which is only a route:
where distinct blocks share a fingerprint, the sorted blocks are matched with
the sorted names by rank, so no collision can join different texts.  Names
are stored before they are used, so a lost executor cannot renumber them.
A hot block or pair is one row on the name side of a join whose other side
adaptive execution may split; the rows of a large group are dealt over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, passing, spread_join, store, strip_white_space

BLOCK_CHARS = 4096  # documented parameter: code points in a block


def _blocks(norm: Column, block_chars: int) -> Column:
    found = F.regexp_extract_all(norm, F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    return F.when(norm == "", F.array(F.lit(""))).otherwise(found)


def _named(distinct_rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Number the distinct rows in sorted order and store the numbers."""
    return store(distinct_rows.sortWithinPartitions(*keys)
                 .select(*keep, F.monotonically_increasing_id().alias("name")), "names")


def _block_names(blocks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """occurrences (rid, n, pos, fp) with the ``name`` of their block.

    ``blocks`` (rid, pos, fp, block) is read only for its distinct (fp, block)
    and, where a fingerprint is shared by different blocks, for those blocks.
    """
    distinct = blocks.select("fp", "block").distinct()
    names = _named(distinct, ["block"], ["fp"])
    clash = store(names.groupBy("fp").count().filter("count > 1").select("fp"), "clash")
    if clash.isEmpty():
        return occurrences.join(names, "fp").select("rid", "n", "pos", "name")
    by_fp = Window.partitionBy("fp")
    names_r = (names.join(clash, "fp", "left_semi")
               .withColumn("r", F.row_number().over(by_fp.orderBy("name"))))
    ranked = (blocks.join(clash, "fp", "left_semi").select("fp", "block").distinct()
              .withColumn("r", F.row_number().over(by_fp.orderBy("block")))
              .join(names_r, ["fp", "r"]).select("fp", "block", "name"))
    shared = (blocks.join(clash, "fp", "left_semi").join(ranked, ["fp", "block"])
              .select("rid", "pos", "name"))
    alone = (occurrences.join(clash, "fp", "left_anti").join(names, "fp")
             .select("rid", "n", "pos", "name"))
    return alone.unionByName(occurrences.join(clash, "fp", "left_semi").select("rid", "n", "pos")
                             .join(shared, ["rid", "pos"]).select("rid", "n", "pos", "name"))


def document_names(docs: DataFrame, block_chars: int = BLOCK_CHARS,
                   fingerprint=F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(documents, identities): ``documents`` has one row per input row with
    rid, doc_id, n_chars, text_sha256; ``identities`` has rid, level, name.

    ``docs`` has rid, doc_id and text.  ``rid`` only separates rows whose
    doc_id repeats.
    """
    base = docs.select("rid", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("rid", "doc_id", F.length("text").cast("long").alias("n_chars"),
                       strip_white_space(F.col("text")).alias("norm"))
    cut = base.withColumn("blocks", _blocks(F.col("norm"), block_chars))
    table = store(cut.select("rid", "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"),
                             F.transform("blocks", lambda b: fingerprint(b)).alias("fps")), "documents")
    blocks = (cut.select("rid", F.posexplode("blocks").alias("pos", "block"))
              .withColumn("fp", fingerprint(F.col("block"))))
    occurrences = table.select("rid", F.size("fps").alias("n"), F.posexplode("fps").alias("pos", "fp"))
    level, rows = 0, store(_block_names(blocks, occurrences), "level0")
    longest = table.agg(F.max(F.size("fps"))).first()[0] or 1
    done = []
    while True:
        done.append(rows.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        pairs = (rows.filter("n > 1").groupBy("rid", "n", F.shiftright("pos", 1).alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")))
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"])
        level, longest = level + 1, (longest + 1) // 2
        rows = store(pairs.join(names, ["a", "b"])
                     .select("rid", F.expr("int((n + 1) div 2)").alias("n"), "pos", "name"), f"level{level}")
    identities = done[0]
    for x in done[1:]:
        identities = identities.unionByName(x)
    return table.drop("fps"), identities


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS, fingerprint=F.xxhash64, row_col: str | None = None) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Of equal texts the row with the most code points in the original text
    stays, then the smallest doc_id (null ids last), then the first row.  A
    null text counts as empty; all empty texts are one group.  Repeated rows
    are members of their group like any other; exactly one row of a group has
    ``kept``.  An empty table gives an empty result.
    """
    with passing(docs.sparkSession) as keep:
        narrow = numbered(docs, row_col, doc_id=(id_col, "long"), text=(text_col, "string"))
        table, identities = document_names(narrow, block_chars, fingerprint)
        rows = keep(table.join(identities, "rid").withColumn("identity", F.struct("level", "name")), "identities")
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("d"), (-F.col("rid")).alias("r"))).alias("best")
    groups = (rows.groupBy("identity").agg(best, F.count("*").alias("group_size"))
              .select("identity", "group_size", (-F.col("best.d")).alias("keep_id"), (-F.col("best.r")).alias("keep_rid")))
    return (spread_join(rows.drop("level", "name"), store(groups, "groups"), "identity", "rid")
            .select("rid", "doc_id", "keep_id", "group_size",
                    (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"))
