"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (the stretches between line breaks,
in pieces of at most ``PIECE`` characters).  Each hashes to ``LANES`` bits; a
fingerprint is the lane-wise sum of the bits over all pieces, modulo 2**20,
with the number of pieces behind it.  So order doesn't matter, equal multisets have
equal fingerprints, and pieces are put in or taken out by adding or
subtracting theirs.  Three lanes lie in one long, each under a guard bit, so
adding whole longs adds lanes.

Taken as signs, the lanes are also a sketch of the second moment: the mean
square of the difference of two fingerprints estimates how many pieces differ.
``likeness`` is one minus that, as a share of both texts' own moments.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaserisk.llm.text import row_key, stored, text_column
from leaserisk.session import checkpoint_dir

PIECE = 64
LANE_BITS, IN_LONG, HASHES = 20, 3, 2
_STEP = LANE_BITS + 1
LONGS = HASHES * _STEP
LANES = LONGS * IN_LONG
_ONE = sum(1 << (_STEP * j) for j in range(IN_LONG))
_FULL = (1 << LANE_BITS) - 1
_MASK = _ONE * _FULL


def _piece_vector(piece: Column) -> Column:
    """The lanes of one piece: bit i + 21 j of a hash goes to lane j of long i."""
    hashes = [F.xxhash64(piece, F.lit(i)) for i in range(HASHES)]
    return F.array(*[F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_ONE)) for h in hashes for i in range(_STEP)])


def fingerprint(text: Column) -> Column:
    """array<long>: ``LONGS`` sums of lanes, then the number of pieces; an empty text is all zeros."""
    pieces = F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0))
    zero = F.array_repeat(F.lit(0).cast("long"), LONGS)
    sums = F.aggregate(pieces, zero, lambda acc, p: F.zip_with(
        acc, _piece_vector(p), lambda a, b: (a + b).bitwiseAND(F.lit(_MASK))))
    return F.array_append(sums, F.size(pieces).cast("long"))


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' pieces together."""
    lanes = F.zip_with(F.slice(a, 1, LONGS), F.slice(b, 1, LONGS), lambda x, y: (x + y).bitwiseAND(F.lit(_MASK)))
    return F.array_append(lanes, a[LONGS] + b[LONGS])


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of a's pieces without b's."""
    guard = F.lit(_ONE << LANE_BITS)  # lent to each lane, so no lane borrows from the next
    lanes = F.zip_with(F.slice(a, 1, LONGS), F.slice(b, 1, LONGS),
                       lambda x, y: (x.bitwiseOR(guard) - y).bitwiseAND(F.lit(_MASK)))
    return F.array_append(lanes, a[LONGS] - b[LONGS])


def _signed_sum(count: Column, n: Column) -> Column:
    """2 c - n as a double, c being the count nearest n / 2 that is ``count`` modulo 2**LANE_BITS."""
    low = F.shiftright(n, 1) - (1 << (LANE_BITS - 1))
    return ((low + (count - low).bitwiseAND(F.lit(_FULL))) * 2 - n).cast("double")


def _lane(x: Column, j: int) -> Column:
    return F.shiftrightunsigned(x, _STEP * j).bitwiseAND(F.lit(_FULL))


def _squares(lanes: Column, n: Column) -> Column:
    """Sum over all lanes of (2 c - n) squared, c being the lane's count."""
    def of(x: Column) -> Column:
        signs = [_signed_sum(_lane(x, j), n) for j in range(IN_LONG)]
        return sum((s * s for s in signs[1:]), signs[0] * signs[0])

    return F.aggregate(F.slice(lanes, 1, LONGS), F.lit(0.0), lambda acc, x: acc + of(x))


def _difference(a: Column, b: Column) -> Column:
    """The same of the difference of two fingerprints."""
    return _squares(remove(a, b), a[LONGS] - b[LONGS])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated share of pieces in common; equal fingerprints, two empty ones too, have 1.

    Lanes keep counts modulo 2**20.  Of a text's n pieces a lane counts about half, give or take the root of the sum of
    their squared numbers, so its count is known while that root is well below 2**19: for any number of different pieces that fits a
    row, but not for a piece that one text repeats over 2**19 times, where the estimate means nothing (equality, insertion
    and deletion hold for all).
    """
    both = _squares(a, a[LONGS]) + _squares(b, b[LONGS])
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - _difference(a, b) / F.greatest(both, F.lit(1.0))))


def as_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), "-")


def next_keys(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, a, b; distinct) with the key that follows by (doc_id, a, b), nulls first; the first after the last.

    Rows are dealt into ranges of that order, cut where a sample of them puts equal numbers, and stored with
    their range; windows run inside a range, and one more over the first rows of the ranges, of which there are as many
    as shuffle partitions.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("a").asc(), F.col("b").asc()]
    ranged = stored(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    row = F.struct("doc_id", "a", "b")
    inside = Window.partitionBy("range").orderBy(*order)
    firsts = ranged.groupBy("range").agg(F.min(row).alias("first"))
    over = Window.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(over), F.min("first").over(
        over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    follows = ranged.withColumn("following", F.lead(row).over(inside)).join(F.broadcast(firsts), "range")
    following = F.coalesce("following", "after")
    return follows.select("a", "b", following["a"].alias("next_a"), following["b"].alias("next_b"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has the last quarter of the code points replaced by as many (or all) from the
    start of the next document by (doc_id, text hash).  Rows equal in id and text take
    one place in that order and have equal results.  Null texts are empty; a
    lone document is its own next one; an empty table gives an empty result.
    """
    checkpoint_dir(docs.sparkSession)
    key = row_key(id_col, text_col)
    rows = docs.select(key["a"].alias("a"), key["b"].alias("b"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       text_column(text_col).alias("text"))
    prints = (rows.select("a", "b", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
                          fingerprint(F.col("text")).alias("own"))
              .groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"), F.min("own").alias("own"))
              .checkpoint())
    order = next_keys(prints.select("doc_id", "a", "b")).checkpoint()
    of_next = prints.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("own").alias("of_next"))
    known = prints.join(order, ["a", "b"]).join(of_next, ["next_a", "next_b"])
    wanted = prints.join(order, ["a", "b"]).select(F.col("a").alias("for_a"), F.col("b").alias("for_b"), F.col("next_a").alias("a"),
                                                   F.col("next_b").alias("b"), F.expr("n_chars div 4").cast("int").alias("n_new"))
    texts = rows.select("a", "b", "text")
    heads = (texts.join(wanted, ["a", "b"]).groupBy("for_a", "for_b")
             .agg(F.max(F.left("text", F.col("n_new"))).alias("head")))
    heads = heads.select(F.col("for_a").alias("a"), F.col("for_b").alias("b"), "head")
    extra = known.join(heads, ["a", "b"])
    edited = texts.join(extra, ["a", "b"]).select("doc_id", "n_chars", "own", "of_next", F.concat(
        F.left("text", (F.col("n_chars") - F.expr("n_chars div 4")).cast("int")), F.col("head")).alias("edited"))
    sketched = edited.select("doc_id", "n_chars", "own", "of_next", F.sha2("edited", 256).alias("edited_sha256"),
                             fingerprint(F.col("edited")).alias("of_edited"))
    own, of_edited, of_next = F.col("own"), F.col("of_edited"), F.col("of_next")
    return sketched.select("doc_id", "n_chars", "edited_sha256", as_string(own).alias("fingerprint"),
                           as_string(of_edited).alias("edited_fingerprint"), likeness(own, of_edited).alias("near_edited"),
                           likeness(own, of_next).alias("near_next"))
