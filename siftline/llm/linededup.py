"""Line dedup: overlapping windows of three lines.

Every three consecutive lines that have a word are hashed (128 bits). Where a window is found again, later in the
document or in a document with a larger id, it is a repeat; the lines that repeats cover, merged where they overlap,
are removed.

Defined results: white space at a line's ends doesn't count; lines without a word are in no window and go with the
line before them; documents of fewer than three lines with words stay as they are, null texts stay null. Of repeated
rows (the same id and text) neither is later than the other: they keep or lose the same lines. Different texts of one
id are different documents, in the order of a hash of the text; so are rows with a null id, which come last. An empty
table gives an empty result. Extra columns pass through, whatever their names, but for n_lines, n_removed and
removed_lines, in place of which the result has its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops, workspace

LINES = 3
DOCUMENT = ("_siftline_id", "_siftline_text")
#: Bits of the table that tells which documents may have lines to lose, and bits of one of its rows: 8 MB in all.
MARK_BITS, MARK_WIDTH = 1 << 26, 1 << 15
#: A line break before a line with a word: what it parts are lines with words, each with the empty ones that follow.
_BREAK = r"\n(?=[^\n]*[^\t-\r ])"


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(textops.SPACES))


def _worded(text: Column) -> Column:
    """The lines with words, each with what follows before the next; without the blank lines at the text's start."""
    return F.filter(F.split(text, _BREAK, -1), lambda x: _trimmed(x) != "")


def _identity(key: str, text: str) -> list[Column]:
    """What tells documents apart, in their order: the id (those without one last) and a hash of the text."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("_siftline_id"), F.xxhash64(F.col(text)).alias("_siftline_text")]


def windows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """_siftline_id, _siftline_text, pos, h1, h2 of every window; pos counts lines with words."""
    worded = docs.select(*_identity(key, text), F.transform(_worded(F.col(text)), _trimmed).alias("w")).where(F.size("w") >= LINES)
    parts = lambda i: [F.get("w", i + k) for k in range(LINES)]
    both = F.transform(
        F.sequence(F.lit(0), F.size("w") - LINES),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(*parts(i)).alias("h1"), F.xxhash64(F.lit(LINES), *parts(i)[::-1]).alias("h2")),
    )
    return worded.select(*DOCUMENT, F.explode(both).alias("x")).select(*DOCUMENT, "x.pos", "x.h1", "x.h2")


def _split(docs: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (with DOCUMENT) in two parts: those that are surely not in ``starts``, and the others.

    ``starts`` grows with the documents, so it can't go to all tasks; a table of bits, whose size is fixed, can. A
    document whose bit isn't set stays where it is. The more bits are set, the more documents are shuffled for nothing.
    """
    slot = F.pmod(F.xxhash64(*DOCUMENT), F.lit(MARK_BITS))
    bucket, at = F.floor(slot / MARK_WIDTH).alias("_siftline_bucket"), F.pmod(slot, F.lit(MARK_WIDTH))
    marks = workspace.stage(starts.groupBy(bucket).agg(F.bitmap_construct_agg(at).alias("_siftline_bits")), "line-marks")
    met = docs.select("*", bucket, at.alias("_siftline_at")).join(F.broadcast(marks), "_siftline_bucket", "left")  # 8 MB at most
    byte = F.expr("cast(conv(hex(substring(_siftline_bits, cast(_siftline_at div 8 + 1 AS INT), 1)), 16, 10) AS INT)")
    maybe = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_siftline_at % 8 AS INT))")) != 0, F.lit(False))
    return met.where(~maybe).select(*docs.columns), met.where(maybe).select(*docs.columns)


def remove_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` cleaned, and n_lines (with a word), n_removed (of these), removed_lines (their text)."""
    found = workspace.stage(windows(docs, text, key), "line-windows")
    firsts = found.groupBy("h1", "h2").agg(F.min(F.struct(*DOCUMENT, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written first, so that the windows of a very common passage can be split over tasks in the join.
    firsts = workspace.stage(firsts, "line-firsts")
    again = found.join(firsts, ["h1", "h2"]).where(F.struct(*DOCUMENT, "pos") != F.col("first"))
    starts = workspace.stage(again.groupBy(*DOCUMENT).agg(F.array_sort(F.collect_set("pos")).alias("_siftline_starts")), "line-starts")
    # The input's columns travel in a struct, whose fields can't clash with anything here.
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_lines")]
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text]).alias("_siftline_row")
    raw = F.col("_siftline_raw")

    def result(rows: DataFrame, new_text: Column, n_lines: Column, n_removed: Column, removed: Column) -> DataFrame:
        own = ("_siftline_new", "_siftline_n", "_siftline_gone", "_siftline_list")
        rows = rows.select("_siftline_row", *[c.alias(n) for c, n in zip((new_text, n_lines, n_removed, removed), own)])
        back = [F.col(own[0] if c == text else f"_siftline_row.c{i}").alias(c) for i, c in enumerate(names)]
        return rows.select(*back, *[F.col(n).alias(as_) for n, as_ in zip(own[1:], ("n_lines", "n_removed", "removed_lines"))])

    n_lines = F.coalesce(F.size("_siftline_lines"), F.lit(0))
    nothing = F.array().cast("array<string>")
    clean, suspect = _split(docs.select(others, F.col(text).alias("_siftline_raw"), *_identity(key, text)), starts)
    clean = result(clean.withColumn("_siftline_lines", _worded(raw)), raw, n_lines, F.lit(0), nothing)
    met = suspect.join(starts.hint("merge"), list(DOCUMENT), "left")
    covered = F.array_distinct(F.flatten(F.transform("_siftline_starts", lambda p: F.sequence(p, p + (LINES - 1)))))
    met = met.withColumns({"_siftline_lines": _worded(raw), "_siftline_covered": covered})
    whole = F.sequence(F.lit(0), F.size("_siftline_lines") - 1)
    kept = F.transform(F.array_except(whole, "_siftline_covered"), lambda i: F.get("_siftline_lines", i))
    gone = F.filter(F.transform("_siftline_covered", lambda i: F.get("_siftline_lines", i)), lambda x: x.isNotNull())
    some = F.coalesce((F.size("_siftline_covered") > 0) & (F.size("_siftline_lines") >= LINES), F.lit(False))
    removed = F.when(some, F.transform(gone, _trimmed)).otherwise(nothing)
    cleaned = result(met, F.when(some, F.array_join(kept, "\n")).otherwise(raw), n_lines, F.when(some, F.size(gone)).otherwise(0), removed)
    return clean.unionByName(cleaned)
