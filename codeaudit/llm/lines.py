"""Line dedup by overlapping windows (operator 7); DataFrame functions only.

Lines are the parts of a text between "\\n".  Every `window` neighbouring lines
(not all blank) are hashed; of equal windows anywhere in the table the first,
by (doc_id, row, line), stays and every line of the later ones goes, so
overlapping windows merge into whole removed passages.  A removed line always
has an equal line that stays: its window's first copy lies earlier, and so on
to one that nothing earlier repeats.

Defined results: a null text stays null, without lines; texts of fewer lines
than a window stay as they are; a text whose lines all go becomes empty; null
doc_ids come last; repeated rows are later copies; texts are read whole, however
long; empty tables give no rows;
other columns are carried unread, whatever their names (`out` excepted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import ROW, rows_of, written


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 3,
                out: str = "line_dedup") -> DataFrame:
    """`docs` with the text that stays, and a struct `out` of n_lines,
    n_removed and removed (line numbers from 0, sorted)."""
    base = rows_of(docs).select(
        "d", F.col(f"d.{doc_id}").alias("i"), F.col(f"d.{text}").alias("t"), ROW)
    spots = written(base.select(ROW, "i", F.split("t", "\n", -1).alias("l")).select(ROW, "i", F.expr(f"""explode(filter(transform(
        if(size(l) >= {window}, sequence(1, size(l) - {window - 1}), cast(array() as array<int>)),
        p -> struct(p - 1 as pos, array_join(slice(l, p, {window}), '\n') as w)), x -> x.w rlike '\\\\S'))""").alias("x")
        ).select(ROW, "i", "x.pos", F.unhex(F.md5("x.w")).alias("h")), "windows")
    repeated = (spots.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(
        F.col("i").isNull().alias("late"), "i", ROW, "pos")).alias("f")).filter("n > 1")
        .select("h", F.col(f"f.{ROW}").alias("r0"), F.col("f.pos").alias("p0")))
    later = spots.join(repeated, "h").filter(f"not ({ROW} = r0 and pos = p0)")
    gone = later.groupBy(ROW).agg(F.expr(
        f"sort_array(array_distinct(flatten(transform(collect_set(pos), p -> sequence(p, p + {window - 1})))))").alias("gone"))
    none = F.expr("cast(array() as array<int>)")
    wide = base.join(gone, ROW, "left").withColumn("l", F.split("t", "\n", -1)).select(
        "d", F.expr("if(gone is null, t, array_join(transform(array_except(sequence(0, size(l) - 1), gone), p -> get(l, p)), '\n'))"
                    ).alias("stays"),
        F.struct(F.when(F.col("t").isNull(), 0).otherwise(F.size("l")).cast("long").alias("n_lines"),
                 F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                 F.coalesce("gone", none).alias("removed")).alias("made"))
    same = lambda a, b: a.lower() == b.lower()
    return wide.select(*[(F.col("stays") if same(c, text) else F.col("d")[c]).alias(c)
                         for c in docs.columns if not same(c, out)], F.col("made").alias(out))
