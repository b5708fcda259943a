"""Chat formatting in budgeted windows.

The template writes a turn as <turn NUMBER ROLE>TEXT</turn>, a repeated one as <seen NUMBER ROLE>TEXT</seen>. Inside
roles and texts & becomes &amp;, < becomes &lt; and > becomes &gt;, so no text can forge a mark, and all are undone on
reading.

Every window retains the system turn (a first turn with role system), and a quarter of what it leaves of the budget is
set aside for history. Prefix sums of turn tokens then choose the windows: turns whose sum of tokens before them falls
into the same cell of half the rest form one; a turn longer than a cell stands by itself. A window repeats up to
`history` turns of the window before, as far as they fit beside its own; repeated turns are masked, so each assistant
text is a target once. Hence a window exceeds the budget only where one turn does not fit beside the system turn; that
turn stands whole, without history. A system turn of more than half the budget is not retained: it is a turn like
others, and so the first window alone has it.

Edge cases: null text is empty; a null role is the empty role and never a target; turns with equal numbers are taken
in the order of role and text, repeated rows each count; rows with a null conv_id form one conversation; an empty table
gives an empty result; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def windows(turns: DataFrame, budget: int = 1024, history: int = 2, per_token: int = 4) -> DataFrame:
    """One row per window: conv_id, window, text, targets (spans of code points under the loss mask, end exclusive).

    Tokens are estimated as UTF-8 bytes / per_token plus 4 for a turn's marks, so that even empty turns have a cost
    and the turns of one window are bounded.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", F.ceil(F.octet_length("text") / per_token).cast("long") + 4)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("no", F.row_number().over(order) - 1)
    rows = rows.withColumn("system", (F.col("no") == 0) & (F.col("role") == "system") & (F.col("tokens") <= budget // 2))
    whole = Window.partitionBy("conv_id")
    # What the system turn leaves, and what the turns of a window cost on top of it
    rows = rows.withColumn("room", budget - F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole)).withColumn("tokens", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    rows = rows.withColumn("repeat", F.floor(F.col("room") / 4)).withColumn("size", F.greatest(F.floor((F.col("room") - F.col("repeat")) / 2), F.lit(1))).withColumn("long", F.col("tokens") > F.col("size"))
    # A long turn begins a stretch and the turn after it another
    rows = rows.withColumn("new", F.col("long") | F.coalesce(F.lag("long").over(order), F.lit(False))).withColumn("stretch", F.sum(F.col("new").cast("int")).over(upto))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("no")
    rows = rows.withColumn("before", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).withColumn("cell", F.floor(F.col("before") / F.col("size")))
    turned = (F.col("stretch") != F.lag("stretch", 1, -1).over(order)) | (F.col("cell") != F.lag("cell", 1, -1).over(order))
    rows = rows.withColumn("window", F.sum(turned.cast("int")).over(upto) - 1)
    # Tokens from here to the window's end: what a next window would repeat
    tail = Window.partitionBy("conv_id", "window").orderBy(F.desc("no"))
    ends = F.sum("tokens").over(tail.rowsBetween(Window.unboundedPreceding, 0))
    following = F.sum("tokens").over(whole.orderBy("window").rangeBetween(1, 1))
    again = (F.row_number().over(tail) <= history) & (ends <= F.col("repeat")) & (ends <= F.col("room") - following) & ~F.col("system")
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False))).withColumn("last", F.max("window").over(whole))
    where = F.when(F.col("system"), F.sequence(F.lit(0).cast("long"), F.col("last"))).when(F.col("again"), F.array(F.col("window"), F.col("window") + 1)).otherwise(F.array(F.col("window")))
    placed = rows.withColumn("at", F.explode(where)).withColumn("seen", F.col("at") != F.col("window"))

    mark = F.when(F.col("seen"), F.lit("seen")).otherwise(F.lit("turn"))
    head = F.concat(F.lit("<"), mark, F.lit(" "), F.col("no").cast("string"), F.lit(" "), escape(F.col("role")), F.lit(">"))
    body = escape(F.col("text"))
    parts = placed.select("conv_id", F.col("at").alias("window"), "no", head.alias("head"), body.alias("body"), F.concat(F.lit("</"), mark, F.lit(">")).alias("foot"), ((F.col("role") == "assistant") & ~F.col("seen")).alias("target"))
    listed = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("no", "head", "body", "foot", "target"))).alias("p"))

    def spans(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["head"])
        end = start + F.char_length(x["body"])
        kept = F.when(x["target"], F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["out"])
        return F.struct((end + F.char_length(x["foot"])).alias("at"), kept.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["foot"])), "")
    return listed.select("conv_id", "window", text.alias("text"), F.aggregate("p", zero, spans)["out"].alias("targets"))


#: One turn without its closing mark: mark, number, role, text.
TURN = r"(?s)^<(turn|seen) ([0-9]+) ([^>]*)>(.*)$"


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns that windows hold, from their texts alone: conv_id, window, no, seen, role, text."""
    pieces = F.split("text", "</(?:turn|seen)>", -1)
    one = formatted.select("conv_id", "window", F.explode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("x"))
    part = [F.regexp_extract("x", TURN, i) for i in range(1, 5)]
    return one.select("conv_id", "window", part[1].cast("long").alias("no"), (part[0] == "seen").alias("seen"), unescape(part[2]).alias("role"), unescape(part[3]).alias("text"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted windows say of each conversation: its turns, its loss text and their hashes."""
    turns = read_back(formatted).where(~F.col("seen"))
    all_turns = F.array_sort(F.collect_list(F.struct("no", "role", "text")))
    said = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sha2(F.array_join(F.transform(all_turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"))
    masked = F.array_join(F.transform("targets", lambda t: unescape(F.substring(F.col("text"), t["start"] + 1, t["end"] - t["start"]))), "")
    in_order = F.array_sort(F.collect_list(F.struct("window", masked.alias("x"))))
    loss = formatted.groupBy("conv_id").agg(F.array_join(in_order["x"], "").alias("loss"), F.sum(F.char_length("text")).alias("formatted_chars"))
    loss = loss.select("conv_id", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    return said.join(loss.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
