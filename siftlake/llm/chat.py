"""Chat formatting by multi-party perspective rotation.

A dialogue of n participants gives n training examples: for each participant the dialogue is rendered
with that speaker as the assistant and everyone else as a user with a name. The loss mask covers what
the assistant says (its text and the end mark), as character spans of the rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, text_of

#: Marks of the rendered text, and the speaker who takes no part but sets the scene.
START, END, SCENE = "<|im_start|>", "<|im_end|>", "system"
#: Turns of one dialogue in one example; a longer dialogue goes on in the next part, which opens with the scene again.
TURNS_PER_PART = 512


def _safe(c: Column) -> Column:
    """Without "<|", reversibly: a "<" that a "|" follows, maybe after backslashes, gets one backslash more."""
    return F.regexp_replace(c, F.lit(r"<(\\*)\|"), F.lit(r"<$1\\|"))


def _one_line(c: Column) -> Column:
    """Without line ends, reversibly: backslash, line feed and carriage return become \\\\, \\n and \\r."""
    for what, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(what), F.lit(shown))
    return c


def messages(turns: DataFrame, conv_col="conv_id", turn_col="turn", speaker_col="role", text_col="text") -> DataFrame:
    """(conv_id, turn, speaker, text, times): equal rows are one row with a count; null speaker: "unknown"."""
    rows = turns.select(
        column(turns, conv_col).alias("conv_id"),
        column(turns, turn_col).cast("long").alias("turn"),
        F.coalesce(F.nullif(column(turns, speaker_col).cast("string"), F.lit("")), F.lit("unknown")).alias("speaker"),
        text_of(column(turns, text_col)).alias("text"),
    )
    return rows.groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("times"))


def rotate(turns: DataFrame, scene: str = SCENE, per_part: int | None = TURNS_PER_PART, **columns: str) -> DataFrame:
    """A row per dialogue, part and participant who speaks in it: conv_id, assistant, part, n_messages, n_assistant, text, spans.

    spans: array of (start, end) character offsets into text on which the loss is taken. Every speaker
    but `scene` is a participant; a dialogue of scene-setting alone gives no row. per_part=None renders
    each dialogue whole, as part 0, whatever its length. Otherwise part k holds turns k * per_part up to
    (k + 1) * per_part - 1, so that the longest dialogue is many rows, and every part but the one that has
    it already opens with the dialogue's first scene-setting line (the least by turn, null last, then text);
    one that has no turn opens only parts of null turns.
    Null turns come first: in part 0 of a whole dialogue, else dealt by hash into parts of about per_part
    different rows, numbered down from -1 or, where there are negative turns, from below their parts.
    Rows of one turn are ordered by speaker, then text; repeated rows are rendered as often as they occur.
    A null text is rendered as the empty text, a null or empty speaker as "unknown". All rows without a
    dialogue id are one dialogue, whose id is null. Texts and names lose "<|" by a backslash, names their
    line ends, both reversibly, so that no text can end a message or a header.
    """
    said = messages(turns, **columns)
    if per_part is None:
        said = said.withColumn("part", F.lit(0).cast("long"))
    else:
        placed = said.filter("turn IS NOT NULL").withColumn("part", F.floor(F.col("turn") / per_part).cast("long"))
        below = said.filter("turn IS NULL OR turn < 0").groupBy("conv_id").agg(
            F.ceil(F.count_if(F.col("turn").isNull()) / per_part).alias("parts"),
            F.least(F.lit(0), F.floor(F.min("turn") / per_part)).alias("first"),
        )
        dealt = said.filter("turn IS NULL").alias("s").join(below.alias("b"), F.expr("s.conv_id <=> b.conv_id")).select(
            "s.*", (F.col("first") - 1 - F.pmod(F.xxhash64("s.speaker", "s.text"), F.col("parts"))).cast("long").alias("part")
        )
        said = placed.unionByName(dealt)
    said = said.select(
        "conv_id", "part", F.col("turn").isNull().alias("unplaced"), F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "speaker", "times",
        _safe(_one_line(F.col("speaker"))).alias("name"), _safe(F.col("text")).alias("text"), F.col("text").alias("raw"),
    )
    people = said.filter(F.col("speaker") != scene).select("conv_id", "part", F.col("speaker").alias("assistant")).distinct()
    # A dialogue's part is gathered once, then shown from each participant's side.
    line = F.struct("turn", "speaker", "raw", "name", "text", "times")
    parts = said.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max("unplaced").alias("unplaced"))
    parts = parts.withColumn("lines", F.flatten(F.transform("lines", lambda x: F.array_repeat(x, x.times.cast("int")))))
    if per_part is not None:
        opens = said.filter(F.col("speaker") == scene).groupBy("conv_id").agg(F.min(F.struct("unplaced", "turn", "raw", "part", "speaker", "name", "text")).alias("o"))
        opening = F.struct("o.turn", "o.speaker", "o.raw", "o.name", "o.text", F.lit(1).cast("long").alias("times"))
        parts = parts.alias("p").join(opens.alias("q"), F.expr("p.conv_id <=> q.conv_id"), "left").select(
            "p.conv_id", "p.part",
            F.when(F.expr("o IS NOT NULL AND o.part <> p.part AND (p.unplaced OR NOT o.unplaced)"), F.concat(F.array(opening), F.col("lines"))).otherwise(F.col("lines")).alias("lines"),
        )
    views = parts.alias("p").join(people.alias("w"), F.expr("p.conv_id <=> w.conv_id AND p.part = w.part")).select("p.conv_id", "p.part", "assistant", "lines")

    own = lambda x: x.speaker == F.col("assistant")
    head = lambda x: F.when(own(x), F.lit(f"{START}assistant\n")).when(
        x.speaker == scene, F.lit(f"{START}{scene}\n")
    ).otherwise(F.concat(F.lit(f"{START}user name="), x["name"], F.lit("\n")))
    shown = F.transform("lines", lambda x: F.struct(
        head(x).alias("head"), F.concat(x.text, F.lit(END)).alias("body"), own(x).alias("own"),
    ))
    views = views.withColumn("shown", shown)
    text = F.array_join(F.transform("shown", lambda m: F.concat(m["head"], m.body, F.lit("\n"))), "")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, m):
        start = acc["at"] + F.char_length(m["head"])
        end = start + F.char_length(m.body)
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"), F.when(m.own, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return views.select(
        "conv_id", "assistant", "part",
        F.size("shown").cast("long").alias("n_messages"),
        F.size(F.filter("shown", lambda m: m.own)).cast("long").alias("n_assistant"),
        text.alias("text"),
        F.aggregate("shown", empty, step, lambda a: a.spans).alias("spans"),
    )
