"""Chat transcripts from event logs, rendered with marks that no text can forge.

A log has one row per event: conversation, sequence number, kind, message, role and text. Logs are
partitioned by conversation once; in there, events are sorted by sequence and folded with windows:

* ``start`` opens a message, its text is the first part (a second ``start`` begins it anew);
* ``delta``, and any kind not named here, appends text;
* ``edit`` replaces the text so far, later messages stay;
* ``regenerate`` begins the text anew and drops the messages opened since its own was.

Only events that survive are gathered, so a long log with a short outcome stays small. A rendered
conversation is one row, which is Spark's bound on its length; sorting and folding spill.

A message renders as ``<turn>role<text>text</turn>`` and a line feed. Inside roles and texts the
escape character is doubled and the first character of every mark is spelled with it, so marks never
occur there and ``unescaped`` gives the text back exactly. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.binding import bind
from ledgerspark.functions.text import quote_regex

START, DELTA, EDIT, REGENERATE = "start", "delta", "edit", "regenerate"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Template:
    """Marks around a message. Each mark begins with ``guard``, and only marks hold it."""

    before: str = "<turn>"
    between: str = "<text>"
    after: str = "</turn>\n"
    guard: str = "<"
    guard_letter: str = "l"
    escape: str = "\\"

    def __post_init__(self):
        marks = (self.before, self.between, self.after)
        if len(self.guard) != 1 or len(self.escape) != 1 or self.guard == self.escape:
            raise ValueError("guard and escape are two different characters")
        if len(set(marks)) < 3 or any(not m.startswith(self.guard) or self.escape in m for m in marks):
            raise ValueError("marks are distinct, begin with the guard and don't hold the escape character")

    def escaped(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        return F.replace(doubled, F.lit(self.guard), F.lit(self.escape + self.guard_letter))

    def unescaped(self, text: Column) -> Column:
        # an escaped text has no guard, so guards can stand for doubled escapes meanwhile
        single = F.replace(text, F.lit(self.escape * 2), F.lit(self.guard))
        spelled = F.replace(single, F.lit(self.escape + self.guard_letter), F.lit(self.escape))
        return F.translate(spelled, self.guard + self.escape, self.escape + self.guard)


def fold_events(
    events: DataFrame,
    conversation: str = "conv_id",
    sequence: str = "seq",
    kind: str = "kind",
    message: str = "message",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conversation, position, role, text): the messages that are left when a log ends.

    Positions count the log's events, so they order messages but have gaps. Events of equal sequence,
    NULL first, are taken by message, kind, role and text. A NULL message is one of its own; the first
    role that isn't NULL counts, else the empty one; NULL texts are empty. Events of a dropped message
    don't bring it back, its regenerations still drop what followed. Rows without a conversation form
    one with a NULL id. Other columns are ignored; an empty table gives no rows.
    """
    log = events.select(
        F.col(f"`{conversation}`").alias("conv"),
        F.col(f"`{sequence}`").alias("seq"),
        F.coalesce(F.col(f"`{kind}`"), F.lit(DELTA)).alias("kind"),
        F.col(f"`{message}`").alias("message"),
        F.col(f"`{role}`").alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).repartition("conv")
    order = Window.partitionBy("conv").orderBy(F.col("seq").asc_nulls_first(), "message", "kind", "role", "text")
    log = log.withColumn("place", F.row_number().over(order).cast("long"))
    log = log.withColumn("own", F.when(F.col("message").isNull(), F.col("place")))
    of_message = Window.partitionBy("conv", "message", "own")
    begins = F.max(F.when(F.col("kind").isin(START, EDIT, REGENERATE), F.col("place")))
    log = log.select(
        "*",
        F.min("place").over(of_message).alias("opened"),
        begins.over(of_message).alias("begun"),
        F.max(F.when(F.col("kind") == REGENERATE, F.col("place"))).over(of_message).alias("rewound"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("place", "role"))).over(of_message)["role"].alias("speaker"),
    )
    before = Window.partitionBy("conv").orderBy("opened").rangeBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("dropped_at", F.max("rewound").over(before))
    live = log.filter(
        (F.col("dropped_at").isNull() | (F.col("dropped_at") < F.col("opened")))
        & (F.col("begun").isNull() | (F.col("place") >= F.col("begun")))
    )
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return live.groupBy("conv", "opened").agg(
        F.coalesce(F.first("speaker"), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    ).select(F.col("conv").alias(conversation), F.col("opened").alias("position"), "role", "text")


def render(
    messages: DataFrame, template: Template | None = None, conversation: str = "conv_id", learned: tuple[str, ...] = (ASSISTANT,)
) -> DataFrame:
    """(conversation, formatted, loss_spans): one transcript per conversation, and what to learn of it.

    ``loss_spans`` are the (begin, end) bytes, in UTF-8 and end exclusive, of the escaped texts of the
    learned roles. ``messages`` is as ``fold_events`` gives it, whose partitioning is used again.
    """
    template = template or Template()
    head = F.concat(F.lit(template.before), template.escaped(F.col("role")), F.lit(template.between))
    turns = messages.select(
        F.col(f"`{conversation}`").alias("conv"), "position", "role", head.alias("head"), template.escaped(F.col("text")).alias("body")
    )
    size = F.octet_length("head") + F.octet_length("body") + len(template.after.encode())
    earlier = Window.partitionBy("conv").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(size.cast("long")).over(earlier), F.lit(0)) + F.octet_length("head")
    turns = turns.select(
        "conv",
        F.struct(
            "position",
            F.concat("head", "body", F.lit(template.after)).alias("turn"),
            F.col("role").isin(*learned).alias("learned"),
            begin.alias("begin"),
            (begin + F.octet_length("body")).alias("end"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end")))
    return whole.select(
        F.col("conv").alias(conversation),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def format_log(events: DataFrame, template: Template | None = None, **columns: str) -> DataFrame:
    """(conversation, formatted, loss_spans) of an event log; see ``fold_events`` and ``render``."""
    return render(fold_events(events, **columns), template, columns.get("conversation", "conv_id"))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The (role, text) pairs of a transcript."""
    template = template or Template()
    pieces = F.split(formatted, quote_regex(template.after))

    def turn(piece: Column) -> Column:
        parts = F.split(F.substring(piece, len(template.before) + 1, 2**31 - 1), quote_regex(template.between))
        return bind(
            parts, lambda p: F.struct(template.unescaped(p[0]).alias("role"), template.unescaped(p[1]).alias("text"))
        )

    return F.transform(bind(pieces, lambda p: F.slice(p, 1, F.size(p) - 1)), turn)


def read_loss(formatted: Column, spans: Column, template: Template | None = None) -> Column:
    """The texts under the loss mask, in order."""
    template = template or Template()

    def cut(data: Column) -> Column:
        part = lambda s: F.substring(data, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))
        return F.transform(spans, lambda s: template.unescaped(F.decode(part(s), "UTF-8")))

    # bytes are cut in place; code points would be counted from the beginning for every span
    return bind(F.encode(formatted, "UTF-8"), cut)


def digests(transcripts: DataFrame, template: Template | None = None, conversation: str = "conv_id") -> DataFrame:
    """Counts and hashes of transcripts, taken from what is read back of them."""
    turns = read_turns(F.col("formatted"), template)
    read = transcripts.select(
        conversation, "formatted", turns.alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans"), template), "").alias("loss")
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        conversation,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
