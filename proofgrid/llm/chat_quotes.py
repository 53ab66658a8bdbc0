"""Chat formatting by quotation linking.

Quoted lines (``>``, nested to any level) are split from a message's own words. Own passages and quoted passages are
normalised and hashed. An own passage is a whole body, a paragraph or a line; a quote is a run of quoted lines of one
level, and its parts are the whole run, its paragraphs and its lines. A part comes from the latest earlier message of
its conversation that has it as its own. A quote is linked to the origin of the whole run; where nobody said all of
it as one passage, to the origin that most of its parts share (then the one with more text, then the latest). A
message answers the latest message that it quotes at level one. Replies are then ordered: a message follows what it
answers, branches stay together, and quotes are gone.

The owner before a quote is looked up in turn order, first within SPAN turns and then over one row for each span,
so a passage that everyone repeats and quotes gives neither all pairs nor one long sort. The replies of a thread are a
tree; a tour that goes down and up along its branches is a list, in which pointer jumping finds how far each message
is from the end: that gives the thread's root, the depth and place, the number of the message in its thread in reply
order. No conversation is gathered in a task, and a row has a fixed width however deep it lies. Siblings are told in
the order of their turns from one sorted table, not from a window over what answers one message.

Defined cases: a null text has an empty body and no quotes; a message without conv_id or turn can't be placed and
stays alone (null parent and root); a quote that nobody said before stays unlinked; several rows of one turn are
one message for linking and keep a row each; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..operators.shared import discard, stored
from .store import PART, lean, materialize, read

_MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\bécrit|el\b.*\bescribió)\s*:\s*$", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
PARSED = "conv_id {conv}, turn long, role string, body string, own array<string>, quotes array<struct<level:int,place:int,parts:array<struct<whole:boolean,size:int,passage:string>>>>"
#: Turns that are looked up in one sort.
SPAN = 1024


def normal(passage: str) -> str:
    """Case, white space and a closing mark don't matter."""
    return _SPACE.sub(" ", passage).strip().casefold().rstrip(".!?… ")


def hashed(passage: str) -> str | None:
    text = normal(passage)
    return hashlib.sha256(text.encode()).hexdigest()[:32] if text else None


def levels(text: str) -> list[tuple[int, str]]:
    """Quote level and content of each line."""
    out = []
    for line in text.split("\n"):
        mark = _MARK.match(line)
        out.append((mark[1].count(">"), line[mark.end() :]) if mark else (0, line))
    return out


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The own words of a message, and its quoted passages (runs of lines of one level) in order.

    A line that only says who wrote what follows is neither, if a quote follows.
    """
    lines = levels(text or "")
    own, passages, run, at = [], [], [], 0
    for k, (level, line) in enumerate(lines):
        if _ATTRIBUTION.match(line):
            after = k + 1  # what follows: the first line that is deeper or has words
            while after < len(lines) and lines[after][0] <= level and not lines[after][1].strip():
                after += 1
            if after < len(lines) and lines[after][0] > level:
                continue
        if level != at and run:
            if at:
                passages.append((at, "\n".join(run)))
            run = []
        at = level
        run.append(line)
        if not level:
            own.append(line)
    if at and run:
        passages.append((at, "\n".join(run)))
    return "\n".join(own).strip("\n"), [(level, p) for level, p in passages if p.strip()]


def _passages(body: str) -> dict[str, int]:
    """Hashes of a body, its paragraphs and its lines, with the number of characters; the whole body is the first."""
    return {h: len(normal(p)) for p in (body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")) if (h := hashed(p))}


def _quotes(quoted: list[tuple[int, str]]) -> list[dict]:
    """The quotes of a message with the hashes of their parts."""
    out = []
    for place, (level, run) in enumerate(quoted):
        if whole := hashed(run):
            out.append({"level": level, "place": place, "parts": [{"whole": h == whole, "size": size, "passage": h} for h, size in _passages(run).items()]})
    return out


def parse(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with bodies, hashes of own passages, and hashes of quoted ones."""
    conv = dict(messages.dtypes)["conv_id"]
    part = pa.struct([("whole", pa.bool_()), ("size", pa.int32()), ("passage", pa.string())])
    quotes = pa.list_(pa.struct([("level", pa.int32()), ("place", pa.int32()), ("parts", pa.list_(part))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                rows = batch.slice(at, PART)
                split = [split_quotes(t) for t in rows.column(3).to_pylist()]
                # conv_id, turn and role stay in their Arrow columns: as floats beside a null, large ones would change.
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns[:3],
                        pa.array([body for body, _ in split], pa.string()),
                        pa.array([sorted(_passages(body)) for body, _ in split], pa.list_(pa.string())),
                        pa.array([_quotes(quoted) for _, quoted in split], quotes),
                    ],
                    names=["conv_id", "turn", "role", "body", "own", "quotes"],
                )

    return messages.select("conv_id", F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(lean(run), PARSED.format(conv=conv))


def _owners_before(owners: DataFrame, parts: DataFrame) -> DataFrame:
    """parts with origin: the latest turn before theirs at which owners(conv_id, passage, turn) has the passage, or null."""
    span = F.floor(F.col("turn") / SPAN)
    both = owners.withColumn("said", F.col("turn")).unionByName(parts.withColumn("part", F.lit(True)), allowMissingColumns=True).withColumn("span", span)
    key = ["conv_id", "passage", "span"]
    # A range of turns, not of rows: what is said in the turn itself isn't before it.
    inside = F.max("said").over(Window.partitionBy(*key).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    spans = both.groupBy(*key).agg(F.max("said").alias("last"))
    earlier = F.max("last").over(Window.partitionBy("conv_id", "passage").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("inside", inside).where("part").join(spans.select(*key, earlier.alias("earlier")).where("earlier is not null"), key, "left")
    return found.select(*parts.columns, F.coalesce("inside", "earlier").alias("origin"))


def link_quotes(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, place, origin: the turn of the earlier message that a quote comes from, or null."""
    placed = parsed.where("conv_id is not null and turn is not null")
    quoted = placed.select("conv_id", "turn", F.explode("quotes").alias("q")).withColumn("quote", F.monotonically_increasing_id())
    parts = quoted.select("conv_id", "turn", "quote", "q.level", "q.place", F.explode("q.parts").alias("p")).select("conv_id", "turn", "quote", "level", "place", "p.*")
    parts = materialize(parts, "parts", fold=True)
    owners = placed.select("conv_id", "turn", F.explode("own").alias("passage"))
    owners = materialize(owners.join(parts.select("conv_id", "passage").distinct(), ["conv_id", "passage"], "left_semi"), "owners", fold=True)

    quote = ["conv_id", "turn", "quote", "level", "place"]
    votes = _owners_before(owners, parts).groupBy(*quote, "origin").agg(F.max("whole").alias("whole"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct("whole", "n", "size", "origin")))
    return votes.groupBy(*quote).agg(best.alias("best")).select("conv_id", "turn", "level", "place", F.col("best.origin").alias("origin"))


def reply_order(parents: DataFrame) -> DataFrame:
    """parents(conv_id, turn, parent_turn, one row a message) -> conv_id, turn, root_turn, depth, place, by pointer jumping.

    place is 0 for the root of a thread and counts its messages in reply order. Only messages of threads with a reply
    are in the result. Each message is two steps of its thread's tour: down, when it is met, then what answers it, then
    up. A step knows the next one, and what is to come until then: messages met (met) and levels gone down less those
    gone up (down). A round looks up the next step's own values, which doubles the way; a step that has reached the
    end of its tour, the step up from the root, waits aside.
    """
    replies = parents.where("parent_turn is not null").select("conv_id", "turn", "parent_turn")
    placed = stored(numbered(replies, ["conv_id", "parent_turn", "turn"], "_at"), "replies")
    next_ = placed.select((F.col("_at") - 1).alias("_at"), F.col("conv_id").alias("_conv"), F.col("parent_turn").alias("_parent"), F.col("turn").alias("sibling"))
    siblings = placed.join(next_, "_at", "left").withColumn("sibling", F.when((F.col("_conv") == F.col("conv_id")) & (F.col("_parent") == F.col("parent_turn")), F.col("sibling"))).select("conv_id", "turn", "parent_turn", "sibling")
    eldest = replies.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = siblings.join(eldest, ["conv_id", "turn"], "full_outer")
    step = lambda turn, up, next_turn, next_up, n: F.struct(turn.alias("turn"), F.lit(up).alias("up"), next_turn.alias("to"), next_up.alias("to_up"), F.lit(n).cast("long").alias("met"), F.lit(1 if n else -1).cast("long").alias("down"))
    down = step(F.col("turn"), False, F.coalesce("child", "turn"), F.col("child").isNull(), 1)
    up = step(F.col("turn"), True, F.coalesce("sibling", "parent_turn"), F.col("sibling").isNull(), 0)
    steps = nodes.select("conv_id", F.explode(F.array(down, up)).alias("s")).select("conv_id", "s.*")
    # A root's step up is the end; every other step goes on to a step.
    steps = stored(steps.withColumn("last", F.when(F.col("to").isNull(), F.col("turn"))), "steps")
    discard(placed)
    while True:
        going = steps.where("to is not null")
        ahead = steps.select("conv_id", F.col("turn").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("next"), F.col("to_up").alias("next_up"), F.col("met").alias("more"), F.col("down").alias("lower"), F.col("last").alias("end"))
        moved = going.join(ahead, ["conv_id", "to", "to_up"]).select(
            "conv_id", "turn", "up", F.col("next").alias("to"), F.when(F.col("next").isNotNull(), F.col("next_up")).alias("to_up"), (F.col("met") + F.col("more")).alias("met"), (F.col("down") + F.col("lower")).alias("down"), F.col("end").alias("last"),
        )
        after = stored(steps.where("to is null").select(*moved.columns).unionByName(moved), "steps")
        discard(steps)
        steps = after
        if steps.where("to is not null").isEmpty():
            break
    met = steps.where("not up").select("conv_id", "turn", F.col("last").alias("root_turn"), (-F.col("down")).cast("int").alias("depth"), "met")
    whole = met.where("turn = root_turn").select("conv_id", "root_turn", F.col("met").alias("size"))
    return met.join(whole, ["conv_id", "root_turn"]).select("conv_id", "turn", "root_turn", "depth", (F.col("size") - F.col("met")).alias("place"))


def format_chats(messages: DataFrame) -> DataFrame:
    """One row for each message: what it answers, its branch and depth, and its words without quotes.

    Sorted by (conv_id, root_turn, place), a conversation is in reply order: a message comes after what it answers, with
    its branch.
    """
    parsed = materialize(parse(messages), "messages")
    links = link_quotes(parsed).groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked"), F.max("level").alias("max_level"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("near"), F.max("origin").alias("any"),
    )
    links = materialize(links.select("conv_id", "turn", "n_quotes", "n_linked", "max_level", F.coalesce("near", "any").alias("parent_turn")), "quotes", fold=True)
    roots = reply_order(links)
    nothing = F.lit(0)
    return (
        parsed.select("conv_id", "turn", "role", "body").join(links, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", F.when(F.col("conv_id").isNotNull(), F.col("turn"))).alias("root_turn"), F.coalesce("depth", nothing).cast("int").alias("depth"), F.coalesce("place", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.lit(0))).cast("long").alias("place"),
            F.coalesce("n_quotes", nothing).cast("long").alias("n_quotes"), F.coalesce("n_linked", nothing).cast("long").alias("n_linked"), F.coalesce("max_level", nothing).cast("int").alias("max_level"), "body",
        )
    )


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(read(spark, sf_dir, "conversations"))
    return out.withColumn("body_sha256", F.sha2(F.col("body"), 256)).withColumn("body_chars", F.length("body").cast("long"))
