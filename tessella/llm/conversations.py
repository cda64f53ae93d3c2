"""Rebuilding conversations from message rows.

Exports come in fragments: lists of messages that overlap where one ends and
the next begins.  ``overlaps`` matches suffixes of a conversation's fragments
with prefixes of others by their message hashes; the matches are the edges of
an overlap graph.  A fragment with one follower and a follower with one
predecessor are an unambiguous step; ``assemble`` merges such steps to paths
by pointer doubling, so the longest conversation takes as many rounds as its
length has binary digits, and never one task.  A conversation is whole when
one path holds all of its fragments.

Where rows carry numbers, a row is a fragment of its own: the mark of its
place, its two messages, the mark of the next place.  Rows that follow each
other then overlap by the mark between them, a place that is missing leaves
two paths, and a place with two different exchanges leaves an ambiguous step.
``assembled`` decides this by the degrees of the edges.

Skew: matches are joined by conversation and hash, so a conversation of any
length is spread over all tasks; conversations are counted before the shuffle.

Defined cases: rows with equal place and texts are one exchange, however often
written; a null place is a break; null or blank session ids belong to no
conversation; UUIDs are compared as UUIDs, other ids as text; a text is not
there when it is null, has no letter or digit, or only says that there is none.
Empty and null fragments are left out; equal fragments count once, and so do
fragments that stand whole inside another; fragments that overlap in a circle
make no path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ids import is_blank, uuid_text
from tessella.plans.durable import cut

#: What a text that only says there is none consists of, letters and digits only, in lower case (fixed values).
STAND_INS = (
    "null", "none", "nil", "nan", "na", "undefined", "empty", "blank", "vazio", "vazia", "nulo",
    "noresponse", "noreply", "noanswer", "nomessage", "notext", "nocontent", "noinput", "nooutput",
    "emptyresponse", "emptymessage", "emptyinput", "emptyreply", "missing",
    "semresposta", "respostavazia", "semmensagem", "mensagemvazia", "sementrada", "entradavazia",
    "semtexto", "textovazio", "semconteudo", "semconteúdo", "nenhumaresposta", "nenhuma", "nenhum",
)


def is_there(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return c.isNotNull() & (bare != "") & ~bare.isin(*STAND_INS)


# ---- fragments

CONV = ["c1", "c2"]


def message_hash(*parts: Column) -> Column:
    """64 bits of a message; a missing one differs from an empty one."""
    return F.xxhash64(*(x for p in parts for x in (p.isNull(), F.coalesce(p, F.lit("")))))


def overlaps(fragments: DataFrame, most: int | None = None) -> DataFrame:
    """c1, c2, left, right, n (and the message ``first``, if ``most`` is 1): the longest suffix of ``left`` that is a prefix of ``right``.

    ``fragments``: c1, c2 (the conversation), fragment (its id), hashes (of its messages, in order).  Suffixes of up to
    ``most`` messages are tried; None: of any length that leaves a message before it or after the prefix.
    """
    size = F.size("hashes")
    tried = size if most is None else F.least(size, F.lit(most))
    # the places where a suffix begins; the message there must be the first of the other fragment
    begins = F.posexplode(F.reverse(F.slice(F.col("hashes"), size - tried + 1, tried)))
    left = fragments.select(*CONV, F.col("fragment").alias("left"), F.col("hashes").alias("a"), begins.alias("back", "first")).where(F.col("first").isNotNull())
    right = fragments.select(*CONV, F.col("fragment").alias("right"), F.col("hashes").alias("b"), F.element_at("hashes", 1).alias("first"))
    met = left.join(right, [*CONV, "first"]).withColumn("n", F.col("back") + 1).where("left <> right and n <= size(b)")
    if most != 1:
        met = met.where(F.slice("a", F.size("a") - F.col("n") + 1, F.col("n")) == F.slice("b", F.lit(1), F.col("n")))
        met = met.groupBy(*CONV, "left", "right").agg(F.max("n").alias("n"))
    return met.select(*CONV, "left", "right", "n", *(["first"] if most == 1 else []))


def outermost(fragments: DataFrame) -> DataFrame:
    """Without fragments that are equal to another (the smallest id stays) or stand whole inside one."""
    rows = fragments.where(F.size("hashes") > 0).groupBy(*CONV, "hashes").agg(F.min("fragment").alias("fragment"))
    inner = rows.select(*CONV, F.col("fragment").alias("inner"), F.col("hashes").alias("b"), F.element_at("hashes", 1).alias("h"))
    outer = rows.select(*CONV, F.col("fragment").alias("outer"), F.col("hashes").alias("a"), F.posexplode("hashes").alias("at", "h"))
    inside = outer.join(inner, [*CONV, "h"]).where("inner <> outer and size(b) < size(a)").where(F.slice("a", F.col("at") + 1, F.size("b")) == F.col("b"))
    gone = inside.select(*CONV, F.col("inner").alias("fragment")).distinct()
    return rows.join(gone, [*CONV, "fragment"], "left_anti").select(*CONV, "fragment", "hashes")


def steps(edges: DataFrame) -> DataFrame:
    """The unambiguous edges: their left fragment has one follower and their right one predecessor."""
    out = edges.groupBy(*CONV, "left").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select(*CONV, "left")
    into = edges.groupBy(*CONV, "right").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select(*CONV, "right")
    return edges.join(out, [*CONV, "left"], "left_semi").join(into, [*CONV, "right"], "left_semi")


def paths(fragments: DataFrame, edges: DataFrame) -> DataFrame:
    """c1, c2, fragment, head, place, skip: the path of every fragment, named by its first one, and its place in it.

    ``skip``: messages at its beginning that the fragment before holds already.  Every fragment points to the one before
    it; a round lets it point to where that one points, so its reach doubles.  Fragments in a circle get no head.
    """
    before = steps(edges).select(*CONV, F.col("right").alias("fragment"), F.col("left").alias("up"), F.col("n").alias("skip"))
    start = fragments.select(*CONV, "fragment").join(before, [*CONV, "fragment"], "left")
    state = cut(start.select(*CONV, "fragment", F.coalesce("skip", F.lit(0)).alias("skip"), F.coalesce("up", "fragment").alias("up"), F.col("up").isNotNull().cast("bigint").alias("far")))
    for _ in range(max(1, state.count()).bit_length()):
        ahead = state.select(*CONV, F.col("fragment").alias("up"), F.col("up").alias("__up"), F.col("far").alias("__far"))
        new = state.join(ahead, [*CONV, "up"])
        state = cut(new.select(*CONV, "fragment", "skip", F.col("__up").alias("up"), (F.col("far") + F.col("__far")).alias("far"), (F.col("__far") > 0).alias("moved")))
        if not state.where("moved").limit(1).count():
            break
    roots = start.where("up is null").select(*CONV, F.col("fragment").alias("up"), F.col("fragment").alias("head"))
    return state.join(roots, [*CONV, "up"], "left").select(*CONV, "fragment", "head", F.col("far").alias("place"), "skip")


def assemble(fragments: DataFrame, most: int | None = None) -> DataFrame:
    """c1, c2, head, place, at, hash: the messages of every conversation whose fragments make one path, in order of (place, at).

    Conversations with a gap, an ambiguous step or a circle give none.
    """
    rows = cut(outermost(fragments))
    found = paths(rows, cut(overlaps(rows, most)))
    whole = found.groupBy(*CONV).agg(F.sum((F.col("place") == 0).cast("int")).alias("heads"), F.count("head").alias("held"), F.count(F.lit(1)).alias("all")).where("heads = 1 and held = all").select(*CONV)
    kept = found.join(whole, CONV, "left_semi").join(rows, [*CONV, "fragment"])
    return kept.select(*CONV, "head", "place", F.posexplode("hashes").alias("at", "hash"), "skip").where("at >= skip").drop("skip")


# ---- rows with numbers


def _conversation(turns: DataFrame) -> DataFrame:
    """The rows that belong to a conversation, with its 128-bit number."""
    sid = uuid_text(F.col("session_id"))
    rows = turns.where(~is_blank(F.col("session_id"))).withColumn("session_id", sid)
    return rows.withColumns({"c1": F.xxhash64(F.col("scope").isNull(), "scope", "session_id"), "c2": F.xxhash64("session_id", F.lit("|"), "scope")})


def mark(place: Column) -> Column:
    """The message hash that stands for a place."""
    return F.xxhash64(F.lit("place"), place)


def exchanges(turns: DataFrame) -> DataFrame:
    """c1, c2, fragment, hashes, place, whole: the distinct exchanges of every conversation as fragments."""
    rows = _conversation(turns).select(
        *CONV,
        F.col("turn_n").alias("place"),
        message_hash(F.col("user_input")).alias("u"),
        message_hash(F.col("response")).alias("r"),
        (is_there(F.col("user_input")) & is_there(F.col("response"))).alias("whole"),
    )
    rows = rows.groupBy(*CONV, "place", "u", "r").agg(F.first("whole").alias("whole"))
    # without a place nothing can follow or precede
    hashes = F.array(F.when(F.col("place").isNotNull(), mark(F.col("place"))), "u", "r", F.when(F.col("place").isNotNull(), mark(F.col("place") + 1)))
    return rows.select(*CONV, F.xxhash64("c1", "place", F.col("place").isNull(), "u", "r").alias("fragment"), hashes.alias("hashes"), "place", "whole")


def assembled(turns: DataFrame) -> DataFrame:
    """c1, c2, n_exchanges, kept: every conversation and whether its exchanges make one path from place 0.

    One path: one edge less than fragments, no fragment with two followers or two predecessors.  Places rise along an
    edge, so there are no circles.
    """
    rows = exchanges(turns)
    edges = overlaps(rows, most=1)
    # all edges of a fragment's end, or beginning, are matches of one mark: their degrees need no further shuffle
    out = edges.groupBy(*CONV, "first", "left").agg(F.count(F.lit(1)).alias("degree"))
    into = edges.groupBy(*CONV, "first", "right").agg(F.count(F.lit(1)).alias("degree"))
    zero = F.lit(0)
    counted = (
        rows.select(*CONV, F.lit(1).alias("fragments"), zero.alias("edges"), zero.cast("bigint").alias("degree"), "whole", "place", F.col("place").isNull().alias("lost"))
        .unionByName(out.select(*CONV, zero.alias("fragments"), F.col("degree").alias("edges"), "degree"), allowMissingColumns=True)
        .unionByName(into.select(*CONV, zero.alias("fragments"), zero.alias("edges"), "degree"), allowMissingColumns=True)
    )
    one = counted.groupBy(*CONV).agg(F.sum("fragments").alias("n_exchanges"), F.sum("edges").alias("edges"), F.max("degree").alias("degree"), F.min("place").alias("place"), F.min("whole").alias("whole"), F.max("lost").alias("lost"))
    kept = F.col("whole") & ~F.col("lost") & (F.col("edges") == F.col("n_exchanges") - 1) & (F.col("degree") <= 1) & (F.col("place") == 0)
    return one.select(*CONV, "n_exchanges", F.coalesce(kept, F.lit(False)).alias("kept"))


def dropped(turns: DataFrame) -> DataFrame:
    """scope, session_id of the conversations that are broken, empty or lack a reply."""
    gone = assembled(turns).where(~F.col("kept")).select(*CONV)
    names = _conversation(turns).groupBy(*CONV).agg(F.first("scope").alias("scope"), F.first("session_id").alias("session_id"))
    return names.join(gone, CONV, "left_semi").select("scope", "session_id")


def messages(turns: DataFrame) -> DataFrame:
    """scope, session_id, place, role, text: the kept conversations, a row per message.

    ``place`` is 2 * turn_n for the user and 2 * turn_n + 1 for the assistant: with every turn there once, it needs no sort.
    """
    kept = assembled(turns).where("kept").select(*CONV)
    rows = _conversation(turns).select(*CONV, "scope", "session_id", "turn_n", "user_input", "response").join(kept, CONV, "left_semi").dropDuplicates([*CONV, "turn_n"])
    both = F.explode(
        F.array(
            F.struct((F.col("turn_n") * 2).alias("place"), F.lit("user").alias("role"), F.col("user_input").alias("text")),
            F.struct((F.col("turn_n") * 2 + 1).alias("place"), F.lit("assistant").alias("role"), F.col("response").alias("text")),
        )
    )
    return rows.select("scope", "session_id", both.alias("m")).select("scope", "session_id", "m.*")
