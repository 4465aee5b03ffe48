"""Operator 7: chat formatting of typed content parts, in DataFrame functions only.

A message holds ordered parts of four kinds. Flattening visits them in order:
text is escaped, an image, audio or document part becomes a placeholder and an
attachment reference with the number of tokens it expands to. Messages are
marked by control strings that begin with "<|". Inside texts and roles the
escape character and "<" (in roles "|" too) are replaced, so no control string
can occur there and every text can be read back:

    \\  ->  \\b      <  ->  \\l      |  ->  \\p (roles only)

Turns are ordered by number; equal numbers by role, then by text. A null text is
the empty text, a null role the empty role, and an unknown kind of part or a
part without a reference still gets its placeholder (0 tokens if nothing tells
its size). Rows that repeat a turn are turns of their own. A null conversation
id is a conversation. The formatted conversation is one value, so a conversation
must fit one row (four bytes a character in digests()); everything before that
is done turn by turn. Time grows with the length of a conversation, not faster.
Columns other than the four named are left out, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
# Tokens an attachment expands to: one per image patch, per audio second, per document page.
PATCH = 28
AUDIO_TOKENS = 25
PAGE_TOKENS = 600
TRAINED_ROLE = "assistant"
OPEN, SHUT, END = "<|", "|>", "<|end|>"
# Names the byte order of what follows, so that a first character that looks like one is kept.
BYTE_ORDER = bytearray(b"\x00\x00\xfe\xff")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("|"), F.lit("\\p"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\p"), F.lit("|")))


def text_part(text: Column) -> Column:
    """One text part as the parts of a message."""
    fields = [F.lit("text").alias("kind"), text.cast("string").alias("text")]
    fields += [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(*fields))


def part_tokens(part: Column) -> Column:
    """The number of tokens an attachment expands to; 0 where its size is not known."""
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return F.coalesce(
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS))
        .when(part["kind"] == "document", part["pages"] * PAGE_TOKENS)
        .cast("long"),
        F.lit(0).cast("long"),
    )


def flattened(messages: DataFrame, parts: str = "parts") -> DataFrame:
    """Adds `body` (escaped text and placeholders in order) and `attachments` of every message."""
    known = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    is_text = lambda p: F.coalesce(p["kind"] == "text", F.lit(False))
    placeholder = lambda p: F.concat(F.lit(OPEN), F.coalesce(escaped_role(p["kind"]), F.lit("")), F.lit(":"), F.coalesce(escaped_role(p["ref"]), F.lit("")), F.lit(SHUT))
    shown = F.transform(known, lambda p: F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p)))
    attached = F.transform(
        F.filter(known, lambda p: ~is_text(p)),
        lambda p, i: F.struct(i.alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("n_tokens")),
    )
    return messages.withColumns({"body": F.array_join(shown, ""), "attachments": attached})


def formatted(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: `formatted`, `loss_spans` (code points of trained text: start, end),
    `attachments` (in order, with the turn's place) and `expanded_tokens` of all attachments."""
    flat = flattened(messages.select(key, turn, role, parts), parts)
    role_text = F.coalesce(F.col(role).cast("string"), F.lit(""))
    head = F.concat(F.lit(OPEN), escaped_role(role_text), F.lit(SHUT + "\n"))
    lines = flat.select(
        F.col(key).alias("_key"),
        F.struct(
            F.col(turn).alias("turn"), role_text.alias("role"), F.col("body"), head.alias("head"),
            F.char_length(head).alias("n_head"), F.char_length("body").alias("n_body"), F.col("attachments"),
        ).alias("line"),
    )
    # Where each turn starts, as a running sum. A turn is never empty, so starts are in the order of turns.
    so_far = Window.partitionBy("_key").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("line.n_head") + F.col("line.n_body") + len(END) + 1
    lines = lines.withColumn("at", F.sum(size).over(so_far) - size)
    talks = lines.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("at", "line.*"))).alias("lines"))
    shown = F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    trained = F.transform(
        F.filter("lines", lambda x: x["role"] == TRAINED_ROLE),
        lambda x: F.struct((x["at"] + x["n_head"]).alias("start"), (x["at"] + x["n_head"] + x["n_body"]).alias("end")),
    )
    placed = F.flatten(F.transform("lines", lambda x, i: F.transform(x["attachments"], lambda a: F.struct(i.alias("turn"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    done = talks.select(F.col("_key").alias(key), shown.alias("formatted"), trained.alias("loss_spans"), placed.alias("attachments"))
    return done.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]))


def read_back(talks: DataFrame, text: str = "formatted") -> DataFrame:
    """Adds `turns` (role and escaped body of each turn) read from the formatted text alone.

    Only text turns can be compared with their source; placeholders stay as they are.
    """
    pieces = F.split(F.col(text), r"<\|end\|>\n")
    # The text ends with an end mark, so the last piece is empty.
    marked = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    role = lambda p: F.substring_index(F.substring_index(p, SHUT + "\n", 1), OPEN, -1)
    turns = F.transform(
        marked,
        lambda p: F.struct(
            unescaped_role(role(p)).alias("role"),
            p.substr(F.char_length(role(p)) + len(OPEN + SHUT) + 2, F.char_length(p)).alias("body"),
        ),
    )
    return talks.withColumn("turns", turns)


def masked(text: str = "formatted", spans: str = "loss_spans") -> Column:
    """The pieces of the text under the spans, in order.

    Linear: the text is encoded once, into characters of four bytes that are found by their place.
    """
    wide = lambda x: F.decode(F.concat(F.lit(BYTE_ORDER), x), "UTF-32")
    place = lambda x: (x * 4).cast("int")
    cut = lambda whole: F.transform(spans, lambda s: wide(F.substring(whole, place(s["start"]) + 1, place(s["end"] - s["start"]))))
    # An array of one, so that the inner function takes the encoded text as a value instead of encoding it for each span.
    return F.element_at(F.transform(F.array(F.encode(F.col(text), "UTF-32")), cut), 1)


def digests(talks: DataFrame, key: str = "conv_id") -> DataFrame:
    """Numbers and SHA-256 digests of what the formatted text says; the loss is the text under `loss_spans`."""
    back = read_back(talks)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), unescaped(t["body"]), F.lit("\n"))), "")
    loss = F.array_join(F.transform(masked(), unescaped), "")
    return back.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
