"""Text expressions: stripping, counting, chunking, code fences, keyword hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartula.functions.exprs import let

# The code points a Unicode-aware strip/split treats as white space.
WHITESPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "\u2028\u2029\u202f\u205f\u3000"
FENCE = "```"
CHUNK_SIZE = 5000
MIN_CUT_SHARE = 0.3
MIN_CODE_LENGTH = 1000
CONTEXT_LENGTH = 1000


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def words(text: Column) -> Column:
    """White-space separated tokens."""
    return F.array_remove(F.split(F.translate(text, WHITESPACE, " " * len(WHITESPACE)), " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def find_last(text: Column, pattern: str, length: Column) -> Column:
    """0-based position of the last occurrence of ``pattern``; negative when there is none.

    ``length`` is the length of ``text``, which callers know without counting again.
    """
    after = F.substring_index(text, pattern, -1)
    return length - F.length(after) - F.lit(len(pattern))


def headers(text: Column) -> Column:
    """Markdown headings as ``"## title"`` joined by ``"; "``."""
    blank = f"[{WHITESPACE}]+"
    found = F.regexp_extract_all(text, F.lit(rf"(?md)^(#+){blank}(.+)$"), F.lit(0))
    tidy = F.transform(found, lambda h: F.regexp_replace(h, rf"(?sd)^(#+){blank}(.+)$", "$1 $2"))
    return F.array_join(tidy, "; ")


def section_info(text: Column) -> Column:
    return F.struct(
        headers(text).alias("headers"),
        F.length(text).alias("char_count"),
        word_count(text).alias("word_count"),
    )


# --- random access into long texts -------------------------------------------------------
#
# substring() on a variable-width string walks from its first byte, so slicing a long text
# piece by piece is quadratic.  Texts are cut once into fixed-size blocks; a slice no longer
# than a block then touches at most two of them.


def blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def block_slice(pieces: Column, size: int, start: Column, length: Column) -> Column:
    """``text[start:start+length]`` for ``length <= size``."""
    index = F.floor(start / F.lit(size)).cast("int")
    pair = F.concat(
        F.coalesce(F.get(pieces, index), F.lit("")),
        F.coalesce(F.get(pieces, index + F.lit(1)), F.lit("")),
    )
    return F.substring(pair, start - index * F.lit(size) + F.lit(1), length)


# A fold that appends to one array copies it at every step.  Numbers are collected in a short array instead, and
# full ones in an array of arrays, so that a long text takes time in proportion to its length.
COLLECTED = 256


def _nothing_collected() -> list[Column]:
    return [F.array().cast("array<int>").alias("tail"), F.array().cast("array<array<int>>").alias("full")]


def _collected(state: Column, number: Column) -> list[Column]:
    is_full = F.size(state["tail"]) >= COLLECTED
    return [
        F.when(is_full, F.array(number)).otherwise(F.array_append(state["tail"], number)).alias("tail"),
        F.when(is_full, F.array_append(state["full"], state["tail"])).otherwise(state["full"]).alias("full"),
    ]


def _all_collected(state: Column) -> Column:
    return F.concat(F.flatten(state["full"]), state["tail"])


def chunk_cuts(pieces: Column, length: Column, size: int = CHUNK_SIZE) -> Column:
    """End offsets of the boundary-aware chunks of a text given as ``blocks(text, size)``.

    Greedy: a window of ``size`` is cut at its last code fence, else at its last blank line,
    else after its last sentence, in each case only beyond ``0.3 * size``.  Blank lines that
    occur only early suppress the sentence rule.
    """
    least = size * MIN_CUT_SHARE
    steps = F.ceil(length / F.lit(int(least) + 1)).cast("int") + F.lit(1)

    def advance(window: Column) -> Column:
        fence, para, stop = (find_last(window, p, F.lit(size)) for p in (FENCE, "\n\n", ". "))
        return (
            F.when(window.contains(FENCE) & (fence > least), fence)
            .when(window.contains("\n\n"), F.when(para > least, para).otherwise(size))
            .when(stop > least, stop + F.lit(1))
            .otherwise(F.lit(size))
        )

    def step(state: Column, _: Column) -> Column:
        pos = state["pos"]
        window = block_slice(pieces, size, pos, F.lit(size))
        nxt = F.when(pos + F.lit(size) >= length, length).otherwise(pos + let(window, advance))
        moved = let(nxt, lambda n: F.struct(n.cast("int").alias("pos"), *_collected(state, n.cast("int"))))
        return F.when(pos >= length, state).otherwise(moved)

    start = F.struct(F.lit(0).alias("pos"), *_nothing_collected())
    return _all_collected(F.aggregate(F.sequence(F.lit(1), steps), start, step))


def chunks_from_cuts(pieces: Column, cuts: Column, size: int = CHUNK_SIZE) -> Column:
    """Stripped, non-empty chunk texts in order."""

    def cut(end: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - F.lit(1)))
        return strip(block_slice(pieces, size, begin, end - begin))

    return F.filter(F.transform(cuts, cut), lambda c: c != "")


def paragraphs(text: Column, min_length: int = 50) -> Column:
    """Blank-line separated paragraphs longer than ``min_length``."""
    return F.filter(
        F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > F.lit(min_length)
    )


# --- fenced code ---------------------------------------------------------------------------


def fence_skip(text: Column) -> Column:
    """Number of leading characters ignored when a text opens with a fence."""
    return F.when(strip(text).startswith(FENCE), F.lit(3)).otherwise(F.lit(0))


def fence_parts(text: Column) -> Column:
    """The text between consecutive fences; odd entries are code when they are closed."""
    return F.split(F.substring(text, fence_skip(text) + F.lit(1), F.length(text)), FENCE)


def fence_positions(parts: Column, skip: Column) -> Column:
    """0-based offset of every fence."""
    start = F.struct(skip.alias("pos"), *_nothing_collected())

    def step(state: Column, part: Column) -> Column:
        here = state["pos"] + F.length(part)
        return F.struct((here + F.lit(3)).alias("pos"), *_collected(state, here))

    return F.aggregate(parts, start, step, lambda s: F.slice(_all_collected(s), 1, F.size(parts) - F.lit(1)))


def code_language(section: Column) -> Column:
    first = strip(F.substring_index(section, "\n", 1))
    is_tag = (
        section.contains("\n") & (first != "") & ~first.contains(" ") & (F.length(first) < 20)
    )
    return F.when(is_tag, first).otherwise(F.lit(""))


def code_body(section: Column) -> Column:
    rest = F.substring(section, F.locate("\n", section) + F.lit(1), F.length(section))
    return strip(F.when(code_language(section) != "", rest).otherwise(section))


def code_blocks(
    parts: Column,
    positions: Column,
    pieces: Column,
    length: Column,
    min_length: int = MIN_CODE_LENGTH,
    context: int = CONTEXT_LENGTH,
) -> Column:
    """Closed fenced blocks of at least ``min_length`` characters with their surroundings.

    ``pieces`` is ``blocks(text, context)``.
    """

    def block(j: Column) -> Column:
        section = F.get(parts, j * F.lit(2) + F.lit(1))
        opening = F.get(positions, j * F.lit(2))
        after = F.get(positions, j * F.lit(2) + F.lit(1)) + F.lit(3)
        reach = F.least(F.lit(context), opening)
        before_text = strip(block_slice(pieces, context, opening - reach, reach))
        after_text = strip(
            block_slice(pieces, context, after, F.least(F.lit(context), length - after))
        )
        return F.struct(
            code_body(section).alias("code"),
            code_language(section).alias("language"),
            before_text.alias("context_before"),
            after_text.alias("context_after"),
        )

    pairs = F.floor(F.size(positions) / F.lit(2)).cast("int")
    wanted = F.filter(
        F.when(pairs > 0, F.sequence(F.lit(0), pairs - F.lit(1))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda j: F.length(code_body(F.get(parts, j * F.lit(2) + F.lit(1)))) >= F.lit(min_length),
    )
    return F.transform(wanted, block)


# --- windows, clips, composed texts -----------------------------------------------------------


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def clip_summary(summary: Column, source_id: Column, limit: int = 500) -> Column:
    """Long summaries end in an ellipsis; missing ones get a default."""
    clipped = F.when(F.length(summary) > limit, F.concat(head(summary, limit), F.lit("..."))).otherwise(
        summary
    )
    return F.when(is_blank(summary), F.concat(F.lit("Content from "), source_id)).otherwise(clipped)


def contextual_text(context: Column, chunk: Column) -> Column:
    return F.concat(context, F.lit("\n---\n"), chunk)


def code_embed_text(code: Column, summary: Column) -> Column:
    return F.concat(code, F.lit("\n\nSummary: "), summary)


def code_query_text(query: Column) -> Column:
    return F.concat(
        F.lit("Code example for "), query, F.lit("\n\nSummary: Example code showing "), query
    )


# --- keywords -----------------------------------------------------------------------------------


def contains_ci(text: Column, needle: Column | str) -> Column:
    """Literal, case-insensitive substring test."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(text), F.lower(needle))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The keywords found in ``text``, in list order."""
    wanted = F.array(*map(F.lit, keywords))
    return let(F.lower(text), lambda low: F.filter(wanted, lambda k: F.contains(low, k)))


def keyword_snippet(
    text: Column, priority: list[str], width: int = 400, lead: int = 100
) -> Column:
    """A window around the first priority keyword found; short texts are returned whole."""
    wanted = F.array(*map(F.lit, priority))

    def first_position(lowered: Column) -> Column:
        found = F.transform(wanted, lambda word: F.position(word, lowered))
        return F.coalesce(F.get(F.filter(found, lambda at: at > 0), F.lit(0)), F.lit(1))

    start = F.greatest(let(F.lower(text), first_position) - F.lit(lead), F.lit(1))
    window = F.concat(F.substring(text, start, F.lit(width)), F.lit("..."))
    return F.when(F.length(text) > width, window).otherwise(text)
