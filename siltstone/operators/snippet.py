"""The lines of a document that answer a query best."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.analyzer import intent_terms
from siltstone.functions.text import let

INTENT_WEIGHT, MOST_CHARS, MARGIN, CHUNK = 0.3, 500, 100, 3600


def snippet(body: Column, query: str, most: int = MOST_CHARS, pos: Column | None = None, size: Column | None = None, intent: str | None = None) -> Column:
    """struct<line, snippet, lines_before, lines_after, snippet_lines>: the first line with the most query terms, one line before and two after it, under a header of its place. With pos the search is within that chunk and a margin, unless nothing but white space is there."""
    terms = query.lower().split()
    more = intent_terms(intent) if intent else []

    def score(line: Column) -> Column:
        low = F.lower(line)
        s = sum((F.when(low.contains(t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))
        return sum((F.when(low.contains(t), INTENT_WEIGHT).otherwise(0.0) for t in more), s)

    total = F.size(F.split(body, "\n", -1))

    def of(region: Column, offset: Column) -> Column:
        def choose(lines: Column) -> Column:
            def cut(best: Column) -> Column:
                first = F.greatest(F.lit(0), best - 1)
                taken = F.slice(lines, first + 1, best + 3 - first)

                def build(t: Column) -> Column:
                    text = F.array_join(t, "\n")
                    text = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
                    start, n = offset + first + 1, F.size(t)
                    before, after = start - 1, total - (start + n - 1)
                    head = F.format_string("@@ -%d,%d @@ (%d before, %d after)", start, n, before, after)
                    return F.struct((offset + best + 1).alias("line"), F.concat(head, F.lit("\n"), text).alias("snippet"), before.alias("lines_before"), after.alias("lines_after"), n.alias("snippet_lines"))

                return let(taken, build)

            scores = F.transform(lines, score)
            return let(let(scores, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int")), cut)

        return let(F.split(region, "\n", -1), choose)

    whole = of(body, F.lit(0))
    if pos is None:
        return whole
    start = F.greatest(F.lit(0), pos - MARGIN)
    end = pos + F.coalesce(size if size is not None else F.lit(None), F.lit(CHUNK)) + MARGIN
    offset = F.size(F.split(F.substr(body, F.lit(1), start), "\n", -1)) - 1
    part = of(F.substr(body, start + 1, end - start), offset)
    blank = F.trim(F.regexp_replace(part["snippet"], r"^[^\n]*\n", "")) == ""
    return F.when((pos > 0) & ~blank, part).otherwise(whole)
