"""Places of regular-expression matches, in built-in functions.

Java's engine repeats groups by recursion; all patterns given here are written with possessive
repeats and anchored at the start of a run, so that matches are the leftmost ones, the time is
linear and the stack stays flat however long a text is. Places count code points, ends exclusive.

Nothing is gathered by appending to an array or by cutting a text from its start for each hit:
places are running sums, made by doubling (n log n steps for n hits), and texts are cut from
parts of PART code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseforge.llm.common import let

SPAN = "array<struct<s:int,e:int,m:string>>"
SEEN = "array<struct<s:int,e:int,m:string,l:string,r:string>>"
#: Code points of one part of a text that is cut at many places.
PART = 2048


def running(values: Column, merge: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running totals of an array of int under an associative ``merge``.

    Each round takes in what lies 1, 2, 4, … places before; log2 of the size rounds are enough.
    """

    def start(v: Column) -> Column:
        return F.struct(F.lit(1).alias("step"), v.cast("array<int>").alias("a"))

    def double(acc: Column, _: Column) -> Column:
        far = lambda x, i: F.when(i >= acc["step"], merge(F.get(acc["a"], i - acc["step"]), x)).otherwise(x)
        return F.struct((acc["step"] * 2).alias("step"), F.transform(acc["a"], far).cast("array<int>").alias("a"))

    def scan(v: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(v))).cast("int"))
        return F.when(F.size(v) < 2, v.cast("array<int>")).otherwise(F.aggregate(rounds, start(v), double, lambda acc: acc["a"]))

    return let(values, scan)


def found(text: Column, pattern: str, worth: Column | None = None, context: int = 0) -> Column:
    """All leftmost non-overlapping matches as structs (s, e, m); ``worth`` may spare the search.

    ``context``: also l, up to so many characters before the match and behind the match before it,
    and r, the character behind it.
    """

    def placed(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]

        def ended(ends: Column) -> Column:
            def one(hit: Column, i: Column) -> Column:
                parts = [(F.get(ends, i) - F.length(hit)).alias("s"), F.get(ends, i).alias("e"), hit.alias("m")]
                if context:
                    behind = F.substring(F.get(gaps, i + 1), 1, 1)
                    following = F.coalesce(F.substring(F.get(hits, i + 1), 1, 1), F.lit(""))
                    parts += [F.right(F.get(gaps, i), F.lit(context)).alias("l"), F.when(behind != "", behind).otherwise(following).alias("r")]
                return F.struct(*parts)

            return F.transform(hits, one)

        return let(running(F.transform(hits, lambda hit, i: F.length(F.get(gaps, i)) + F.length(hit))), ended)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    search = text.rlike(pattern) if worth is None else worth & text.rlike(pattern)
    both = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    kind = SEEN if context else SPAN
    return F.when(search, let(both, placed).cast(kind)).otherwise(F.array().cast(kind))


def redacted(text: Column, spans: Column, mark) -> Column:
    """``text`` with each span (s, e, ...) replaced by ``mark(span)``; overlapping spans are cut once."""

    def parted(x: Column) -> Column:
        parts, sorted_, reach = x["parts"], x["spans"], x["reach"]
        part = lambda at: F.coalesce(F.get(parts, at), F.lit(""))

        def between(a: Column, b: Column) -> Column:
            """The text from place a to before place b; to its end if b is null."""
            first, last = F.floor(a / PART).cast("int"), F.coalesce(F.floor(b / PART).cast("int"), F.size(parts))
            tail = F.when(b.isNotNull(), F.substr(part(last), F.lit(1), b % PART)).otherwise(F.lit(""))
            near = F.substr(part(first), a % PART + 1, b - a)
            far = F.concat(F.substr(part(first), a % PART + 1), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
            return F.when(first == last, near).otherwise(far)

        def one(span: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
            return F.when(span["s"] >= before, F.concat(between(before, span["s"]), mark(span))).otherwise(F.lit(""))

        rest = between(F.get(reach, F.size(reach) - 1), F.lit(None).cast("int"))
        return F.concat(F.array_join(F.transform(sorted_, one), ""), rest)

    def reached(sorted_: Column) -> Column:
        ends = running(F.transform(sorted_, lambda x: x["e"]), F.greatest)
        parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
        return let(F.struct(parts.alias("parts"), sorted_.alias("spans"), ends.alias("reach")), parted)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.array_sort(spans), reached))


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (s, e, ...) that overlap none of ``others`` (s, e, ...), by start."""
    far = 2147483647

    def merged(rows: Column) -> Column:
        before = running(F.transform(rows, lambda x: F.when(x["own"], 0).otherwise(x["e"])), F.greatest)
        behind = F.reverse(running(F.transform(F.reverse(rows), lambda x: F.when(x["own"], far).otherwise(x["s"])), F.least))

        def clear(x: Column) -> Column:
            return F.filter(x["rows"], lambda r, i: r["own"] & (F.get(x["before"], i) <= r["s"]) & (F.get(x["behind"], i) >= r["e"]))

        kept = let(F.struct(rows.alias("rows"), before.alias("before"), behind.alias("behind")), clear)
        return F.transform(kept, lambda r: r["x"])

    def sorted_(x: Column) -> Column:
        spans, others = x["spans"], x["others"]
        mine = lambda r: F.struct(r["s"].alias("s"), F.lit(True).alias("own"), r["e"].alias("e"), r.alias("x"))
        other = lambda r: F.struct(r["s"].alias("s"), F.lit(False).alias("own"), r["e"].alias("e"), F.get(spans, F.lit(-1)).alias("x"))
        both = F.sort_array(F.concat(F.transform(others, other), F.transform(spans, mine)))
        return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(both, merged))

    return let(F.struct(spans.alias("spans"), others.alias("others")), sorted_)


def listed(spans: Column, names: list[str]) -> Column:
    """kind:start:end of all spans, comma-joined; kinds are indexes into ``names``."""
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
