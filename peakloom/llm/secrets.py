"""Secrets in whole texts, with DataFrame functions alone: plain patterns, and strings of high windowed entropy.

Each pattern goes over a text once: matches are set between marks, and the text is split at these. A match begins where
the lengths of the pieces before it end; these running sums (and the running ends of plain spans, which tell the
candidates that touch none) are taken block by block, so work grows in proportion to the text. All lengths are in code
points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key(?-i))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run of the class that is long enough begins where the run begins, so the base patterns' own lengths can be asked for
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: (class, what the whole candidate looks like, window, least bits): the first class that fits counts, and the last fits
#: all, so that every candidate is measured.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 32, 3.0),
    ("base64", r"^(?=[^0-9]*+[0-9])(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])[A-Za-z0-9+/_=-]+$", 20, 3.8),
    ("lower36", r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^a-z]*+[a-z]){4})[a-z0-9]+$", 20, 3.7),
    ("upper36", r"^(?=[^0-9]*+[0-9])(?=(?:[^A-Z]*+[A-Z]){4})[A-Z0-9]++=*$", 20, 3.7),
    ("joined36", r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})(?:[a-z0-9+/_=-]++|[A-Z0-9+/_=-]++)$", 20, 3.9),
    ("letters", r"^(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])[A-Za-z+/_=-]+$", 20, 3.9),
    ("rest", r"^", 20, 4.0),
)
#: Strings that look random and are none: UUIDs, words joined by marks (unless a small letter stands alone between
#: capitals, as in no word), digits alone, and strings with placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    # possessive loops, which don't go down the stack on long strings
    r"^(?!.*[A-Z][a-z][A-Z])[/_=-]*+[A-Za-z]++(?:[/_=-]++(?:[A-Za-z]++|[0-9]{1,4}+))*+[/_=-]*+$",
    r"^[0-9_=/+-]+$",
    r"(?i)example|placeholder|changeme|xxxx|0123456789|abcdefgh",
)


#: Elements that a running sum goes through at a time, and how often blocks are gathered to blocks of blocks.
BLOCK, LEVELS = 64, 2
_OPEN, _INNER = "\x01", "\x02"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column], zero: int = 0, levels: int = LEVELS) -> Column:
    """The running ``join`` of an array of longs, up to each element with it. An accumulator is copied at each step, so
    it only ever holds a block; the blocks' own results are run through first, in the same way."""
    first = F.lit(zero).cast("long")

    def through(block: Column, before: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return _let(join(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

        return F.aggregate(block, F.struct(before.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])

    if not levels:
        return through(values, first)

    def by_block(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, first, join))
        return _let(running(sums, join, zero, levels - 1), lambda ends: F.flatten(F.transform(blocks, lambda block, k: through(block, F.coalesce(F.get(ends, k - 1), first)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))
    return F.when(F.size(values) <= BLOCK, through(values, first)).otherwise(_let(blocks, by_block))


_MATCHES = "array<struct<s:bigint,e:bigint,m:string,g:string>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<s, e, m, g>>: from, to, match and group of each leftmost non-overlapping match. ``text`` must not
    hold the marks."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(_OPEN + "$0" + (f"{_INNER}${group}" if group else "") + _OPEN))
    part = lambda x, side: F.substring_index(x, _INNER, side) if group else x

    def placed(parts: Column) -> Column:
        inside = F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), lambda i: F.get(parts, 2 * i - 1))

        def with_ends(found: Column) -> Column:
            steps = F.transform(found, lambda x, i: (F.length(F.get(parts, 2 * i)) + F.length(part(x, 1))).cast("long"))
            row = lambda x, end: F.struct((end - F.length(part(x, 1))).alias("s"), end.alias("e"), part(x, 1).alias("m"), part(x, -1).alias("g"))
            return _let(steps, lambda steps: _let(running(steps, lambda a, b: a + b), lambda ends: F.transform(found, lambda x, i: row(x, F.get(ends, i)))))

        return F.when(F.size(parts) > 1, _let(inside, with_ends)).otherwise(F.array().cast(_MATCHES))

    return _let(F.split(marked, _OPEN, -1), placed)


def _apart(found: Column, plain: Column) -> Column:
    """The matches that touch no plain span: all ends of spans that begin before a match's own end are no later than
    its start. One sort, and one running maximum."""
    kind = "struct<key:bigint,late:int,until:bigint,x:struct<s:bigint,e:bigint,m:string,g:string>>"
    entry = lambda key, late, until, x: F.struct(key.alias("key"), F.lit(late).alias("late"), until.alias("until"), x.alias("x")).cast(kind)
    none = F.lit(None).cast("struct<s:bigint,e:bigint,m:string,g:string>")
    # a span that begins just where a match ends doesn't touch it
    events = F.array_sort(F.concat(F.transform(plain, lambda p: entry(p["s"], 1, p["e"], none)), F.transform(found, lambda x: entry(x["e"], 0, F.lit(0), x))))

    def kept(events: Column) -> Column:
        untils = F.transform(events, lambda v: v["until"])
        far = lambda untils: running(untils, lambda a, b: F.greatest(a, b))
        free = lambda far: F.filter(F.transform(events, lambda v, i: F.when((v["late"] == 0) & (F.get(far, i) <= v["x"]["s"]), v["x"])), lambda x: x.isNotNull())
        return _let(untils, lambda u: _let(far(u), free))

    return F.when((F.size(plain) == 0) | (F.size(found) == 0), found).otherwise(_let(events, kept))


def _spans(matches: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.transform(matches, lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e")))


#: Counts of the characters from + to z, which all classes lie in: ten counts of six bits in a long.
_FIRST, _LAST, _BITS = ord("+"), ord("z"), 6


def window_entropy(text: Column, window: int | Column) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` characters in a row (63 at most; of all, if the text is
    shorter) of a string of characters from + to z. One pass: each step takes one character out of the counts and one
    in, and the sum of n * log2(n) follows from these two counts."""
    longs = (_LAST - _FIRST) // 10 + 1
    term = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    units = F.array(*[F.lit(1 << (_BITS * k)).cast("long") for k in range(10)])
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    slot, unit = (lambda c: F.floor(c / 10).cast("int")), (lambda c: F.get(units, c % 10))
    # whole-number division: a quotient as double would lose low bits
    count = lambda counts, c: (F.call_function("div", F.get(counts, slot(c)), unit(c)) % (1 << _BITS)).cast("int")

    def over(codes: Column) -> Column:
        wide = F.least(F.size(codes), F.lit(window))

        def step(acc: Column, i: Column) -> Column:
            enter = F.get(codes, i)
            leave = F.when(i >= window, F.get(codes, i - F.lit(window)))

            def moved(x: Column) -> Column:
                out_n, in_n = x["out_n"], x["in_n"]
                total = acc["sum"] + F.when(x["leave"].isNotNull(), term(out_n - 1) - term(out_n)).otherwise(F.lit(0.0)) + term(in_n + 1) - term(in_n)
                minus = lambda j: F.when(j == slot(x["leave"]), unit(x["leave"])).otherwise(F.lit(0))
                counts = F.transform(acc["counts"], lambda n, j: n + F.when(j == slot(x["enter"]), unit(x["enter"])).otherwise(F.lit(0)) - minus(j))
                bits = F.log2(wide.cast("double")) - total / wide
                return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i + 1 >= wide, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

            seen = F.struct(
                enter.alias("enter"),
                leave.alias("leave"),
                F.coalesce(count(acc["counts"], leave), F.lit(0)).alias("out_n"),
                (count(acc["counts"], enter) - F.when(enter == leave, 1).otherwise(0)).alias("in_n"),
            )
            return _let(seen, moved)

        return F.when(F.size(codes) > 0, F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["best"])).otherwise(F.lit(0.0))

    return _let(F.transform(F.split(text, ""), lambda c: F.ascii(c) - _FIRST), over)


def is_random(value: Column) -> Column:
    """Whether the first class that a candidate fits finds enough entropy in it, and no allow-list pattern holds."""
    chosen = F.coalesce(*[F.when(value.rlike(looks), F.struct(F.lit(window).alias("window"), F.lit(bits).alias("bits"))) for _, looks, window, bits in CLASSES])
    verdict = _let(chosen, lambda c: window_entropy(value, c["window"]) >= c["bits"])
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(verdict)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex (plain spans), base_sha256, spans (all spans, joined) and n_entropy.
    Entropy spans touch no plain span. A null text is empty; rows that repeat stay; further columns are ignored; no
    row gives no row. Narrow: no shuffle, no Python."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the marks are in no pattern, so another character that is in none can stand for them
    text = F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_INNER)), F.translate(text, _OPEN + _INNER, "\x03\x03")).otherwise(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body"))
    body = F.col("body")
    rows = rows.select(
        "doc_id",
        F.filter(_matches(body, ASSIGN, 2), lambda x: F.length(x["g"]) >= 8).alias("a"),
        _matches(body, ACCESS).alias("k"),
        _matches(body, HEX).alias("h"),
        _matches(body, CANDIDATE).alias("c"),
    )
    plain = F.array_sort(F.concat(_spans(F.col("a"), "assign"), _spans(F.col("k"), "access"), _spans(F.col("h"), "hex")))
    rows = rows.select("doc_id", *[F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("h", "n_hex"))], plain.alias("plain"), "c")
    rows = rows.withColumn("more", F.filter(_apart(F.col("c"), F.col("plain")), lambda x: is_random(x["m"])))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("plain")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("plain", _spans(F.col("more"), "entropy")))).alias("spans"),
        F.size("more").cast("long").alias("n_entropy"),
    )


def op4_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; see :func:`detect`."""
    return detect(common.corpus(spark, sf_dir))
