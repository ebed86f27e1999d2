"""Secret scans in DataFrame and SQL functions only (operator 5).

Base kinds are patterns; a match's place comes from the lengths of the gaps between matches, so no
position function is needed. The method adds `entropy` spans: candidate strings are runs of one
character class (hex, or base64-like), a window slides over each, and the Shannon entropy of the
window follows from incremental counts: the counts of all symbols are carried along, packed in a few
numbers; one symbol leaves, one enters, and only their two terms of the sum of c * log2(c) change.
The span runs from the first to the last window that reaches the threshold of its class. With
hex_runs, runs of hex digits of either case are candidates of their own, wherever they stand, and are
judged in lower case by the threshold of their class; of entropy spans inside each other the outermost
stays. An allow-list suppresses added spans (plain words and paths, identifiers of fixed form,
placeholders); it never removes base spans.

Everything is a projection: no shuffle, no Python on the executors, memory bounded by one text. Time
is in proportion to a text's length: candidates are the matches themselves, never cut anew from the
text; running sums work by chunks of chunks; redaction cuts from pieces of bounded length.

Edge cases: null text counts as empty (and stays null when redacted); a text without spans has counts
0, spans '' and the hash of ''; repeated rows are scanned each by itself; extra columns are ignored
(scan) or kept (redact); empty tables stay empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in order, their patterns, and the least length of the judged group.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Candidate strings of the entropy scan, the window, and the least entropy (bits a character).
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
HEX_RUN = r"[0-9A-Fa-f]{20,}"
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "base64": 3.9}
#: Candidates that are no secrets: no digit, digits alone, UUIDs, placeholders.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[0-9_/+=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy|x{6}|0{6}|123456789|abcdefgh",
)
_CHUNK = 64
#: Characters of the pieces that redaction cuts from.
_PIECE = 4096
#: Symbols are ASCII codes from `+` on; their counts take 5 bits each, 12 to a number.
_FIRST, _SYMBOLS, _BITS, _EACH = 43, 80, 5, 12


def _prefix(values: Column, joined, start: Column, levels: int = 3) -> Column:
    """For each place of an array, the fold of all before it; by chunks of chunks, so nearly linear."""
    fold = lambda xs: F.aggregate(xs, start, joined)
    if not levels:
        return F.transform(values, lambda _, i: fold(F.slice(values, F.lit(1), i)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK)))

    def inside(chunk: Column, base: Column) -> Column:
        return F.transform(chunk, lambda _, i: joined(base, fold(F.slice(chunk, F.lit(1), i))))

    def every(cs: Column) -> Column:
        return F.flatten(F.zip_with(cs, _prefix(F.transform(cs, fold), joined, start, levels - 1), inside))

    # Bound as a lambda variable, so that the chunks are made once.
    return F.when(F.size(values) > 0, F.get(F.transform(F.array(chunks), every), F.lit(0))).otherwise(F.slice(values, 1, 0))


def _spans(df: DataFrame, out: str, text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> DataFrame:
    """Add `out`: array of (start, kind, end) of the pattern's matches that keep(group's text) holds for.

    Candidates (kind 3) carry their text as well.
    """
    hits, size, gaps, at = (f"__{out}_{x}" for x in ("hits", "size", "gaps", "at"))
    none = F.array().cast(f"array<struct<start:int,kind:int,end:int{',text:string' * (kind == 3)}>>")
    df = df.withColumn(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size(hits) > 0
    if keep is None:
        judged = F.transform(hits, lambda x: F.lit(True))
    elif group:
        judged = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), keep)
    else:
        judged = F.transform(hits, keep)
    df = df.withColumn(size, F.transform(hits, lambda x: F.length(x)))
    df = df.withColumn(gaps, F.when(some, F.transform(F.split(text, pattern, -1), lambda x: F.length(x))).otherwise(F.array().cast("array<int>")))
    before = F.slice(gaps, F.lit(1), F.size(hits))
    # Arrays are zipped, never read by place inside a lambda: a column there could be found anew each time.
    df = df.withColumn(at, F.when(some, _prefix(F.zip_with(size, before, lambda x, g: x + g), lambda a, b: a + b, F.lit(0))).otherwise(F.array().cast("array<int>")))
    zipped = F.arrays_zip(F.col(hits).alias("text"), F.col(size).alias("n"), before.alias("gap"), F.col(at).alias("at"), judged.alias("ok"))
    own = lambda x: [x["text"].alias("text")] * (kind == 3)
    place = lambda x: F.struct((x["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (x["at"] + x["gap"] + x["n"]).alias("end"), *own(x))
    return df.withColumn(out, F.when(some, F.transform(F.filter(zipped, lambda x: x["ok"]), place)).otherwise(none)).drop(hits, size, gaps, at)


def entropy_windows(s: Column, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> Column:
    """(first, last): starts of the first and last window of s that reach its class's threshold.

    Both are -1 if none does or s is shorter than the window. s holds symbols of a candidate only.
    """
    if window >= 1 << _BITS:
        raise ValueError(f"counts of a window hold {_BITS} bits")
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    none = F.array(*[F.lit(0).cast("bigint")] * -(-_SYMBOLS // _EACH))
    # The number that holds a symbol's count, where it is there, and one of it.
    place = lambda c: F.struct(F.floor(c / _EACH).cast("int").alias("q"), ((c % _EACH) * _BITS).alias("s"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (c % _EACH) * _BITS).alias("v"))
    symbols = F.transform(F.split(s, ""), lambda c: place(F.ascii(c) - _FIRST))
    least = F.when(s.rlike("^[0-9a-f]+$"), thresholds["hex"]).otherwise(thresholds["base64"])

    def scan(cs: Column) -> Column:
        count = lambda a, x: F.call_function("shiftright", F.get(a["counts"], x["q"]), x["s"]).bitwiseAND((1 << _BITS) - 1).cast("int")
        term = lambda n: F.get(terms, n)
        only = lambda j, x: F.when(j == x["q"], x["v"]).otherwise(F.lit(0).cast("bigint"))

        def moved(a: Column, new: Column, out: Column) -> Column:
            """The state after `new` has entered the window and, where there is one, `out` has left."""
            gone = F.when(out.isNull(), 0.0).otherwise(term(count(a, out) - 1) - term(count(a, out)))
            came = count(a, new) - F.when(out["q"] == new["q"], (out["s"] == new["s"]).cast("int")).otherwise(0)
            counts = F.transform(a["counts"], lambda x, j: x + only(j, new) - only(j, out))
            return F.struct((a["at"] + 1).alias("at"), (a["total"] + gone + term(came + 1) - term(came)).alias("total"), counts.alias("counts"), a["first"].alias("first"), a["last"].alias("last"))

        def judged(a: Column) -> Column:
            begin = a["at"] - (window - 1)
            fits = (begin >= 0) & (F.lit(math.log2(window)) - a["total"] / window >= least - 1e-9)
            return F.struct(a["at"].alias("at"), a["total"].alias("total"), a["counts"].alias("counts"), F.when(fits & (a["first"] < 0), begin).otherwise(a["first"]).alias("first"), F.when(fits, begin).otherwise(a["last"]).alias("last"))

        start = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("total"), none.alias("counts"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        pairs = F.transform(cs, lambda new, i: F.struct(new.alias("new"), F.when(i >= window, F.get(cs, i - window)).alias("out")))
        step = lambda a, x: F.get(F.transform(F.array(moved(a, x["new"], x["out"])), judged), F.lit(0))
        return F.aggregate(pairs, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    empty = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.when(F.length(s) < window, empty).otherwise(F.get(F.transform(F.array(symbols), scan), F.lit(0)))


def _entropy_spans(runs: str, judged) -> Column:
    """Spans of the windows that reach the threshold in the candidates of column `runs`; judged: the text of one."""
    tried = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), entropy_windows(judged(x["text"])).alias("w")))
    tried = F.when(F.size(runs) > 0, F.filter(tried, lambda x: x["w"]["first"] >= 0)).otherwise(F.array())
    return F.transform(
        tried,
        lambda x: F.struct((x["start"] + x["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["w"]["last"] + WINDOW).alias("end")),
    )


def _outermost(df: DataFrame, spans: str) -> DataFrame:
    """Of a column of spans those that lie inside no other one; of equal ones the first."""
    some = F.size("__order") > 0
    df = df.withColumn("__order", F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind")))))
    reach = _prefix(F.transform("__order", lambda x: -x["back"]), lambda a, b: F.greatest(a, b), F.lit(0))
    df = df.withColumn("__far", F.when(some, reach).otherwise(F.array().cast("array<int>")))
    held = F.filter(F.arrays_zip(F.col("__order").alias("x"), F.col("__far").alias("far")), lambda z: -z["x"]["back"] > z["far"])
    plain = F.transform(held, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["kind"].alias("kind"), (-z["x"]["back"]).alias("end")))
    return df.withColumn(spans, plain).drop("__order", "__far")


def find(docs: DataFrame, text_col: str = "text", out: str = "secret_spans", hex_runs: bool = False) -> DataFrame:
    """Add `out`: all spans, an array of (start, kind index, end), by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = _spans(docs, "__assign", text, ASSIGN, 0, lambda x: F.length(x) >= 8, 2)
    df = _spans(df, "__access", text, ACCESS, 1)
    df = _spans(df, "__hex", text, HEX, 2)
    df = _spans(df, "__runs", text, CANDIDATE, 3, lambda s: ~_allowed(s))
    df = df.withColumn("__found", _entropy_spans("__runs", lambda s: s))
    if hex_runs:
        df = _spans(df, "__runs", text, HEX_RUN, 3, lambda s: ~_allowed(s))
        df = df.withColumn("__found", F.concat("__found", _entropy_spans("__runs", F.lower)))
        df = _outermost(df, "__found")
    every = F.array_sort(F.concat("__assign", "__access", "__hex", "__found"))
    return df.withColumn(out, every).drop("__assign", "__access", "__hex", "__runs", "__found")


def _allowed(s: Column) -> Column:
    out = s.rlike(ALLOWED[0])
    for p in ALLOWED[1:]:
        out = out | s.rlike(p)
    return out


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hex_runs: bool = False) -> DataFrame:
    """One row per document: counts by kind, hash of the base spans, and all spans."""
    df = find(docs.select(id_col, text_col), text_col, "__spans", hex_runs)
    n = lambda k: F.size(F.filter("__spans", lambda x: x["kind"] == k)).cast("long")
    return df.select(
        id_col,
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        n(3).alias("n_entropy"),
        F.sha2(_named(F.filter("__spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _named(F.col("__spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", hex_runs: bool = False) -> DataFrame:
    """Replace every span, overlapping ones together, by `mark`; texts without spans stay as they are."""
    df = find(docs, text_col, "__spans", hex_runs)
    reach = _prefix(F.transform("__spans", lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    df = df.withColumn("__reach", F.when(F.size("__spans") > 0, reach).otherwise(F.array().cast("array<int>")))
    text = F.col(text_col).cast("string")
    df = df.withColumn("__pieces", F.when(F.size("__spans") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))

    def joined(pieces: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            """The characters from start to end, cut from the pieces that hold them."""
            first, last = F.floor(start / _PIECE).cast("int"), F.floor(F.greatest(end - 1, start) / _PIECE).cast("int")
            held = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return F.when(end > start, F.substring(held, start % _PIECE + 1, end - start)).otherwise("")

        def part(z: Column) -> Column:
            return F.when(z["x"]["start"] < z["done"], F.lit("")).otherwise(F.concat(between(z["done"], z["x"]["start"]), F.lit(mark)))

        last = F.array_max(F.transform("__spans", lambda x: x["end"]))
        parts = F.transform(F.arrays_zip(F.col("__spans").alias("x"), F.col("__reach").alias("done")), part)
        return F.concat(F.array_join(parts, ""), between(last, F.length(text)))

    whole = F.get(F.transform(F.array("__pieces"), joined), F.lit(0))
    return df.withColumn(text_col, F.when(F.size("__spans") > 0, whole).otherwise(F.col(text_col))).drop("__spans", "__reach", "__pieces")
