"""Operators 11 to 13 against brute force, with edge cases."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docquarry.llm import changes, mixing, queries, resampling
from docquarry.operators.ranks import running

SF = "/root/testdata/sf0.001"
CHANGE = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
RUNS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


# --- sums over ranges


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(5)) for i in range(400)]
    made = spark.createDataFrame(rows, "g string, i long, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.i): r.s for r in running(made, ["g"], [F.desc("i")], F.col("v"), "s").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(g, i): sum(w for h, j, w in rows if h == g and j >= i) for g, i, _ in rows}
    assert running(made.limit(0), ["g"], [F.col("i")], F.lit(1), "s").count() == 0


# --- op11


def plain_apply(rows, batches=8):
    rows, seqs = set(rows), defaultdict(set)
    for r in rows:
        seqs[r[1]].add(r[2])
    rank = {c: {s: i + 1 for i, s in enumerate(sorted(v, key=lambda x: (x is not None, x or 0)))} for c, v in seqs.items()}
    dealt = defaultdict(list)
    for r in rows:
        if r[0] is None or r[4] is None or (h := zlib.crc32(str(r[0]).encode())) % 11 == 0:
            continue
        day = (r[4].date() - datetime.date(1970, 1, 1)).days + 2 * (h % 4)
        first = lambda x: (x is not None, x if x is not None else 0)
        dealt[max(1, min(batches, 1 + math.floor((day - 19723) * batches / 160)))].append((day, r[0], (r[3] is not None, r[3] or ""), (r[7] is not None, r[7] or ""), first(r[8]), r[1], rank[r[1]][r[2]], r[3], r[7], r[8]))
    out, last, largest = [], {}, None
    following, held, state = defaultdict(lambda: 1), defaultdict(dict), defaultdict(lambda: [None, None])

    def take(c, n, b, missed):
        change, op, city, balance, _ = held[c].pop(n)
        s = state[c]
        if op in ("I", "D"):
            s[:] = [city, balance] if op == "I" else [None, None]
        elif op == "U":
            s[:] = [s[0] if city is None else city, s[1] if balance is None else balance]
        following[c] = n + 1
        last[c] = (len(out), op)
        out.append([change, c, "applied", b, missed, s[0], None if s[1] is None else math.floor(100 * s[1] + 0.5), False])

    def run(c, b):
        while following[c] in held[c]:
            take(c, following[c], b, 0)

    for b in range(1, batches + 2):
        for c in list(held):
            while held[c] and (b > batches or largest is not None and min(x[4] for x in held[c].values()) + 5 <= largest):
                n = min(held[c])
                take(c, n, b, n - following[c])
                run(c, b)
        for day, change, *_, c, n, op, city, balance in sorted(dealt[b], key=lambda x: x[:5]):
            if n < following[c] or n in held[c]:
                out.append([change, c, "rejected", b, 0, None, None, False])
            else:
                held[c][n] = (change, op, city, balance, day)
                run(c, b)
            largest = max(largest or day, day) if b <= batches else largest
        largest = max([x[0] for k in range(1, b + 1) for x in dealt[k]], default=None)
    for i, op in last.values():
        out[i][7] = op != "D"
    return Counter(map(tuple, out))


def applied(df, **kw):
    names = ("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")
    return Counter(tuple(r[k] for k in names) for r in changes.apply(df, **kw).collect())


def test_change_applier_query_against_plain(spark):
    rows = spark.read.parquet(f"{SF}/client_changes.parquet")
    names = ("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")
    got = Counter(tuple(r[k] for k in names) for r in queries.op11_change_applier(spark, SF).collect())
    assert got == plain_apply(map(tuple, rows.collect()))
    assert {k[2] for k in got} == {"applied", "rejected"} and max(k[3] for k in got) > 8


def test_change_applier_on_awkward_rows(spark):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(260):  # a hot client, a null one, repeated numbers and ids, gaps, nulls in any column
        client = rng.choice([1, 1, 1, 2, 3, None])
        when = None if rng.random() < 0.05 else start + datetime.timedelta(days=rng.randrange(-3, 150), hours=rng.randrange(24))
        rows.append((None if rng.random() < 0.03 else i // 2 if rng.random() < 0.1 else i, client, None if rng.random() < 0.05 else rng.randrange(90), rng.choice(["I", "U", "U", "U", "D", None, "X"]), when, None, None, rng.choice([None, "Ä", "b", ""]), rng.choice([None, 1.005, -2.5, 99.999])))
    rows += rows[:20]
    frame = spark.createDataFrame(rows, CHANGE).withColumns({c: F.lit("clash") for c in ("batch", "n", "day", "status", "tick", "bucket", "next")})
    assert applied(frame, buckets=3) == plain_apply(rows)
    assert changes.apply(frame.limit(0), buckets=2).count() == 0


# --- op12


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if weight[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def judged(rows, texts, slack):
    sizes = defaultdict(int)
    for _, source, text in texts:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = plain_targets(sizes), defaultdict(int)
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == Counter((i, s, len(WORD.findall(t or ""))) for i, s, t in texts)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] and abs(r.copies - r.rate) <= 1 + 1e-6 + 3
        taken[r.source] += r.taken
    for s, t in want.items():
        largest = max(len(WORD.findall(x or "")) for _, source, x in texts if source == s)
        # Whole copies can't come nearer than a document that is itself a large part of the target.
        assert abs(taken[s] - t) <= (slack * t + 1 if 10 * largest < t else largest), (s, taken[s], t)


def test_mixing_meets_targets_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    judged(rows, [(r.doc_id, r.source, r.text) for r in docs.collect()], 0.02)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixing_rates_are_exponential_in_size(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), "en", "ab"[i % 3 == 0], 0) for i in range(900)], DOC)
    rows = mixing.mix(docs).collect()
    for source in "ab":
        own = {r["size"]: r.rate for r in rows if r.source == source and r.rate < 3}
        slopes = [math.log(v) / z for z, v in own.items()]
        assert max(slopes) - min(slopes) < 1e-4
        goal = next(r.target for r in rows if r.source == source)
        assert abs(sum(r.rate * r["size"] for r in rows if r.source == source) / goal - 1) < 1e-4


def test_mixing_caps_hot_sources_and_awkward_rows(spark):
    texts = [(i, "big", "one two three four " * (1 + i % 7)) for i in range(300)] + [(1000 + i, "zz", "a b") for i in range(4)]
    texts += [(7, None, "x y z"), (7, None, "x y z"), (None, "big", "q"), (8, "big", None), (9, "void", None), (10, "void", " \t"), (11, "", "v " * 20_000)] + [(2000 + i, "", "u " * (i + 1)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, None, s, None) for i, s, t in texts], DOC).withColumns({c: F.lit("clash") for c in ("size", "target", "k", "weight", "tilt", "upto", "copies", "place", "left")})
    rows = mixing.mix(docs).collect()
    judged(rows, texts, 0.02)
    assert all(r.copies == 3 for r in rows if r.source == "zz")
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("source = 'void'")).collect()} == {0}


# --- op13


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_features(text):
    w = RUNS.findall(low(text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(texts, target):
    each = [(i, *plain_features(t)) for i, t in texts]
    s, t = Counter(x for *_, f in each for x in f), Counter(x for text in target for x in plain_features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in each:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(able) * 5 // 100
    return Counter([(r[0], *r[2:], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(r[0], *r[2:], None) for r in rows if r[1] < 20])


def test_resampling_query_against_plain(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = Counter(map(tuple, queries.op13_importance_resampling(spark, SF).collect()))
    assert got == plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])


@pytest.mark.parametrize("most", [64, 8 << 20])
def test_resampling_of_awkward_rows_in_slices(spark, most):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["Ab", "c-d", "é", "中文", "x" * 150, "9", "İ"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    texts += [(1, None), (2, ""), (3, "...  "), (None, "null id " * 30), (None, "null id " * 30), (5, texts[5][1]), (200, "Zz " * 9000), (201, "u" * 3000 + " " + "v" * 700 + " w" * 30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "words", "cut", "weight", "rank", "score")})
    bench = spark.createDataFrame([(1, "ab c d é 中文"), (2, None), (None, "Ab ab")], "item_id long, text string")
    got = Counter(map(tuple, resampling.resample(docs, bench, most=most).collect()))
    assert got == plain_resample(texts, ["ab c d é 中文", None, "Ab ab"])
    assert sum(x[-1] is not None for x in got.elements()) > 0
    assert resampling.resample(docs.limit(0), bench.limit(0)).count() == 0
