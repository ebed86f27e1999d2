"""The pipeline: each stage on what the one before kept, against plain versions of the decisions."""

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    from docquarry.session import materialize

    sf, docs, out = "/root/testdata/sf0.001", None, {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), name)
        out[name] = (before, docs)
    return out


def test_stages_keep_columns_and_follow_texts(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes
            assert after.where("n_chars <> length(text)").count() == 0


def plain_first(rows):
    """Each document's smallest linked one: five-word shingles, 0.8; fewer words are one shingle."""
    words = {d: re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for d, t in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    first = {d: d for d in sets}
    for _ in range(len(rows)):
        before = dict(first)
        for a, b in near:
            first[a] = first[b] = min(first[a], first[b])
        if before == first:
            return first
    return first


def test_decisions_take_effect(spark, stages):
    from docquarry.llm import quality, secrets
    from tests.llm.test_operators import brute_cut

    before, after = stages["quality"]
    model = quality.train(before, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    good = {r.doc_id for r in quality.score(before, model).where("score >= 0.7").collect()}
    assert {r.doc_id for r in after.collect()} == good and 0 < len(good) < before.count()
    before, after = stages["near_duplicates"]
    first = plain_first([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {d for d, c in first.items() if d == c}
    before, after = stages["substrings"]
    lost = {d: n for d, _, n, _ in brute_cut([(r.doc_id, r.text) for r in before.collect()])}
    kept = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        assert (kept[r.doc_id] == r.text) == (lost[r.doc_id] == 0)
        assert len(kept[r.doc_id].split()) == len(r.text.split()) - lost[r.doc_id]
    before, after = stages["secrets"]
    assert after.count() == before.count()
    assert secrets.scan(after).where("n_access + n_hex > 0").count() == 0
    before, after = stages["packing"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.collect()}


def test_run_equals_its_stages(spark, stages):
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    rows = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows(pipeline.run(spark, "/root/testdata/sf0.001")) == rows(stages["packing"][1])


def test_near_duplicates_link_five_word_shingles_at_four_fifths(spark):
    """Against a brute force of its own: five words, 0.8; some links lie under 0.85."""
    rng, rows = random.Random(6), []
    for family in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(400)]
        rows.append((family * 10, " ".join(base)))
        for copy, more in enumerate((60, 80, 90, 98, 110, 140), 1):
            rows.append((family * 10 + copy, " ".join(base + [f"x{family}_{copy}_{i}" for i in range(more)])))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    first = {d: d for d in sets}
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert any(100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in near)
    for _ in rows:
        for a, b in near:
            first[a] = first[b] = min(first[a], first[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {d for d, c in first.items() if d == c}
