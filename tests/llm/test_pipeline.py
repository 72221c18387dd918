"""The stages one after another, each against its operator's decisions."""

import corpus_pipeline as cp

from tracework.llm import pii
from tracework.llm.jaccard_join import ngram_jaccard_join
from tracework.llm.mixing import mix
from tracework.llm.quality import score_quality
from tracework.llm.queries import WEIGHTS
from tracework.plans.materialize import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names, stages = zip(*cp.STAGES)
    kept = stages[0](spark, docs, SF).cache()
    good = {r.doc_id for r in score_quality(docs, labels).where("good").collect()}
    assert {r.doc_id for r in kept.collect()} == good and tuple(kept.columns) == cp.COLUMNS
    one = stages[1](spark, kept, SF).cache()
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in ngram_jaccard_join(kept).collect() if r.doc_id == r.component_id}
    clean = stages[2](spark, one, SF).cache()
    assert clean.count() == one.count()
    assert all(not pii.base_spans(r.text)[0] and r.n_chars == len(r.text) for r in clean.collect())
    mixed = stages[3](spark, clean, SF).cache()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in clean.collect())
    assert tuple(mixed.columns) == cp.COLUMNS
    last = stages[4](spark, mixed, SF)
    assert last.count() == mixed.count() and last.where("n_tokens = 0 or size(ids) != n_tokens").count() == 0
    empty = docs.where("false")
    for stage in stages:
        assert stage(spark, empty, SF).count() == 0


def test_result_carries_the_mixed_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    giant = docs.limit(1).selectExpr("doc_id", "repeat('word ', 8000) as text", "lang", "source", "n_chars")
    odd = docs.limit(1).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    docs = materialize(docs.limit(60).unionByName(giant).unionByName(odd).unionByName(odd))
    want = sorted((r.mix_slot, r.mix_place, r.doc_id) for r in mix(docs, WEIGHTS).collect())
    last = cp.pieces(spark, materialize(cp.mixture(spark, docs, SF)), SF)
    assert sorted((r.mix_slot, r.mix_place, r.doc_id) for r in last.collect()) == want
    assert len({w[:2] for w in want}) == len(want) == 63


def test_near_duplicates_of_repeated_and_null_ids(spark):
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(40)) for w in "abcd")
    rows = [(1, one), (1, one), (2, two), (2, three), (3, three), (4, two), (None, one), (None, four), (None, four), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, one), (2, two), (2, three), (None, four), (5, None)], key=str)


def test_stages_on_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS).limit(120)
    null = spark.createDataFrame([(None, None, None, None, None)], docs.schema)
    long = docs.limit(1).selectExpr("9000001L as doc_id", "repeat('a long text of many words ', 9000) as text", "lang", "source", "n_chars")
    names = ("ids", "tree", "component_id", "spans", "good", "mix_slot", "h", "xa", "place", "rule")
    odd = docs.unionByName(docs.limit(5)).unionByName(null).unionByName(null).unionByName(long)
    odd = materialize(odd.selectExpr("*", *(f"{k} as `{n}`" for k, n in enumerate(names))))
    out = odd
    counts = [out.count()]
    for _, stage in cp.STAGES[:-1]:
        out = materialize(stage(spark, out, SF))
        assert tuple(out.columns) == cp.COLUMNS
        counts.append(out.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] == counts[4] > 0
    last = cp.STAGES[-1][1](spark, out, SF).collect()
    assert len(last) == counts[4] and len({(r.mix_slot, r.mix_place) for r in last}) == len(last)


def test_stages_composed_without_writes_and_interleaved_runs(spark):
    """Lazy results of one stage go into the next, and two runs take turns, without losing each other's tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    want = sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, SF).select("doc_id", "n_tokens").collect())
    one, two = docs, docs
    for (_, a), (_, b) in zip(cp.Run().stages, cp.Run().stages):
        one, two = a(spark, one, SF), materialize(b(spark, two, SF))
    assert sorted((r.doc_id, r.n_tokens) for r in one.collect()) == want
    assert sorted((r.doc_id, r.n_tokens) for r in two.collect()) == want


def test_what_stages_wrote_goes_with_the_next_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    run = cp.Run()
    out = materialize(run.stages[0][1](spark, docs, SF))
    before = list(run.left)
    run.stages[2][1](spark, out, SF)
    assert before and not set(before) & set(run.left)


def test_pieces_follow_the_order_that_mixture_wrote(spark, monkeypatch):
    monkeypatch.setattr(cp, "RUN_ROWS", 7, raising=False)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS).limit(150)
    giant = docs.where("doc_id % 50 = 7").selectExpr("doc_id + 9000000 as doc_id", "repeat(text, 300) as text", "lang", "source", "n_chars")
    docs = materialize(docs.unionByName(giant))  # files of other sizes, which are not read in the order of their names
    placed = mix(docs, WEIGHTS).orderBy("mix_slot", "mix_place").collect()
    ids = lambda t: [(r.doc_id, r.mix_slot, r.mix_place) for r in sorted(t.collect(), key=lambda r: r.position)]
    mixed = materialize(cp.mixture(spark, docs, SF))
    for rows in (mixed, cp.mixture(spark, docs, SF)):  # written, and not yet
        out = cp.pieces(spark, rows, SF)
        assert ids(out) == [(r.doc_id, r.mix_slot, r.mix_place) for r in placed]
        assert sorted(r.position for r in out.collect()) == list(range(len(placed)))
    other = ids(cp.pieces(spark, materialize(docs.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")), SF))
    assert [d for d, _, _ in other] == sorted(r.doc_id for r in placed)
    assert {d: (s, p) for d, s, p in other} != {r.doc_id: (r.mix_slot, r.mix_place) for r in placed}
    several = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS).limit(3))
    assert sorted(r.position for r in cp.pieces(spark, several, SF).collect()) == list(range(len(placed) + 3))
