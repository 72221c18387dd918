"""Token counts, conversation tries and whitening, against plain versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tracework.llm import conversation_trie as trie
from tracework.llm import spectrum
from tracework.llm import token_counts as tokens
from tracework.llm.queries import queries
from tracework.llm.radix_tree import Node, RadixTree, common
from tracework.llm.sql import SQL
from tracework.llm.whitening import whiten

JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library_counts(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    return [len(library.encode(t, add_special_tokens=False)) for t in texts]


AWKWARD = [
    "", " ", "\n\n  x", "it's  we'll\tcan't ", "a1b22c 3d", "<|endoftext|>", "x <|endoftext|>  y<|endoftext|>", "<|endof", "🙂🙂 é́", "一二三。四五，六",
    "a b c ​ d\x85e\x1cf", "A. B, c; d! e?", "'s'll 's", "tab\t\tnew\r\nline", "\x00\x01", "x" * 300, "word " * 400, "<|endoftext|>" * 50,
]


def test_parts_add_up():
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "7", " ", "  ", "\n", "\t", "'s", "'", ".", ",", "。", "一", "<|endoftext|>", "<|", "|>", " ", "🙂", "_", "-", "́", "٣", "x9"]
    texts = AWKWARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(1500)]
    count, safe = tokens.tokenizer(JSON, open(JSON, "rb").read())
    for part in (1, 5, 40):
        assert tokens.lengths(texts, count, safe, 1 << 16, part) == library_counts(texts)


def test_safe_places_only_for_known_settings():
    import json

    spec = json.load(open(JSON))
    assert tokens.safe_places(spec) is tokens.SAFE
    for change in (
        {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}},
        {"normalizer": {"type": "NFC"}},
        {"added_tokens": [{**spec["added_tokens"][0], "content": "two words"}]},
        {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]},
    ):
        assert tokens.safe_places({**spec, **change}) is None


def test_token_counts(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(AWKWARD)] + [(None, None, None, 2), (None, "a b", "y", 3), (3, AWKWARD[3], "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row int")
    want = sorted((str(r[0]), len((r[1] or "").encode()), n, n > 5) for r, n in zip(rows, library_counts([r[1] or "" for r in rows])))
    for long in (tokens.LONG, 64):  # the second deals the parts of longer texts over the tasks
        got = tokens.count_tokens(docs, JSON, limit=5, long=long, part=16, batch=128)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert tokens.count_tokens(docs.limit(0), JSON).count() == 0
    kept = tokens.count_tokens(docs.withColumnRenamed("row", "piece"), JSON, keep=("piece", "doc_id"))
    assert kept.columns[:2] == ["piece", "doc_id"] and kept.count() == len(rows)


def test_token_counts_of_megabytes_and_pieces(spark):
    big = ("lorem ipsum 12 " * 100_000) + "z" * 5000
    docs = spark.createDataFrame([(1, big), (2, "short one"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, JSON).collect()}
    assert got == dict(zip((1, 2, 3), library_counts([big, "short one", ""])))
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, PIECES).collect()}
    assert got == {1: len(library.encode(big)), 2: len(library.encode("short one")), 3: 0}


def test_token_counts_query(spark):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries()["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    rows = duckdb.sql("select doc_id, coalesce(text, '') from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    want = {i: (len(t.encode()), n, n > 512) for (i, t), n in zip(rows, library_counts([t for _, t in rows]))}
    assert got == want


def test_radix_tree_layouts():
    rng = random.Random(5)
    for fan in (2, 4, 5, 16, 17, 48, 49, 200, 256):
        keys = {bytes([rng.randrange(fan), *(rng.randrange(3) for _ in range(rng.randrange(5)))]) for _ in range(800)} | {b"", bytes([fan - 1])}
        tree, shuffled = RadixTree(), sorted(keys)
        rng.shuffle(shuffled)
        for k in shuffled:
            tree.insert(k, k)
        at, found, ways = {}, [], []
        for start, own, node, least, greatest in tree.walk():
            whole = at.get(start, b"")[:start] + own
            at[len(whole)] = whole
            if node.value is not None:
                assert node.value == whole
                found.append(whole)
            ways.append((least, greatest, whole))
            assert node.layout in (0, 4, 16, 48, 256) and (node.layout == 0) == (not node.ordered())
            assert node.layout in (0, 4) or len(node.ordered()) > {16: 4, 48: 16, 256: 48}[node.layout]
        assert found == sorted(keys)
        for least, greatest, whole in ways:
            assert least == min(keys).startswith(whole) and greatest == max(keys).startswith(whole)
    assert common(b"abcd", b"abxd") == 2 and common(b"", b"a") == 0 and common(b"aaaa", b"aa") == 2
    assert Node(b"").child(3) is None


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:])
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(ids) if len(whole[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(ids), len(p), parent, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("sizes", [{}, {"range_bytes": 100, "run_bytes": 24}])
def test_trie_against_plain_version(spark, sizes):
    rng = random.Random(7)
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, None, "user", ""), (205, 1, "a", "bc"), (205, 1, "ab", "c"), (-7, 0, "user", "neg"), (-150, 2, "u", "é🙂")]
    for c in range(140):
        many = 7 if c in (100, 0) else rng.randrange(0, 7)
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant"][: 1 + (t > 1)]), rng.choice(["hi", "hi", "you", "", None, "naïve"])) for t in range(many)]
    rows += [(c, 0, "user", "same") for c in range(1000, 1060)]  # no base, some without turns; a large group of equal ones
    rows += [(5, None, None, None)] * 2
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], CONV + ", node int, ids string")
    got = trie.conversation_trie(frame, **sizes)
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows_out = [tuple(r)[:8] for r in got.collect()]
    assert sorted(rows_out, key=str) == plain_trie(rows)


def test_trie_of_long_and_no_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], CONV)).count() == 0
    rows = [(c, t, "user", "same") for c in (100, 101) for t in range(3000)] + [(101, 3000, "user", "more" * 100_000)]
    got = {(r.depth, r.conv_id): r for r in trie.conversation_trie(spark.createDataFrame(rows, CONV)).collect()}
    assert len(got) == 3002 and got[(3001, 101)].parent_conv_id == 100 and got[(0, 100)].saved_tokens == 3000 * 4
    c = next(c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6)  # its first turn goes, and there is no base
    only = trie.conversation_trie(spark.createDataFrame([(c, 0, "u", "gone")], CONV)).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in only] == [(c, 0, None, 1, 0, 1, 0)]
    assert only[0].ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


def test_trie_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    got = [tuple(r) for r in queries()["op12_conversation_trie"](spark, data).collect()]
    with duckdb.connect() as con:
        con.sql(f"create view conversations as select * from '{data}/conversations.parquet'")
        want = con.sql(SQL["op12_conversation_trie"]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_whitening(rows):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum(int(n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    z = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x], float)
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return deviation, z, e, q, np.trace(v)


def check_whitening(got, rows, most=8):
    deviation, z, e, q, trace = plain_whitening(rows)
    k = min(most, sum(e > 1e-12 * trace))
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    for c in range(1, k + 1):
        found = by[c]
        for i, (vec_id, _) in enumerate(rows):
            r = found[vec_id]
            assert (r.n, r.deviation) == (len(rows), deviation[i]) and int(r.deviation_exact) == deviation[i]
            assert abs(r.explained * trace / e[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        w = np.array([found[i].whitened for i, _ in rows])
        want = z @ q[:, c - 1] / np.sqrt(e[c - 1])
        assert min(abs(w - want).max(), abs(w + want).max()) < 1e-8
    return k


def test_whitening_against_plain_version(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(12) * np.linspace(3, 0.2, 12) + 40]) for i in range(300)]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0, 2.0]), (906, [1e300] * 12)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, component int, e string")
    assert check_whitening(whiten(frame).collect(), rows) == 8
    assert check_whitening(whiten(frame, components=3).collect(), rows, 3) == 3


def test_whitening_of_few_dimensions_ties_and_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    square = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])]
    got = whiten(spark.createDataFrame(square, schema)).collect()
    assert len(got) == 8 and {round(r.explained, 12) for r in got} == {0.5} and max(r.identity_error for r in got) < 1e-12
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    assert check_whitening(whiten(spark.createDataFrame(line, schema)).collect(), line) == 1
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(None, None)]):
        assert whiten(spark.createDataFrame(rows, schema)).collect() == []
    again = [(None, [1.0, 2.0]), (7, [3.0, 5.0]), (7, [3.0, 5.0])]
    assert len(whiten(spark.createDataFrame(again, schema)).collect()) == 3  # one component, each row counts


def test_whitening_of_large_numbers(spark):
    rows = [(i, [float(x) * 1e9 for x in v]) for i, v in enumerate(np.random.default_rng(4).standard_normal((50, 3)))]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    deviation, *_ = plain_whitening(rows)
    assert {int(r.deviation_exact) for r in got} == set(deviation) and all(r.deviation is None for r in got if r.deviation_exact >= 1 << 63)
    assert len(got) == 150


def test_whitening_query(spark):
    data = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select vec_id, embedding from '{data}/embeddings.parquet' where embedding is not null").fetchall()
    check_whitening(queries()["op13_embedding_whitening"](spark, data).collect(), rows)


def test_spectrum_with_clusters():
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for values in (np.r_[5.0, 5, 5, 3, 3, 1, np.zeros(34)], np.ones(40), np.r_[1e9, 1e9 * (1 - 1e-9), 1, 1, 0.5, np.zeros(35)], np.zeros(40), np.linspace(40, 1, 40)):
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        found, vectors = spectrum.leading(a, 8)
        assert np.allclose(found, np.sort(values)[::-1][:8], atol=1e-13 * max(values.max(), 1), rtol=0)
        assert abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13
        for shift in (-1.0, 0.7, 2.1, 4.1, 1e8):
            assert spectrum.above(a, shift) == (values > shift).sum()


def test_groups_of_hot_cells_and_tokens_stay_small(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tracework.llm import embedding_dedup as dedup
    from tracework.llm import jaccard_join as join

    for module in (dedup, join):
        monkeypatch.setattr(module, "BLOCK_ROWS", 16)
        monkeypatch.setattr(module, "GROUP_BYTES", 8 << 10)
    reps = spark.range(600).select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("copies"), F.array(F.lit(1.0)).alias("v"))
    cells = F.array(F.struct(F.lit(7).cast("long").alias("cell"), F.lit(True).alias("home"), F.lit(600).cast("long").alias("c")))
    full = spark.createDataFrame([(7, 600)], "cell long, c long")
    rows = dedup._dealt(reps, reps.select("rep", cells.alias("cells")), full).cache()
    assert rows.count() == 600 * 38  # each vector meets all sides
    assert rows.groupBy("bucket").count().agg(F.max("count")).first()[0] < 600
    met = spark.range(600).select(F.lit(5).cast("long").alias("token"), F.col("id").alias("doc_id"), F.lit(600).cast("long").alias("c"), F.lit(9).cast("long").alias("place"))
    rows = join._meetings(met).cache()
    assert rows.count() == 600 * 38
    assert rows.groupBy("bucket").count().agg(F.max("count")).first()[0] < 900


def test_long_zeros_and_ids_that_tell_nothing(spark):
    from tracework.llm import common, pii

    zeros = "0" * 5000
    rows = [(1, f"{zeros}.1.1.1 and {zeros}192.{zeros}168.0.{zeros} or {zeros}256.1.1.1"), (None, "mail a@b.cc"), (None, "ip 10.0.0.1"), (None, None)]
    got = {r.text: [s.kind for s in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[rows[0][1]] == ["ip", "ip"] and got["mail a@b.cc"] == ["email"]
    same = spark.range(4000).selectExpr("cast(null as bigint) as doc_id", "cast(id as string) as text")
    assert 700 < common.bounded_sample(same, ("doc_id", "text"), 1000).count() < 1200
